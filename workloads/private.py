"""Detection and masking of personal data."""

from pyspark.sql import functions as F

from quiltframe.constants import PII_PATTERNS
from quiltframe.functions import masks
from quiltframe.operators import privacy as P
from workloads.base import query, union_all

TEXTS = {"documents": "text", "pages": "html", "conversations": "text", "benchmark": "text"}
CONTACTS = """(SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'none' ELSE lower(c_mktsegment) || c_custkey
    || '@' || CASE WHEN c_nationkey = 4 THEN '@' ELSE '' END || 'mail.example.com' END AS email,
    CASE WHEN c_nationkey = 5 THEN '12' ELSE printf('%03d', 200 + c_nationkey) || '-555-'
    || printf('%04d', c_custkey % 10000) END AS phone,
    CASE WHEN c_nationkey = 6 THEN 'unknown' ELSE printf('%03d-%02d-%04d', c_nationkey, c_nationkey,
    c_custkey % 10000) END AS ssn,
    printf('4111-1111-%04d-%04d', c_nationkey, c_custkey % 10000) AS card FROM customer)"""


def contacts(t):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    last = F.col("c_custkey") % 10000
    mail = F.concat(F.lower("c_mktsegment"), key.cast("string"), F.lit("@"),
                    F.when(nation == 4, "@").otherwise(""), F.lit("mail.example.com"))
    return t.customer.select(
        key, F.when(nation == 3, "none").otherwise(mail).alias("email"),
        F.when(nation == 5, "12").otherwise(F.format_string("%03d-555-%04d", nation + 200, last)).alias("phone"),
        F.when(nation == 6, "unknown").otherwise(
            F.format_string("%03d-%02d-%04d", nation, nation, last)).alias("ssn"),
        F.format_string("4111-1111-%04d-%04d", nation, last).alias("card"))


@query("SELECT * FROM (" + union_all([
    f"""SELECT '{t}' AS "table", '{c}' AS "column", '{kind}' AS pattern,
    count(CASE WHEN regexp_matches({c}, '{p}') THEN 1 END) AS matches FROM {t}"""
    for t, c in TEXTS.items() for kind, p in PII_PATTERNS.items()]) + ") WHERE matches > 0")
def personal_data_found(t):
    out = None
    for table, c in TEXTS.items():
        part = P.detect_pii(getattr(t, table), [c]).select(F.lit(table).alias("table"), "*")
        out = part if out is None else out.unionByName(part)
    return out


EMAIL = """CASE WHEN len(string_split(email, '@')) = 2 THEN substr(email, 1, 1) || '***@'
           || split_part(email, '@', 2) ELSE email END"""
PHONE_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
PHONE = f"""CASE WHEN length({PHONE_DIGITS}) >= 10 THEN left({PHONE_DIGITS}, 3) || '***' || right({PHONE_DIGITS}, 4)
            WHEN length(phone) > 4 THEN '***' || right(phone, 4) ELSE '***' END"""
SSN = "CASE WHEN length(ssn) >= 9 THEN '***-**-' || right(ssn, 4) ELSE ssn END"
CARD_DIGITS = "regexp_replace(card, '[^0-9]', '', 'g')"
CARD = f"""CASE WHEN length({CARD_DIGITS}) >= 16 THEN '****-****-****-' || right({CARD_DIGITS}, 4)
           WHEN length(card) > 4 THEN '****' || right(card, 4) ELSE card END"""


@query(f"SELECT c_custkey, {EMAIL} AS email, {PHONE} AS phone, {SSN} AS ssn, {CARD} AS card FROM {CONTACTS}")
def cells_masked(t):
    df = contacts(t)
    return df.select(
        "c_custkey", masks.mask_email(F.col("email")).alias("email"),
        masks.mask_phone(F.col("phone")).alias("phone"), masks.mask_ssn(F.col("ssn")).alias("ssn"),
        masks.mask_card(F.col("card")).alias("card"))


def _if(column, kind, sql):
    return f"CASE WHEN regexp_matches({column}, '{PII_PATTERNS[kind]}') THEN {sql} ELSE {column} END AS {column}"


@query(f"""SELECT c_custkey, {_if('email', 'email', EMAIL)}, {_if('phone', 'phone', PHONE)},
       {_if('ssn', 'ssn', SSN)}, {_if('card', 'credit_card', CARD)} FROM {CONTACTS}""")
def privacy_applied(t):
    """Columns and masks are found by detection; cells that do not match stay."""
    return P.apply_privacy(contacts(t))


def _redacted(column):
    for kind in masks.REDACTION_ORDER:
        column = f"regexp_replace({column}, '{PII_PATTERNS[kind]}', '[{kind.upper()}]', 'g')"
    return column


@query(f"SELECT doc_id, {_redacted('text')} AS text FROM documents")
def documents_redacted(t):
    return P.redact_text(t.documents.select("doc_id", "text"))


@query(f"SELECT page_id, url, {_redacted('html')} AS html FROM pages")
def pages_redacted(t):
    return P.redact_text(t.pages, ["html"])
