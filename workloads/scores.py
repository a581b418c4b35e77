"""Quality scores."""

from pyspark.sql import functions as F

from quiltframe.operators import quality as Q
from workloads.base import query, r, rounded, union_all

# Orders with gaps, and the same columns of another table as comparison.
GAPS = """(SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
           CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, o_orderdate FROM orders)"""
GAP_COLUMNS = ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate"]
ROLES = {"o_orderkey": "id", "o_custkey": "numeric", "o_orderpriority": "city",
         "o_totalprice": "numeric", "o_orderdate": "datetime"}


def gaps(t):
    return t.orders.select(
        "o_orderkey", "o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate")


def _complete(source, columns):
    present = " + ".join(f"count({c})" for c in columns)
    return f"(SELECT ({present})::DOUBLE / (count(*) * {len(columns)}) FROM {source})"


def _ratio(c, source):
    return f"(SELECT count(DISTINCT {c})::DOUBLE / count(*) FROM {source})"


@query(f"SELECT {r(_complete(GAPS, GAP_COLUMNS))} AS completeness")
def completeness(t):
    return rounded(Q.completeness(gaps(t)))


@query(f"SELECT {r('(' + _ratio('o_orderkey', GAPS) + ' + ' + _ratio('o_orderpriority', GAPS) + ') / 2')}"
       " AS uniqueness")
def open_uniqueness(t):
    return rounded(Q.open_uniqueness(Q.column_uniqueness(gaps(t)), ROLES))


PRIVACY = "(" + " + ".join(f"1 - {_ratio(c, GAPS)}" for c in GAP_COLUMNS) + ") / 5"


@query(f"SELECT {r(PRIVACY)} AS privacy_score")
def privacy_score(t):
    return rounded(Q.privacy_score(Q.column_uniqueness(gaps(t))))


def _entropy(c, source):
    return f"""(SELECT -sum(p * ln(p)) / ln(count(*)) FROM (SELECT count(*)::DOUBLE
        / (SELECT count({c}) FROM {source}) AS p FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}))"""


@query(f"""SELECT {r('(' + _entropy('c_name', 'customer') + ' + ' + _entropy('c_mktsegment', 'customer')
       + ') / 3')} AS diversity""")
def open_diversity(t):
    """The mean of a key-like, a skewed and a constant column."""
    df = t.customer.select("c_name", "c_mktsegment", F.lit("C").alias("c_first"))
    return rounded(Q.open_diversity(Q.column_uniqueness(df), {"c_name": "person_name", "c_mktsegment": "city",
                                         "c_first": "state"}))


# Two tables with the same columns: customers as the seed, suppliers as the made table.
SEED = "(SELECT 'N' || c_nationkey AS nation, c_acctbal AS balance FROM customer)"
MADE = "(SELECT ' N' || s_nationkey AS nation, s_acctbal AS balance FROM supplier)"


def seed(t):
    return t.customer.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation"),
                             F.col("c_acctbal").alias("balance"))


def made(t):
    return t.supplier.select(F.concat(F.lit(" N"), F.col("s_nationkey").cast("string")).alias("nation"),
                             F.col("s_acctbal").alias("balance"))


PAIR_ROLES = {"nation": "closed_categorical", "balance": "numeric"}
ENUM = f"""(SELECT 5e-1 * sum((p > 0 AND q > 0)::INT) / sum((q > 0)::INT)
        + 5e-1 * (1 - sum(abs(p - q)) / 2) FROM (
        SELECT coalesce(s.p, 0e0) AS p, coalesce(m.q, 0e0) AS q FROM
        (SELECT nation, count(*)::DOUBLE / (SELECT count(*) FROM customer) AS p FROM {SEED} GROUP BY 1) s
        FULL JOIN (SELECT trim(nation) AS nation, count(*)::DOUBLE / (SELECT count(*) FROM supplier) AS q
        FROM {MADE} GROUP BY 1) m ON s.nation = m.nation))"""
NUMERIC = f"""(SELECT (CASE WHEN abs(avg_m - avg_s) <= 2 * sd_s THEN 1e0 ELSE 5e-1 END
        + least(sd_m, sd_s) / greatest(sd_m, sd_s)) / 2 FROM
        (SELECT avg(balance) AS avg_s, stddev_samp(balance) AS sd_s FROM {SEED}),
        (SELECT avg(balance) AS avg_m, stddev_samp(balance) AS sd_m FROM {MADE}))"""


@query(f"SELECT {r(ENUM)} AS enum_fidelity")
def enum_fidelity(t):
    return rounded(Q.enum_fidelity(made(t), seed(t), PAIR_ROLES))


@query(f"SELECT {r(NUMERIC)} AS numeric_fidelity")
def numeric_fidelity(t):
    return rounded(Q.numeric_fidelity(made(t), seed(t), PAIR_ROLES))


PEOPLE = """(SELECT p_name AS full_name, CASE WHEN p_size > 40 THEN p_brand ELSE replace(p_name, ' ', '.')
             END || CASE WHEN p_size = 1 THEN '' ELSE '@parts.example.com' END AS email, p_partkey FROM part)"""


def people(t):
    local = F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.replace("p_name", F.lit(" "), F.lit(".")))
    return t.part.select(
        F.col("p_name").alias("full_name"),
        F.concat(local, F.when(F.col("p_size") == 1, "").otherwise("@parts.example.com")).alias("email"),
        "p_partkey")


COHERENCE = f"""(SELECT avg((len(list_filter(regexp_split_to_array(regexp_replace(lower(full_name),
    '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda p: length(p) >= 2
    AND contains(lower(split_part(email, '@', 1)), p))) > 0)::INT)
    FROM {PEOPLE} WHERE contains(email, '@'))"""


@query(f"SELECT {r(COHERENCE)} AS name_email_coherence")
def name_email_coherence(t):
    df = people(t)
    return rounded(Q.name_email_coherence(df, *Q.name_and_email_columns(df, {})))


@query(f"SELECT {r('count(DISTINCT s_suppkey)::DOUBLE / count(*)')} AS id_uniqueness FROM supplier")
def id_uniqueness_by_shape(t):
    """No id-named column: the column of codes counts."""
    df = t.supplier.select("s_acctbal", F.concat(F.lit("SUP-"), F.col("s_suppkey").cast("string")).alias("s_code"))
    return rounded(Q.id_uniqueness(Q.column_uniqueness(df), df))


@query(f"SELECT {r('(' + _ratio('user_id', 'events') + ' + ' + _ratio('event_id', 'events') + ') / 2')}"
       " AS id_uniqueness")
def id_uniqueness(t):
    df = t.events.select("event_id", "user_id", "event_type")
    return rounded(Q.id_uniqueness(Q.column_uniqueness(df), df))


def _dates(c, source):
    return f"""(SELECT least(1e0, count(DISTINCT d)::DOUBLE / greatest(1, least(count(d), CASE
        WHEN date_diff('day', min(d)::DATE, max(d)::DATE) > 0
        THEN date_diff('day', min(d)::DATE, max(d)::DATE) + 1 ELSE count(DISTINCT d) END)))
        FROM (SELECT {c} AS d FROM {source}))"""


@query(f"SELECT {r('(' + _dates('o_orderdate', 'orders') + ' + ' + _dates('o_orderdate', 'orders') + ') / 2')}"
       " AS date_diversity")
def date_diversity(t):
    """A timestamp column and the same days as text; prices and labels are no dates."""
    return rounded(Q.date_diversity(t.orders.select(
        "o_orderdate", "o_totalprice", "o_orderpriority",
        F.date_format("o_orderdate", "M/d/yyyy").alias("day_text"))))


def _top(c, source):
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1)"


def _number_stats(c, source):
    return f"""SELECT '{c}' AS "column", {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
        min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, NULL::BIGINT AS "unique",
        NULL::VARCHAR AS most_common FROM {source}"""


def _label_stats(c, source):
    return f"""SELECT '{c}' AS "column", NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min,
        NULL::DOUBLE AS max, count(DISTINCT {c}) AS "unique", {_top(c, source)}::VARCHAR AS most_common
        FROM {source}"""


@query(union_all([_number_stats(c, GAPS) for c in ("o_orderkey", "o_custkey", "o_totalprice")]
                 + [_label_stats(c, GAPS) for c in ("o_orderpriority", "o_orderdate")]))
def column_statistics(t):
    return rounded(Q.column_statistics(gaps(t)))


SIMPLE_UNIQUE = "(" + " + ".join(_ratio(c, GAPS) for c in GAP_COLUMNS) + ") / 5"


@query(f"""SELECT {r(f'({_complete(GAPS, GAP_COLUMNS)} + {SIMPLE_UNIQUE}) / 2')} AS overall_score,
       {r(_complete(GAPS, GAP_COLUMNS))} AS completeness, {r(SIMPLE_UNIQUE)} AS uniqueness,
       5e-1 AS diversity, 5e-1 AS privacy_score""")
def simple_quality(t):
    return rounded(Q.simple_quality(gaps(t)))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN v IS NULL THEN NULL WHEN least(v, 1e0) >= 0.7 THEN 'good'
       WHEN v >= 0.4 THEN 'mid' ELSE 'low' END AS band, CASE WHEN v IS NULL THEN 'N/A'
       ELSE format('{:.1f}', least(v, 1e0) * 1e2) || '%' END AS percent
       FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_quantity / 4e1, 3) END
       AS v FROM lineitem)""")
def score_bands(t):
    value = F.when(F.col("l_discount") > 0, F.round(F.col("l_quantity") / 40, 3))
    return t.lineitem.select("l_orderkey", "l_linenumber", Q.score_band(value).alias("band"),
                             Q.score_percent(value).alias("percent"))


# The whole report of orders: the key is an id by its role only, dates are date-like.
REPORT_ROLES = {"o_orderkey": "id", "o_custkey": "numeric", "o_orderstatus": "closed_categorical",
                "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "text_open"}
ORDER_COLUMNS = list(REPORT_ROLES)
PARTS = {
    "completeness": _complete("orders", ORDER_COLUMNS),
    "id_uniqueness": "1e0",
    "date_diversity": _dates("o_orderdate", "orders"),
    "diversity": _entropy("o_orderpriority", "orders"),
    "enum_fidelity": "NULL::DOUBLE",
    "name_email_coherence": "NULL::DOUBLE",
    "numeric_fidelity": "NULL::DOUBLE",
    "uniqueness": "(" + _ratio("o_orderkey", "orders") + " + " + _ratio("o_orderpriority", "orders") + ") / 2",
    "privacy_score": "(" + " + ".join(f"1 - {_ratio(c, 'orders')}" for c in ORDER_COLUMNS) + ") / 6",
}
KNOWN = [PARTS[m] for m in ("completeness", "id_uniqueness", "date_diversity", "diversity", "uniqueness")]


@query(f"SELECT round_even(({' + '.join(KNOWN)}) / 5, 3) AS overall_score, "
       + ", ".join((f"{r(v)}" if "NULL::" not in v else v) + f" AS {k}" for k, v in PARTS.items()))
def quality_report(t):
    return rounded(Q.quality_report(t.orders, roles=REPORT_ROLES))


PAIR_PARTS = {
    "completeness": "1e0", "id_uniqueness": "1e0", "date_diversity": "1e0", "diversity": "1e0",
    "enum_fidelity": ENUM, "name_email_coherence": "NULL::DOUBLE", "numeric_fidelity": NUMERIC,
    "uniqueness": "NULL::DOUBLE",
    "privacy_score": "(2 - " + _ratio("nation", MADE) + " - " + _ratio("balance", MADE) + ") / 2",
}


@query(f"SELECT round_even((4 + {ENUM} + {NUMERIC}) / 6, 3) AS overall_score, "
       + ", ".join((f"{r(v)}" if "NULL::" not in v else v) + f" AS {k}" for k, v in PAIR_PARTS.items()))
def quality_report_against_sample(t):
    """Roles are inferred from the sample here."""
    return rounded(Q.quality_report(made(t), sample=seed(t)))


