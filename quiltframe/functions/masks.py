"""Masks for personal data: whole-cell masks and span redaction. NULL stays NULL."""

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiltframe.constants import PII_PATTERNS
from quiltframe.functions.text import digits


def mask_email(cell: Column) -> Column:
    parts = F.split(cell, "@", -1)
    masked = F.concat(F.substring(parts[0], 1, 1), F.lit("***@"), F.get(parts, F.lit(1)))
    return F.when(F.size(parts) == 2, masked).otherwise(cell)


def mask_phone(cell: Column) -> Column:
    number = digits(cell)
    return (
        F.when(F.length(number) >= 10,
               F.concat(F.left(number, F.lit(3)), F.lit("***"), F.right(number, F.lit(4))))
        .when(F.length(cell) > 4, F.concat(F.lit("***"), F.right(cell, F.lit(4))))
        .when(cell.isNotNull(), F.lit("***"))
    )


def mask_ssn(cell: Column) -> Column:
    hidden = F.concat(F.lit("***-**-"), F.right(cell, F.lit(4)))
    return F.when(F.length(cell) >= 9, hidden).otherwise(cell)


def mask_card(cell: Column) -> Column:
    number = digits(cell)
    return (
        F.when(F.length(number) >= 16,
               F.concat(F.lit("****-****-****-"), F.right(number, F.lit(4))))
        .when(F.length(cell) > 4, F.concat(F.lit("****"), F.right(cell, F.lit(4))))
        .otherwise(cell)
    )


MASKS = {"email": mask_email, "phone": mask_phone, "ssn": mask_ssn, "credit_card": mask_card}

# Longer patterns first, so that a card number is not read as a phone number.
REDACTION_ORDER = ["email", "credit_card", "ssn", "phone", "ip_address"]


def may_hold(text: Column, kind: str) -> Column:
    """A cheap test every text holding this kind passes: an @, or else a digit."""
    return F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9]")


def holds(text: Column, kind: str) -> Column:
    return may_hold(text, kind) & text.rlike(PII_PATTERNS[kind])


def redact(text: Column, kinds: list[str] | None = None) -> Column:
    """Replace each match inside running text by its kind in brackets."""
    source = text
    # Kinds that share a guard run behind one test of the original text.
    for _, group in groupby(kinds or REDACTION_ORDER, lambda kind: kind == "email"):
        group, replaced = list(group), text
        for kind in group:
            replaced = F.regexp_replace(replaced, PII_PATTERNS[kind], f"[{kind.upper()}]")
        text = F.when(may_hold(source, group[0]), replaced).otherwise(text)
    return text
