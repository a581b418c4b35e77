"""Text expressions. All of them stay inside generated JVM code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiltframe.constants import (
    BOOLEAN_WORDS, FALSE_WORDS, MODEL_FALSE, MODEL_TRUE, TRUE_WORDS,
)


# All Unicode whitespace, for regular expressions that start with (?U).
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(value: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(value, F.lit(SPACES))


def blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def boolean_label(value: Column) -> Column:
    """Unify yes/no spellings to TRUE/FALSE; other text is only stripped."""
    word = F.lower(strip(value))
    return (
        F.when(word.isin(TRUE_WORDS), F.lit("TRUE"))
        .when(word.isin(FALSE_WORDS), F.lit("FALSE"))
        .otherwise(strip(value))
    )


def model_label(value: Column) -> Column:
    """The label under which the categorical model counts a value."""
    text = strip(value)
    return (
        F.when(text.isin(MODEL_TRUE), F.lit("TRUE"))
        .when(text.isin(MODEL_FALSE), F.lit("FALSE"))
        .otherwise(text)
    )


def looks_boolean(text: Column) -> Column:
    """Whether stripped text is a yes/no word."""
    return F.lower(text).isin(BOOLEAN_WORDS)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def word_count(text: Column) -> Column:
    """Words of stripped text."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, f"(?U){SPACE}+")))


def squeeze(value: Column) -> Column:
    """Lower-case text with outer whitespace removed and inner runs made one space."""
    return F.regexp_replace(strip(F.lower(value)), f"(?U){SPACE}+", " ")


def fingerprint(values: list[Column], length: int | None = None) -> Column:
    """Squeezed cells joined by bars; whole unless cut at `length` characters."""
    parts = [F.coalesce(squeeze(v.cast("string")), F.lit("")) for v in values]
    whole = F.concat_ws("|", *parts)
    return whole if length is None else F.substring(whole, 1, length)


def edit_similarity(left: Column, right: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1.0 for two empty strings."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(left, right) / longest)


def name_in_email(name: Column, email: Column) -> Column:
    """Some name part of two or more characters occurs in the part before the @."""
    local = F.lower(F.substring_index(email, "@", 1))
    parts = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""), r"\s+")
    return F.exists(parts, lambda p: (F.length(p) >= 2) & F.contains(local, p))


def as_number(value: Column) -> Column:
    """Text as double, NULL when it is no finite number."""
    text = strip(value.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


# A zone at the end is allowed and dropped: the local wall clock is kept.
ISO_TIME = (r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?"
            r"(Z|[+-]\d{2}:\d{2})?)?$")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Pattern of the text and the datetime format that reads it.
OTHER_TIMES = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
]


def as_time(value: Column) -> Column:
    """Text as timestamp without zone, NULL when it reads as no date."""
    return stripped_time(strip(value))


def stripped_time(text: Column) -> Column:
    parsed = F.when(~text.rlike("^[A-Za-z0-9]"), None)
    parsed = parsed.when(text.rlike(ISO_TIME), text.try_cast("timestamp_ntz"))
    for pattern, layout in OTHER_TIMES:
        parsed = parsed.when(
            text.rlike(pattern), F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz")
        )
    return parsed
