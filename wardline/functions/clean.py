"""Cleaning, encoding and time expressions. All are built-in expressions: no Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, word list, patterns and encodings that results depend on.
UNKNOWN = "Unknown/Other"
UNKNOWN_CODE = "Unknown_CCS"
UNKNOWN_WORDS = ("unknown", "unable to obtain", "other")
RACE_PATTERNS = (("white", "White"), ("black", "Black"), ("asian", "Asian"), ("hispanic", "Hispanic"))
GENDER_CODES = {"M": 0, "F": 1}
GENDER_CODES_SEQUENCE = {"M": 1, "F": 0}

_BLANKS = " \t\r\n"
_SECONDS_PER_DAY = 86_400.0
_CALENDAR = r"^(\d{4})([-/.]?)(\d{1,2})\2(\d{1,2})(?=$|[ T])"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_unknown(c: Column, words: tuple[str, ...] = UNKNOWN_WORDS, label: str = UNKNOWN) -> Column:
    """Null, blank or any text holding one of ``words`` as whole word(s) becomes ``label``."""
    text = F.lower(strip(c))
    unknown = c.isNull() | (text == "") | text.rlike(rf"\b({'|'.join(words)})\b")
    return F.when(unknown, F.lit(label)).otherwise(c)


def default_code_label(c: Column, label: str = UNKNOWN_CODE) -> Column:
    return F.coalesce(null_if_empty(c), F.lit(label))


def encode_values(c: Column, codes: dict[str, int]) -> Column:
    """Integer per listed value, null for anything else."""
    first, *rest = codes.items()
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), rest, F.when(c == first[0], first[1]))


def encode_gender(c: Column, codes: dict[str, int] | None = None) -> Column:
    return encode_values(c, codes or GENDER_CODES)


def encode_language(c: Column, reference: str = "English") -> Column:
    return F.when(c == reference, 1).otherwise(0)


def parse_time(c: Column) -> Column:
    """Year, date or date-time text to a zone-free timestamp; anything else becomes null."""
    text = F.regexp_replace(strip(c), _CALENDAR, "$1-$3-$4")
    return text.try_cast("timestamp_ntz")


def bucket_by_regex(c: Column, patterns: tuple[tuple[str, str], ...] = RACE_PATTERNS) -> Column:
    """Label of the first pattern found anywhere in the text, ignoring case; otherwise unchanged."""
    (first, label), *rest = patterns
    chain = F.when(c.rlike(f"(?i){first}"), F.lit(label))
    return reduce(lambda acc, pl: acc.when(c.rlike(f"(?i){pl[0]}"), F.lit(pl[1])), rest, chain).otherwise(c)


def days_between(start: Column, end: Column) -> Column:
    """``end - start`` in fractional days, null when either is null.

    Zone-free timestamps are subtracted as such: no clock change of the session's zone gets in.
    """
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return seconds.cast("double") / F.lit(_SECONDS_PER_DAY)


def age_at(time: Column, anchor_year: Column, anchor_age: Column) -> Column:
    return F.year(time) - F.year(anchor_year) + anchor_age


def clamp_to_zero(c: Column) -> Column:
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def drop_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def days_until_death(admitted: Column, date_of_death: Column, death_time: Column) -> Column:
    return days_between(admitted, F.coalesce(date_of_death, death_time))


def normalize_code(c: Column) -> Column:
    """Code without dots, quotes and outer blanks."""
    return strip(F.translate(c, ".'", ""))


def strip_label_prefix(c: Column, prefix: str = "race_") -> Column:
    return F.replace(c, F.lit(prefix), F.lit(""))


def row_to_text(columns: list[str], numeric: set[str] = frozenset(), missing: str = "nan") -> Column:
    """``name=value`` parts joined by `` | ``; numbers are shown as doubles, nulls as ``missing``."""

    def shown(name: str) -> Column:
        value = F.col(name).cast("double") if name in numeric else F.col(name)
        return F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit(missing)))

    return F.concat_ws(" | ", *[shown(c) for c in columns])
