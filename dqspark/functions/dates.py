"""Date patterns: strftime directives, Spark patterns and a cheap shape test for each."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directive -> (Spark pattern, Spark pattern next to another directive, shape).
DIRECTIVES = {
    "%Y": ("yyyy", "yyyy", r"\d{4}"),
    "%y": ("yy", "yy", r"\d{2}"),
    "%m": ("M", "MM", r"\d{1,2}"),
    "%d": ("d", "dd", r"\d{1,2}"),
    "%H": ("H", "HH", r"\d{1,2}"),
    "%I": ("h", "hh", r"\d{1,2}"),
    "%M": ("m", "mm", r"\d{1,2}"),
    "%S": ("s", "ss", r"\d{1,2}"),
    "%f": ("SSSSSS", "SSSSSS", r"\d{6}"),
    "%j": ("DDD", "DDD", r"\d{3}"),
    "%b": ("MMM", "MMM", r"[A-Za-z]{3}"),
    "%B": ("MMMM", "MMMM", r"[A-Za-z]+"),
    "%p": ("a", "a", r"[AaPp][Mm]"),
    "%z": ("[XXX][XX]", "[XXX][XX]", r"(?:Z|[+-]\d{2}:?\d{2})"),
}
# The day of the week, which a date need not say; allowed at the beginning only.
WEEKDAYS = {"%a": r"[A-Za-z]{3}", "%A": r"[A-Za-z]+"}

# Formats tried, in this order, where none is given.
CANDIDATE_FORMATS = [
    "%Y-%m-%d",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S.%f",
    "%Y-%m-%d %H:%M",
    "%Y/%m/%d",
    "%m/%d/%Y",
    "%d/%m/%Y",
    "%m/%d/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%m-%d-%Y",
    "%d-%m-%Y",
    "%d.%m.%Y",
    "%Y%m%d",
    "%b %d, %Y",
    "%B %d, %Y",
    "%d %b %Y",
    "%d %B %Y",
    "%d-%b-%Y",
    "%m/%d/%Y %I:%M:%S %p",
    "%m/%d/%Y %I:%M %p",
    "%Y-%m-%d %I:%M:%S %p",
    "%a, %d %b %Y %H:%M:%S",
    "%A, %B %d, %Y",
]
# Formats with an offset from UTC, tried after those.
ZONED_FORMATS = ["%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S%z"]


class UnknownDateFormat(ValueError):
    """A strftime directive without a Spark counterpart."""


def _tokens(fmt: str) -> list[str]:
    return re.findall(r"%.|[^%]+", fmt)


def _weekday(fmt: str) -> tuple[str, str]:
    """A format without its leading day of the week, and the expression that day's text matches."""
    parts = _tokens(fmt)
    if parts and parts[0] in WEEKDAYS:
        gap = parts[1] if len(parts) > 1 and not parts[1].startswith("%") else ""
        return fmt[len(parts[0]) + len(gap) :], WEEKDAYS[parts[0]] + re.escape(gap)
    return fmt, ""


def spark_pattern(fmt: str) -> str:
    """Translate a strftime format; numbers may come without leading zeros where that is clear."""
    fmt, _ = _weekday(fmt)
    parts = _tokens(fmt)
    out = []
    for i, part in enumerate(parts):
        if not part.startswith("%"):
            out.append("'" + part.replace("'", "''") + "'" if re.search("[A-Za-z'#\\[\\]{}]", part) else part)
            continue
        if part not in DIRECTIVES:
            raise UnknownDateFormat(f"cannot translate {part!r} of date format {fmt!r}")
        loose, tight, _ = DIRECTIVES[part]
        beside = (i > 0 and parts[i - 1].startswith("%")) or (
            i + 1 < len(parts) and parts[i + 1].startswith("%")
        )
        out.append(tight if beside else loose)
    return "".join(out)


def shape(fmt: str) -> str:
    """A regular expression that every text of the format matches."""
    fmt, day = _weekday(fmt)
    return "^" + day + "".join(
        DIRECTIVES[p][2] if p.startswith("%") else re.escape(p).replace("/", "/") for p in _tokens(fmt)
    ) + "$"


# What a directive's shape can look like once digits are zeros and runs of letters are one letter.
_DIGITS = {r"\d{4}": ["0000"], r"\d{2}": ["00"], r"\d{1,2}": ["0", "00"], r"\d{3}": ["000"], r"\d{6}": ["000000"]}
_OFFSETS = ["a", *(sign + hours for sign in "+-" for hours in ("00:00", "0000"))]


def sketch(c: Column) -> Column:
    """The outline of a text: digits become zeros, a run of letters one letter."""
    return F.regexp_replace(F.translate(c, "123456789", "0" * 9), "[A-Za-z]+", "a")


def sketches(fmt: str) -> set[str]:
    """Every outline that a text of the format can have."""
    parts = []
    for p in _tokens(fmt):
        if p in WEEKDAYS:
            parts.append(["a"])
        elif p == "%z":
            parts.append(_OFFSETS)
        elif p.startswith("%"):
            parts.append(_DIGITS.get(DIRECTIVES[p][2], ["a"]))
        else:
            parts.append([re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "0", p))])
    return {re.sub("a+", "a", "".join(x)) for x in product(*parts)}


def parse_date(c: Column, fmt: str) -> Column:
    """The text as a ``timestamp_ntz``; NULL where it is not of the format.

    The shape test comes first: a parse that fails costs an exception, a regular expression not.
    Times are parsed in UTC whatever the session's zone, so that hours which a change of clocks skips
    or repeats stay as written; a text with an offset of its own (``%z``) becomes its time in UTC. Years of
    two digits from 69 on belong to the last century.
    """
    pattern, day = spark_pattern(fmt), _weekday(fmt)[1]
    text = F.regexp_replace(c, f"^{day}", "") if day else c
    if "%z" in fmt:
        parsed = F.try_to_timestamp(text, F.lit(pattern))
    else:
        parsed = F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(pattern + " XXX"))
    written = F.timestamp_add("MICROSECOND", F.unix_micros(parsed), F.lit("1970-01-01").cast("timestamp_ntz"))
    if "%y" in fmt:
        century = F.make_ym_interval(F.lit(100))
        written = F.when(F.year(written) >= 2069, written - century).otherwise(written)
    return F.when(c.rlike(shape(fmt)), written)
