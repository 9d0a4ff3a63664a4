"""Log-line parsing as column expressions (no Python runs per row).

Differences from plain substring parsing that users should know:

* the zone suffix of a timestamp is honoured and the result is UTC;
* common-log stamps keep all 20 characters; syslog stamps, which carry no year,
  take the year of the ingest time;
* the service is looked up after the timestamp and the level word are removed,
  so a bracketed level is never taken for a service;
* keyword hints are substring matches (``warn`` also hits ``forewarned``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logharbor import constants as K


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def strip(col: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def any_of(words: list[str]) -> str:
    """An alternation that matches any of the plain words."""
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def contains_any(col: Column, words: list[str]) -> Column:
    return F.lower(col).rlike(any_of(words))


def first_match(col: Column, pattern: str) -> Column:
    """First hit of the pattern, or null; ``col`` is evaluated once."""
    return F.try_element_at(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), F.lit(1))


def drop_first(col: Column, pattern: str) -> Column:
    """Remove only the first hit of the pattern."""
    flags, body = ("(?is)", pattern[4:]) if pattern.startswith("(?i)") else ("(?s)", pattern)
    return F.regexp_replace(col, f"{flags}^(.*?)(?:{body})", "$1")


def _zoned(hit: Column, fmt: str, width: int) -> Column:
    """Parse a hit whose zone may be missing: a spare ``Z`` is used up or dropped."""
    spare = F.concat(hit, F.lit("Z"))
    zone = r"(Z|[+-]\d{2}:\d{2})"
    text = F.regexp_replace(spare, rf"^(.{{{width}}})(?:\.\d+)?{zone}Z?$", "$1$2")
    return F.try_to_timestamp(text, F.lit(fmt))


def parse_timestamp(text: Column, ingest_time: Column) -> Column:
    """First of the four known timestamp forms that parses, else null.

    A form that is absent is null before it reaches the date parser, whose failures
    cost far more than the search.
    """
    def hit(pattern: str) -> Column:
        return first_match(text, pattern)

    colon = F.regexp_replace(hit(K.CLF_STAMP + r"(?: [+-]\d{4})?"), r" ([+-]\d{2})(\d{2})$", "$1:$2")
    syslog = F.concat(
        F.date_format(ingest_time, "yyyy "), F.regexp_replace(hit(K.SYSLOG_STAMP), r"\s+", " ")
    )
    return F.coalesce(
        _zoned(hit(K.ISO_STAMP), "yyyy-MM-dd'T'HH:mm:ssXXX", 19),
        _zoned(hit(K.SPACE_STAMP + r"(?:Z|[+-]\d{2}:\d{2})?"), "yyyy-MM-dd HH:mm:ssXXX", 19),
        _zoned(colon, "dd/MMM/yyyy:HH:mm:ssXXX", 20),
        F.try_to_timestamp(syslog, F.lit("yyyy MMM d HH:mm:ss")),
    )


def iso_timestamp(value: Column) -> Column:
    """ISO-8601 date or time with its zone and fraction, else null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value))


def parse_json_timestamp(value: Column, ingest_time: Column) -> Column:
    """ISO-8601 with its zone and fraction, else the four text forms (P5)."""
    return F.coalesce(iso_timestamp(value), parse_timestamp(value, ingest_time))


def parse_level(text: Column, extra_error_words: list[str] | None = None) -> Column:
    """First whole-word level, else keyword hints, else INFO."""
    names = {name: name for name in K.LEVELS} | K.LEVEL_ALIASES
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    level = F.try_element_at(known, F.upper(first_match(text, K.LEVEL_WORD)))
    guess = F.lit("INFO")
    for name, words in reversed(K.LEVEL_HINTS):
        if name == "ERROR" and extra_error_words:
            words = words + extra_error_words
        guess = F.when(contains_any(text, words), F.lit(name)).otherwise(guess)
    return F.coalesce(level, guess)


def strip_first_stamp(text: Column) -> Column:
    return drop_first(text, K.STAMPS[0])


def strip_other_stamps_and_level(text: Column) -> Column:
    """Most lines have one stamp, of the first form; without a clock time left the
    other forms cannot match and are not searched."""
    rest = text
    for pattern in K.STAMPS[1:]:
        rest = drop_first(rest, pattern)
    return drop_first(F.when(text.rlike(K.CLOCK), rest).otherwise(text), K.LEVEL_WORD)


def strip_stamps_and_level(text: Column) -> Column:
    """The line without its first hit of each timestamp form and first level word."""
    return strip_other_stamps_and_level(strip_first_stamp(text))


def service_in(text: Column) -> Column:
    """Leftmost bracketed token or known service word, lower-cased, else null."""
    return F.lower(F.translate(first_match(text, K.SERVICE_TOKEN), "[]", ""))


def parse_service(line: Column) -> Column:
    return service_in(strip_stamps_and_level(line))


def clean_stripped(rest: Column, line: Column) -> Column:
    """Drop leading empty or all-capital bracket groups; keep the line if nothing is left."""
    text = strip(F.regexp_replace(rest, r"^(\s*[\[(][A-Z]*[\])]\s*)+", ""))
    return F.coalesce(blank_to_null(text), line)


def clean_message(line: Column) -> Column:
    """Message without timestamp, level word and leading bracket groups."""
    return clean_stripped(strip_stamps_and_level(line), line)


def truncate(col: Column, length: int) -> Column:
    """First ``length`` characters."""
    return F.substring(col, 1, length)


def json_fields(line: Column) -> Column:
    """The line as a string map, null unless it is one JSON object."""
    whole = F.when(line.rlike(r"(?s)^\s*\{.*\}\s*$"), line)
    return F.from_json(whole, "map<string,string>", {"allowSingleQuotes": "false"})


def first_present(fields: Column, keys: list[str]) -> Column:
    """First value among the keys that is neither missing nor an empty JSON value."""
    empty = ["", "0", "0.0", "false", "[]", "{}"]
    values = [F.try_element_at(fields, F.lit(k)) for k in keys]
    return F.coalesce(*[F.when(~v.isin(empty), v) for v in values])


def residual_fields(fields: Column, consumed: list[str]) -> Column:
    """Fields not consumed by the parser; null when none are left."""
    rest = F.map_filter(fields, lambda k, v: ~k.isin(consumed))
    return F.when(F.size(rest) > 0, rest)


def starts_object(line: Column) -> Column:
    return line.startswith("{")
