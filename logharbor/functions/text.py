"""Ids, rendering, validation and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logharbor import constants as K


def vector_id(log_id: Column) -> Column:
    """Stable vector key of a log id (P10)."""
    return F.substring(F.sha2(log_id, 256), 1, 32)


def row_id(*parts: Column) -> Column:
    """Deterministic row id, so re-runs and stream replays agree."""
    return F.sha2(F.concat_ws("#", *[p.cast("string") for p in parts]), 256)


def upper_level(level: Column) -> Column:
    """Upper-case level, default INFO."""
    return F.upper(F.coalesce(level, F.lit("INFO")))


def embedding_text(level: Column, service: Column, message: Column) -> Column:
    """``[LEVEL] service: message`` with ``unknown`` for a missing service."""
    return F.concat(
        F.lit("["), level, F.lit("] "),
        F.coalesce(service, F.lit("unknown")), F.lit(": "), message,
    )


def sample_line(ts: Column, level: Column, service: Column, message: Column) -> Column:
    """``[HH:mm:ss] [LEVEL] service: message``."""
    return F.concat(
        F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("] "),
        embedding_text(level, service, message),
    )


def iso_text(ts: Column) -> Column:
    """ISO-8601 text; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(micros == ".000000", F.lit("")).otherwise(micros))


def iso_line(ts: Column, level: Column, service: Column, message: Column) -> Column:
    """``<ISO time> [LEVEL] service: message``."""
    return F.concat(iso_text(ts), F.lit(" "), embedding_text(level, service, message))


def day_of_week(ts: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(ts) - 1


def similarity_percent(distance: Column) -> Column:
    """``1 - distance`` as a whole percentage."""
    return F.format_string("%.0f%%", (1 - distance) * 100)


def valid_message(message: Column) -> Column:
    length = F.char_length(message)
    return F.coalesce((length >= 1) & (length <= K.VALID_MESSAGE_CHARS), F.lit(False))


def valid_enum(col: Column, allowed: list[str]) -> Column:
    return F.coalesce(col.isin(allowed), F.lit(False))


def valid_confidence(col: Column) -> Column:
    return F.coalesce((col >= 0) & (col <= 1), F.lit(False))


def severity_rank(severity: Column) -> Column:
    """low 1 .. critical 4, so that ``max`` finds the worst."""
    return F.array_position(F.array(*[F.lit(s) for s in K.SEVERITIES]), severity).cast("int")


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in K.SEVERITIES]), rank.cast("int"))


def tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
