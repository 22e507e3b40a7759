"""Time parsing: ISO variants, seven-format parser, event-time recovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrylens.functions import constants as C

ZONED_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]xx",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX",
)
NAIVE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
)
SEVEN_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx",
    "yyyy-MM-dd'T'HH:mm:ss.SSSxx",
    "yyyy-MM-dd'T'HH:mm:ssxx",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
)


def _first_parse(text: Column, formats) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_iso(text: Column) -> Column:
    """PRJ2: one text to UTC; ``Z``, ``+0000``, ``+00:00`` or naive (taken as UTC).

    The general cast covers fractions of any length; it reads a naive text in the
    session zone, which the library pins to UTC.
    """
    trimmed = F.trim(text)
    return F.coalesce(
        F.when(
            trimmed.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"),
            F.regexp_replace(trimmed, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"),
        ),
        _first_parse(trimmed, ZONED_FORMATS + NAIVE_FORMATS),
    )


def parse_first(*texts: Column) -> Column:
    """PRJ2: the first of several candidate fields that parses."""
    return F.coalesce(*[parse_iso(t) for t in texts])


def parse_seven(text: Column) -> Column:
    """PRJ3: try seven formats in order, null if none fits."""
    return _first_parse(F.trim(text), SEVEN_FORMATS)


def os_event_time(system_time: Column, alert_time: Column) -> Column:
    """PRJ4: the operating system's event time, else the alert's own."""
    return F.coalesce(parse_iso(system_time), parse_iso(alert_time))


def micros(ts: Column) -> Column:
    """Integer microseconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp"))


def event_time(full_log: Column, alert_time: Column, fim_event: Column, mtime: Column) -> Column:
    """PRJ5: recovered event time as struct(us, time_source, time_uncertainty_s).

    Sources by fidelity; a file modification time counts only for added or modified
    files, and only if it precedes ingestion by a plausible lag.
    """
    log = F.coalesce(full_log, F.lit(""))

    def candidate(us: Column, source: str, uncertainty: float) -> Column:
        return F.when(
            us.isNotNull(),
            F.struct(
                us.alias("us"),
                F.lit(source).alias("time_source"),
                F.lit(uncertainty).alias("time_uncertainty_s"),
            ),
        )

    ingested = micros(parse_iso(alert_time))
    prefix = F.nullif(F.regexp_extract(log, C.ISO_PREFIX_PATTERN, 1), F.lit(""))
    clf = F.nullif(F.regexp_extract(log, C.CLF_TIME_PATTERN, 1), F.lit(""))
    audit = F.nullif(F.regexp_extract(log, C.AUDIT_EPOCH_PATTERN, 1), F.lit(""))
    modified = micros(parse_iso(mtime))
    lag_low, lag_high = (s * 1_000_000 for s in C.INGEST_LAG_RANGE_S)
    plausible = fim_event.isin("added", "modified") & (ingested - modified).between(
        lag_low, lag_high
    )
    return F.coalesce(
        candidate(micros(parse_iso(prefix)), "full_log_syslog", 0.0),
        candidate(
            micros(F.try_to_timestamp(clf, F.lit("dd/MMM/yyyy:HH:mm:ss xx"))), "full_log_clf", 1.0
        ),
        candidate((audit.cast("decimal(20,6)") * 1_000_000).cast("long"), "audit_epoch", 0.0),
        candidate(F.when(plausible, modified), "syscheck_mtime", 1.0),
        F.struct(
            ingested.alias("us"),
            F.lit("alert_timestamp").alias("time_source"),
            F.lit(80.0).alias("time_uncertainty_s"),
        ),
    )
