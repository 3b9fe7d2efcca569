"""Time expressions that do not depend on the session time zone."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# zone written as Z or +hh, or as +hh:mm
ISO_WITH_ZONE = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ssXXX")


def parse_epoch_seconds(text: Column, formats: tuple[str, ...] = ISO_WITH_ZONE) -> Column:
    """ISO string with a zone to epoch seconds; text that does not parse gives null."""
    return F.unix_timestamp(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]))


def epoch_seconds(ts_ntz: Column) -> Column:
    """Epoch seconds of a zone-less timestamp read as UTC."""
    day = F.unix_date(ts_ntz.cast("date")).cast("bigint") * F.lit(86400).cast("bigint")
    return day + F.hour(ts_ntz) * 3600 + F.minute(ts_ntz) * 60 + F.second(ts_ntz)


def epoch_millis(ts_ntz: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp read as UTC (fraction truncated)."""
    fraction = F.extract(F.lit("SECOND"), ts_ntz) - F.second(ts_ntz)
    return epoch_seconds(ts_ntz) * 1000 + F.floor(fraction * 1000).cast("bigint")


def instant(df, ts: str) -> Column:
    """Time column as an instant; a zone-less one is read as UTC."""
    if not isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.col(ts)
    c = F.col(ts)
    micros = F.floor((F.extract(F.lit("SECOND"), c) - F.second(c)) * 1000000).cast("bigint")
    return F.timestamp_micros(epoch_seconds(c) * 1000000 + micros)


def epoch_seconds_of(df, ts: str) -> Column:
    """Epoch seconds of column ``ts`` of ``df``, whatever its time type."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampNTZType):
        return epoch_seconds(F.col(ts))
    if isinstance(kind, T.TimestampType):
        return F.unix_timestamp(F.col(ts))
    if isinstance(kind, T.StringType):
        return parse_epoch_seconds(F.col(ts))
    return F.col(ts).cast("bigint")


def timestamp_literal(df, ts: str, seconds: int) -> Column:
    """Literal of the same type as column ``ts``, so that a comparison reaches the file scan."""
    kind = df.schema[ts].dataType
    moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(moment.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.lit(moment)
    return F.lit(seconds).cast("bigint")


def comparable_time(df, ts: str) -> Column:
    """Column ``ts`` as :func:`timestamp_literal` compares with it: text is parsed, other types stay as stored."""
    return parse_epoch_seconds(F.col(ts)) if isinstance(df.schema[ts].dataType, T.StringType) else F.col(ts)
