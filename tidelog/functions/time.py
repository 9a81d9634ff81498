"""Times as milliseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000


def millis(ts: Column | str) -> Column:
    """Floor of a zone-less timestamp in ms, whatever the session's time zone is."""
    name = ts if isinstance(ts, str) else ts._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name}) div 1000")
