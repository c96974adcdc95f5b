"""Between zone-free timestamps, read as UTC, and instants; independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_instant(wall_clock: Column) -> Column:
    """The instant at which a UTC clock shows this zone-free timestamp."""
    second = F.extract(F.lit("SECOND"), wall_clock)
    return F.make_timestamp(
        F.year(wall_clock),
        F.month(wall_clock),
        F.dayofmonth(wall_clock),
        F.hour(wall_clock),
        F.minute(wall_clock),
        second,
        F.lit("UTC"),
    )


def utc_wall_clock(instant: Column) -> Column:
    """What a UTC clock shows at this instant, as a zone-free timestamp."""
    return F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz")
    )
