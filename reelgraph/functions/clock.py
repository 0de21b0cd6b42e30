"""Media offsets: seconds to and from text, and Unix seconds of timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reelgraph.functions.hof import bind


def timestamp_to_seconds(text: Column) -> Column:
    """Seconds of ``H:M:S``, ``M:S`` or ``S``; anything else is 0."""
    parts = F.transform(F.split(text.cast("string"), ":"), lambda p: p.try_cast("double"))

    def value(p: Column) -> Column:
        n = F.size(p)
        first, second, third = (F.get(p, F.lit(i)) for i in range(3))
        return (
            F.when(n == 3, first * 3600 + second * 60 + third).when(n == 2, first * 60 + second).when(n == 1, first)
        )

    return F.coalesce(bind(parts, value), F.lit(0.0))


def seconds_to_timestamp(seconds: Column, always_hours: bool = False) -> Column:
    """``HH:MM:SS.mmm``; the hours are left out when they are 0 unless ``always_hours``."""
    s = seconds.cast("double")
    hours = F.floor(s / 3600).cast("long")
    minutes = F.floor((s - hours * F.lit(3600.0)) / 60).cast("long")
    rest = s - hours * F.lit(3600.0) - minutes * F.lit(60.0)
    long_form = F.format_string("%02d:%02d:%06.3f", hours, minutes, rest)
    return long_form if always_hours else F.when(hours > 0, long_form).otherwise(
        F.format_string("%02d:%06.3f", minutes, rest)
    )


def epoch_seconds(ts: Column) -> Column:
    """Unix seconds, with fractions, of a time-zone-free timestamp taken as UTC in any session time zone."""
    since = ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), since)

    whole = part("DAY").cast("long") * 86400 + part("HOUR").cast("long") * 3600 + part("MINUTE").cast("long") * 60
    return (whole * 1000000 + (part("SECOND") * 1000000).cast("long")) / F.lit(1e6)
