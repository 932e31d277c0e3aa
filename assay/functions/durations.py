"""Times and durations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60, 3_600, 86_400


def iso_text(moment: Column) -> Column:
    """ISO 8601 to the second, without a zone: 2024-03-01T09:05:07. NULL stays NULL."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def duration_text(seconds: Column) -> Column:
    """The two largest units that fit: 45s, 12m 30s, 2h 15m, 1d 03h.

    Half a second rounds to the even one; the unit below the second is cut off. Undefined seconds (NULL, NaN, infinite)
    give a question mark, negative ones stay seconds.
    """
    whole = F.bround(seconds.cast("double")).cast("bigint")

    def pair(form: str, large: int, small: int) -> Column:
        return F.format_string(form, F.floor(whole / large), F.floor(F.pmod(whole, F.lit(large)) / small))

    known = seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (F.abs(seconds.cast("double")) != float("inf"))
    text = (
        F.when(whole < MINUTE, F.format_string("%ds", whole))
        .when(whole < HOUR, pair("%dm %02ds", MINUTE, 1))
        .when(whole < DAY, pair("%dh %02dm", HOUR, MINUTE))
        .otherwise(pair("%dd %02dh", DAY, HOUR))
    )
    return F.when(known, text).otherwise("?")
