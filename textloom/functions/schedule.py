"""Step schedules and durations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _whole(value: Column) -> Column:
    return F.floor(value).cast("bigint")


def learning_rate(
    step: Column,
    total_steps: Column | int,
    initial: float = 1e-5,
    peak: float = 2e-4,
    floor: float = 2e-5,
    warmup: float = 0.02,
    hold: float = 0.15,
    tail: float = 0.1,
) -> Column:
    """Linear warm-up, constant peak, cosine, constant floor.

    ``warmup``, ``hold`` and ``tail`` are shares of ``total_steps``; phase
    bounds are whole steps. No warm-up steps means starting at the peak.
    """
    total = _c(total_steps)
    warm = _whole(F.lit(warmup) * total)
    held = warm + _whole(F.lit(hold) * total)
    last = _whole(F.lit(1 - tail) * total)
    progress = (step - held) / (last - held)
    return (
        F.when(step < warm, F.lit(initial) + step * (F.lit(peak - initial) / warm))
        .when(step < held, F.lit(peak))
        .when(step < last, F.lit(floor) + F.lit((peak - floor) * 0.5) * (1 + F.cos(F.pi() * progress)))
        .otherwise(F.lit(floor))
    )


def learning_rate_two_phase(
    step: Column,
    total_steps: Column | int,
    initial: float = 1e-5,
    peak: float = 2e-4,
    floor: float = 2e-5,
    warmup: float = 0.1,
) -> Column:
    """Linear warm-up, then cosine to the end."""
    total = _c(total_steps)
    warm = F.lit(warmup) * total
    progress = (step - warm) / (total - warm)
    cosine = F.lit(floor) + F.lit((peak - floor) * 0.5) * (1 + F.cos(F.pi() * progress))
    return F.when(step < warm, F.lit(initial) + step * (F.lit(peak - initial) / warm)).otherwise(cosine)


def hms(seconds: Column) -> Column:
    """Hours, minutes and seconds as a struct of whole numbers."""
    return F.struct(
        _whole(seconds / 3600).alias("hours"),
        _whole(F.pmod(seconds, F.lit(3600)) / 60).alias("minutes"),
        _whole(F.pmod(seconds, F.lit(60))).alias("seconds"),
    )


def duration_text(start: Column, end: Column) -> Column:
    """Like "1 day, 2 hours, 3 minutes, 4 seconds"; zero parts are left out."""
    span = end - start
    parts = [
        ("day", F.floor(span / 86400)),
        ("hour", F.floor(F.pmod(span, F.lit(86400)) / 3600)),
        ("minute", F.floor(F.pmod(span, F.lit(3600)) / 60)),
    ]
    shown = [_part(value, unit) for unit, value in parts]
    seconds = F.pmod(span, F.lit(60))
    nothing = F.coalesce(*shown).isNull()
    last = F.when((seconds > 0) | nothing, _plural(_whole(seconds), seconds, "second"))
    return F.concat_ws(", ", *shown, last)


def _part(value: Column, unit: str) -> Column:
    return F.when(value > 0, _plural(value.cast("bigint"), value, unit))


def _plural(shown: Column, value: Column, unit: str) -> Column:
    return F.concat(shown.cast("string"), F.lit(f" {unit}"), F.when(value > 1, F.lit("s")).otherwise(F.lit("")))
