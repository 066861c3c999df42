"""Globe and colour functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def _blend(low: int, high: int, ratio: Column) -> Column:
    return F.floor(F.lit(float(low)) + F.lit(float(high - low)) * ratio + F.lit(0.5)).cast("int").cast("string")


def _rgb(low: tuple, high: tuple, ratio: Column) -> Column:
    parts = [_blend(a, b, ratio) for a, b in zip(low, high)]
    return F.concat(F.lit("rgb("), parts[0], F.lit(", "), parts[1], F.lit(", "), parts[2], F.lit(")"))


def heat_color(value: Column, top: float = 50) -> Column:
    """Green through yellow and orange to red, three straight segments."""
    ratio = F.least(value.cast("double") / F.lit(float(top)), F.lit(1.0))
    first, second, third, last = L.HEAT_STOPS
    return (
        F.when(ratio < 0.33, _rgb(first, second, ratio / F.lit(0.33)))
        .when(ratio < 0.66, _rgb(second, third, (ratio - F.lit(0.33)) / F.lit(0.33)))
        .otherwise(_rgb(third, last, (ratio - F.lit(0.66)) / F.lit(0.34)))
    )


def latlon_to_xyz(lat: Column, lon: Column, radius: float = 5.0) -> tuple[Column, Column, Column]:
    """Point on the globe, rounded to six digits."""
    phi = F.radians(F.lit(90.0) - lat.cast("double"))
    theta = F.radians(lon.cast("double") + F.lit(180.0))
    r = F.lit(float(radius))
    zero = F.lit(0.0)
    x = F.round(-(r * F.sin(phi) * F.cos(theta)), 6) + zero
    y = F.round(r * F.cos(phi), 6) + zero
    z = F.round(r * F.sin(phi) * F.sin(theta), 6) + zero
    return x, y, z


def marker_size(count: Column) -> Column:
    return F.round(F.lit(0.15) + count.cast("double") / F.lit(100.0), 4)


def source_badge(name: Column, kind: Column, reliability: Column) -> tuple[Column, Column]:
    """Two-letter logo, and a colour by type or else by reliability."""
    score = F.when(F.coalesce(reliability, F.lit(0)) == 0, L.DEFAULT_RELIABILITY).otherwise(reliability)
    by_score = None
    for least, colour in L.RELIABILITY_COLOURS:
        by_score = F.when(score >= least, colour) if by_score is None else by_score.when(score >= least, colour)
    by_score = by_score.otherwise(L.LOW_RELIABILITY_COLOUR)
    colour = None
    for code, value in L.SOURCE_TYPE_COLOURS.items():
        colour = F.when(kind == code, value) if colour is None else colour.when(kind == code, value)
    return F.substring(name, 1, 2), colour.otherwise(by_score)
