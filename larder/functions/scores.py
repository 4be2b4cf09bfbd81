"""Scores and geometry as Column builders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def macro_match(target: tuple[Column, Column, Column], food: tuple[Column, Column, Column]) -> Column:
    """1 - L1 / 2 between the shares of protein, fat and carbohydrate; 0 for a food without any."""
    positive = lambda cs: [F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cs]
    t, f = positive(target), positive(food)
    total_t, total_f = t[0] + t[1] + t[2], f[0] + f[1] + f[2]
    whole = F.when(total_t == 0, F.lit(1.0)).otherwise(total_t)
    l1 = sum((F.abs(a / whole - F.try_divide(b, total_f)) for a, b in zip(t, f, strict=True)), F.lit(0.0))
    return F.when(total_f <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - l1 / 2.0)))


def closeness(values: Mapping[str, tuple[Column, Column]]) -> Column:
    """Mean of 1 - min(|v - t| / t, 1) over targets above 0, for pairs (value, target); 0 if there are none."""
    pairs = [(F.coalesce(v.cast("double"), F.lit(0.0)), F.coalesce(t.cast("double"), F.lit(0.0))) for v, t in values.values()]
    score = sum((F.when(t > 0, 1.0 - F.least(F.try_divide(F.abs(v - t), t), F.lit(1.0))).otherwise(0.0) for v, t in pairs), F.lit(0.0))
    count = sum((F.when(t > 0, 1).otherwise(0) for _, t in pairs), F.lit(0))
    return F.when(count > 0, score / count).otherwise(0.0)


def within(value: Column, target: Column, tolerance: float) -> Column:
    """Within target x (1 -+ tolerance).  Targets not above 0 pass; an unknown value counts as 0, one that is no number passes."""
    t = F.coalesce(target.cast("double"), F.lit(0.0))
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    return (t <= 0) | F.isnan(v) | ((v >= t * (1 - tolerance)) & (v <= t * (1 + tolerance)))


def penalty(violations: list[Column], each: float = 0.5) -> Column:
    """`each` for every violation; the columns are numbers of violations."""
    return sum((F.coalesce(v, F.lit(0)) for v in violations), F.lit(0)) * F.lit(each)


def macros_from_energy(kcal: Column) -> Column:
    """Half of the energy from carbohydrate, a fifth from protein, three tenths from fat, in grams."""
    return F.struct((kcal * 0.2 / 4).alias("protein_g"), (kcal * 0.3 / 9).alias("fat_g"), (kcal * 0.5 / 4).alias("carb_g"), kcal.alias("energy_kcal"))


def dominant(names: list[str], values: list[Column], other: str | None = None) -> Column:
    """Name of the largest value, the first on ties; `other` if that is at most 1e-6."""
    top = F.greatest(*values)
    chain = F.when(top <= 1e-6, F.lit(other)) if other is not None else F.when(F.lit(False), F.lit(names[0]))
    for name, v in zip(names, values, strict=True):
        chain = chain.when(v == top, F.lit(name))
    return chain


def bin_right_closed(value: Column, edges: list[float], labels: list[str]) -> Column:
    """labels[i] for edges[i] < value <= edges[i + 1]; null outside."""
    chain = F.when(F.lit(False), F.lit(labels[0]))
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        chain = chain.when((value > lo) & (value <= hi), F.lit(label))
    return chain


def accurate(predicted: Column, truth: Column, threshold: float) -> Column:
    return F.abs(predicted - truth) < threshold


# Eight sectors of 45 degrees, counter-clockwise, each centred on its direction.
SECTORS = ["front", "front_left", "left", "back_left", "back", "back_right", "right", "front_right"]


def sector_index(x: Column, y: Column) -> Column:
    angle = F.pmod(F.degrees(F.atan2(y, x)) + 22.5, F.lit(360.0))
    return F.floor(angle / 45.0).cast("int") % 8


def rotate(q: tuple[Column, Column, Column, Column], p: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """The point turned by the quaternion x, y, z, w."""
    x, y, z, w = q
    a, b, c = p
    return (
        (1 - 2 * (y * y + z * z)) * a + 2 * (x * y - z * w) * b + 2 * (x * z + y * w) * c,
        2 * (x * y + z * w) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z - x * w) * c,
        2 * (x * z - y * w) * a + 2 * (y * z + x * w) * b + (1 - 2 * (x * x + y * y)) * c,
    )


def yaw(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def back_project(u: Column, v: Column, depth_mm: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    z = depth_mm / 1000.0
    return F.struct(((u - cx) * z / fx).alias("x"), ((v - cy) * z / fy).alias("y"), z.alias("z"))


def patch_median(depths: Column) -> Column:
    """Median of the depths above 0 of a patch; null if there are none."""
    s = F.sort_array(F.filter(depths, lambda d: d > 0))
    n = F.size(s)
    mid = F.floor((n + 1) / 2).cast("int")
    return F.when(n > 0, (F.get(s, mid - 1) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)
