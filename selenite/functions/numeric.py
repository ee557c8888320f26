"""Column functions on numbers: units, ratios, angles, formulas, flags, consensus of several predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanometres of a unit; origins and coefficients of the published iron formulas.
NANOMETRES = {"nm": 1.0, "nanometer": 1.0, "nanometers": 1.0, "um": 1000.0, "µm": 1000.0, "micron": 1000.0, "microns": 1000.0, "micrometer": 1000.0, "micrometers": 1000.0, "angstrom": 0.1, "angstroms": 0.1}
ANGLE_STANDARD = {"x0": 0.08, "y0": 1.19, "scale": 17.427, "offset": -7.565}
ANGLE_MEAN = {"x0": 0.08, "y0": 1.18, "scale": 12.92, "offset": -2.107, "power_scale": 10.59, "power": 1.209}
ANGLE_CHANGED = {"x0": 0.03433418510481713, "y0": 1.2571662682003644, "scale": 6.274305964663926, "offset": 9.740661344354981}
FLAGS = {"invalid": 1, "physical_range": 2, "outside_training": 4, "distance": 8, "negative": 16, "excessive": 32, "disagreement": 64}


def to_nanometres(value: Column, unit: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in NANOMETRES.items() for x in pair))
    factor = F.element_at(table, F.lower(F.trim(unit)))
    return F.when(factor.isNotNull(), value * factor).otherwise(F.raise_error(F.concat(F.lit("unknown unit: "), F.coalesce(unit, F.lit("NULL")))).cast("double"))


def safe_ratio(n: Column, d: Column, floor: float = 1e-12) -> Column:
    """n / d, null where d is nearer to 0 than floor or the ratio isn't finite."""
    ratio = F.when(F.abs(d) >= floor, n / d)
    return F.when(F.abs(ratio) < float("inf"), ratio)


def both_ratios(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """struct(ab, ba): the ratio in both directions, each null where its denominator is too near to 0."""
    return F.struct(safe_ratio(a, b, floor).alias("ab"), safe_ratio(b, a, floor).alias("ba"))


def general_format(c: Column, digits: int = 6) -> Column:
    """A number as C's %.{digits}g writes it: significant digits without trailing zeros, an exponent if it is below -4 or too large.

    Ties of the shortest decimal form go up, where C would round the binary value."""
    plain = F.format_string(f"%.{digits - 1}e", c.cast("double"))
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    figures = F.regexp_replace(F.regexp_replace(plain, "e.*$", ""), "[-.]", "")
    power = F.regexp_extract(plain, "e(.*)$", 1).cast("int")
    point = lambda whole, rest: F.regexp_replace(F.concat(whole, F.lit("."), rest), r"\.?0*$", "")
    fixed = F.when(power >= 0, point(F.substring(figures, F.lit(1), power + 1), F.substring(figures, power + 2, F.lit(digits)))).otherwise(point(F.lit("0"), F.concat(F.repeat(F.lit("0"), -power - 1), figures)))
    wide = F.concat(point(F.substring(figures, 1, 1), F.substring(figures, 2, digits)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return F.when(c.isNotNull(), F.when((power < -4) | (power >= digits), F.concat(sign, wide)).otherwise(F.concat(sign, fixed)))


def utc_stamp(at: Column | None = None) -> Column:
    """A time (now, unless given) as ISO text in UTC to the second."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def principal_angle(x: Column, y: Column, x0: float, y0: float) -> Column:
    dx, dy = x - x0, y - y0
    upright = F.when(-dy < 0, F.lit(-math.pi / 2)).otherwise(F.lit(math.pi / 2))
    return F.when(F.abs(dx) < 1e-15, upright).otherwise(-F.atan(dy / dx))


def full_angle(x: Column, y: Column, x0: float, y0: float) -> Column:
    """The quadrant-aware angle, from 0 to twice pi."""
    return F.pmod(-F.atan2(y - y0, x - x0), F.lit(2 * math.pi))


def linear_iron(angle: Column, formula: dict[str, float] = ANGLE_STANDARD) -> Column:
    return formula["scale"] * angle + formula["offset"]


def power_iron(angle: Column, formula: dict[str, float] = ANGLE_MEAN) -> Column:
    """Undefined (null) for negative angles."""
    return F.when(angle >= 0, formula["power_scale"] * F.pow(angle, F.lit(formula["power"])))


def iron_baselines(x: Column, far: Column, mean_x: Column, mean_far: Column) -> Column:
    """struct of the eight published formulas: three origins, each angle principal and full, the mean one linear and as a power.

    x and far are the reflectances at the near and the far band, the mean ones those averaged over their neighbours.
    """
    out = {}
    for name, near, ratio, formula in (("standard", x, safe_ratio(far, x), ANGLE_STANDARD), ("changed", x, safe_ratio(far, x), ANGLE_CHANGED), ("mean", mean_x, safe_ratio(mean_far, mean_x), ANGLE_MEAN)):
        angles = {"principal": principal_angle(near, ratio, formula["x0"], formula["y0"]), "full": full_angle(near, ratio, formula["x0"], formula["y0"])}
        for kind, angle in angles.items():
            out[f"{name}_{kind}"] = linear_iron(angle, formula)
            if "power" in formula:
                out[f"{name}_power_{kind}"] = power_iron(angle, formula)
    return F.struct(*(c.alias(n) for n, c in out.items()))


def interpolated(xs: Column, ys: Column, at: Column) -> Column:
    """The linear value at a point of the knots (xs rising, ys), constant beyond the ends; null without knots."""
    i = F.size(F.filter(xs, lambda x: x <= at))
    x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    return F.when(F.size(xs) == 0, F.lit(None)).when(i == 0, F.get(ys, F.lit(0))).when(i == F.size(xs), F.get(ys, i - 1)).otherwise(y0 + (at - x0) / (x1 - x0) * (y1 - y0))


def flag_mask(**conditions: Column) -> Column:
    """The sum of the bits of the flags whose conditions hold; null conditions don't."""
    mask = F.lit(0)
    for name, condition in conditions.items():
        mask = mask.bitwiseOR(F.when(condition, F.lit(FLAGS[name])).otherwise(F.lit(0)))
    return mask


def has_flag(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(FLAGS[name])) != 0


def consensus(columns: Sequence[Column]) -> Column:
    """struct(mean, median, sd, least, most) of the finite values of a row; sd has one degree of freedom less."""
    values = F.array_sort(F.filter(F.array(*(c.cast("double") for c in columns)), lambda v: v.isNotNull() & ~F.isnan(v)))
    n = F.size(values)
    mean = F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n)
    square = F.aggregate(F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    half = F.floor((n - 1) / 2).cast("int")
    median = F.when(n > 0, (F.get(values, half) + F.get(values, F.floor(n / 2).cast("int"))) / 2)
    return F.struct(mean.alias("mean"), median.alias("median"), F.when(n > 1, F.sqrt(square / (n - 1))).alias("sd"), F.array_min(values).alias("least"), F.array_max(values).alias("most"))


def suitability(least: Column, most: Column, need_least: float, need_most: float, long_from: float = 1200.0) -> Column:
    """The class of a covered interval against the one needed; the order of the cases matters."""
    late, early = least > need_least, most < need_most
    return (
        F.when(least.isNull() | most.isNull(), "missing").when(~late & ~early, "full").when(least >= long_from, "long_only")
        .when(late & early, "partial_both").when(late, "starts_late").otherwise("ends_early")
    )


def standard_geometry(incidence: Column, emission: Column, phase: Column, tolerance: float = 0.01) -> Column:
    """Incidence 30, emission 0, phase 30 degrees within the tolerance; nulls are not standard."""
    return F.coalesce((F.abs(incidence - 30) <= tolerance) & (F.abs(emission) <= tolerance) & (F.abs(phase - 30) <= tolerance), F.lit(False))
