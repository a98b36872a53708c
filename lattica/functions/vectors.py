"""Row functions on arrays and points; all of them are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def sum_normalize(v: Column | str) -> Column:
    """v over its sum; a sum of 0 counts as EPS."""
    total = F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x)
    return _let(F.when(total == 0, EPS).otherwise(total), lambda t: F.transform(_doubles(v), lambda x: x / t))


def length_normalize(v: Column | str) -> Column:
    """v over its Euclidean length; a length of 0 counts as EPS."""
    size = F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))
    return _let(F.when(size == 0, EPS).otherwise(size), lambda t: F.transform(_doubles(v), lambda x: x / t))


def minmax_normalize(v: Column | str, *, constant: str = "nan") -> Column:
    """(v - min) / (max - min); all zeros stay; other constant rows become NaN, or 0 with constant="zero"."""
    flat = F.lit(float("nan") if constant == "nan" else 0.0)
    ends = F.struct(F.array_min(_doubles(v)).alias("lo"), F.array_max(_doubles(v)).alias("hi"))
    return _let(ends, lambda e: F.transform(_doubles(v), lambda x: F.when(e["hi"] > e["lo"], (x - e["lo"]) / F.when(e["hi"] > e["lo"], e["hi"] - e["lo"]).otherwise(1.0)).when(e["hi"] == 0, 0.0).otherwise(flat)))


def rotated(x: Column, y: Column, z: Column, axis: str, degrees: Column | float) -> tuple[Column, Column, Column]:
    """The point turned about an axis by the right-hand rule."""
    angle = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    c, s = F.cos(angle), F.sin(angle)
    if axis == "x":
        return x, y * c - z * s, y * s + z * c
    if axis == "y":
        return x * c + z * s, y, z * c - x * s
    if axis == "z":
        return x * c - y * s, x * s + y * c, z
    raise ValueError(f"axis is x, y or z, not {axis}")


def affine(i: Column, j: Column, k: Column, m: Column) -> tuple[Column, Column, Column]:
    """World coordinates of a voxel: rows 0 to 2 of the 4 x 4 matrix m (an array of rows) on (i, j, k, 1)."""
    return tuple(m[r][0] * i + m[r][1] * j + m[r][2] * k + m[r][3] for r in range(3))


def subject_of(path: Column, *, nested: bool = False) -> Column:
    """A subject's id: the last part of its path, or with nested its parts 4, 5 and 6 joined by _."""
    parts = F.split(path, "/")
    return F.concat_ws("_", F.get(parts, F.lit(4)), F.get(parts, F.lit(5)), F.get(parts, F.lit(6))) if nested else F.element_at(parts, -1)
