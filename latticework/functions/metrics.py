"""The eight distance metrics as column expressions over arrays, and the same in DuckDB SQL.

Elements are widened to double and folded from left to right. L2 has no root; Lp has no root and p = 0
unless given. A ratio with denominator zero is NaN. InnerProduct is a similarity: larger is nearer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names that a space may use.
METRICS = ("L2", "InnerProduct", "L1", "Lp", "Canberra", "BrayCurtis", "JensenShannon", "Linf")

NAN = float("nan")


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, t: s + t)


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(NAN)).otherwise(top / F.nullif(bottom, F.lit(0.0)))


def share(x: Column, m: Column) -> Column:
    """-x ln(m / x); undefined for x <= 0."""
    return F.when((x > 0) & (m > 0), -x * F.ln(m / F.nullif(x, F.lit(0.0)))).otherwise(F.lit(NAN))


def distance(metric: str, a: Column, b: Column, p: float = 0.0) -> Column:
    a, b = doubles(a), doubles(b)
    if metric == "L2":
        return fold(a, b, lambda x, y: (x - y) * (x - y))
    if metric == "InnerProduct":
        return fold(a, b, lambda x, y: x * y)
    if metric == "L1":
        return fold(a, b, lambda x, y: F.abs(x - y))
    if metric == "Linf":
        return F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0))
    if metric == "Lp":
        return fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))
    if metric == "Canberra":
        return fold(a, b, lambda x, y: ratio(F.abs(x - y), F.abs(x) + F.abs(y)))
    if metric == "BrayCurtis":
        return ratio(fold(a, b, lambda x, y: F.abs(x - y)), fold(a, b, lambda x, y: F.abs(x + y)))
    if metric == "JensenShannon":
        return 0.5 * fold(a, b, lambda x, y: share(x, 0.5 * (x + y)) + share(y, 0.5 * (x + y)))
    raise ValueError(f"invalid metric: {metric}")


def similarity(metric: str) -> bool:
    return metric == "InnerProduct"


def nearest_first(metric: str, dist: Column) -> Column:
    """Sort key: NaN comes last."""
    worst = F.isnan(dist)
    return F.when(worst, F.lit(float("inf"))).otherwise(-dist if similarity(metric) else dist)


def within(metric: str, dist: Column, radius: float) -> Column:
    return (~F.isnan(dist)) & ((dist > radius) if similarity(metric) else (dist < radius))


#: The term of each metric's sum over z[1] and z[2], in DuckDB SQL.
TERMS = {
    "L2": "(z[1]-z[2])*(z[1]-z[2])", "InnerProduct": "z[1]*z[2]", "L1": "abs(z[1]-z[2])", "Lp": "pow(abs(z[1]-z[2]), 0.0)",
    "Canberra": "case when abs(z[1])+abs(z[2])=0 then 'nan'::double else abs(z[1]-z[2])/(abs(z[1])+abs(z[2])) end",
    "JensenShannon": "-z[1]*ln(0.5*(z[1]+z[2])/z[1]) - z[2]*ln(0.5*(z[1]+z[2])/z[2])",
}


def sql(metric: str, a: str, b: str) -> str:
    """DuckDB SQL of the distance of two DOUBLE[] expressions."""
    total = lambda term: f"list_reduce(list_prepend(0.0::double, list_transform(list_zip({a},{b}), lambda z: {term})), lambda s, t: s + t)"
    if metric == "Linf":
        return f"list_max(list_transform(list_zip({a},{b}), lambda z: abs(z[1]-z[2])))"
    if metric == "BrayCurtis":
        return f"({total('abs(z[1]-z[2])')} / {total('abs(z[1]+z[2])')})"
    return f"(0.5*{total(TERMS[metric])})" if metric == "JensenShannon" else total(TERMS[metric])
