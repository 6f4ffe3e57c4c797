"""Vectors and results as text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def parse(text: Column, dim: int) -> Column:
    """array<float>; null if the count is wrong or a part is no number."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when((F.size(parts) == dim) & ~F.exists(parts, F.isnull), parts)


def parse_error(text: Column, dim: int) -> Column:
    """What is wrong with the text, or null."""
    parts = F.split(text, ",")
    bad = F.filter(F.transform(parts, lambda x, i: F.when(F.trim(x).try_cast("float").isNull(), i)), lambda i: i.isNotNull())
    count = F.concat(F.lit(f"vector dimension mismatch: expected {dim}, got "), F.size(parts).cast("string"))
    return F.when(F.size(parts) != dim, count).when(F.size(bad) > 0, F.concat(F.lit("invalid float at position "), F.get(bad, F.lit(0)).cast("string")))


def parse_one(text: str, dim: int) -> list[float]:
    parts = text.split(",")
    if len(parts) != dim:
        raise ValueError(f"vector dimension mismatch: expected {dim}, got {len(parts)}")
    out = []
    for i, x in enumerate(parts):
        try:
            out.append(float(x.strip()))
        except ValueError:
            raise ValueError(f"invalid float at position {i}: {x}") from None
    return out


@F.arrow_udf(StringType())
def _fixed(vectors: pa.Array) -> pa.Array:
    return pa.array([None if v is None else ",".join(["%.6f" % x for x in v if x is not None]) for v in vectors.to_pylist()], pa.string())


def formatted(vector: Column) -> Column:
    """Six decimals of the exact binary value, ties to the even digit, as C's printf; Java's rounds its shortest decimal form half up."""
    return _fixed(vector.cast("array<double>"))


def results_json(results, order: str = "rank"):
    """One row, column results: the hits (id, distance) of a result in order, as a JSON list."""
    hit = F.struct(order, "id", F.format_string('{"id": %d, "distance": %.6f}', F.col("id"), F.col("distance")).alias("j"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["j"]), ", ")
    return results.agg(F.concat(F.lit("["), joined, F.lit("]")).alias("results"))
