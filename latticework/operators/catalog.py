"""Space names, index-type grammar, metric and engine rules."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions.metrics import METRICS

KEY_VALUE, VECTOR = "key-value", "vector"
BASES = ("Flat", "HNSW", "IVF", "PQ")
#: A space's name is a folder's name too: letters, digits, _ and -, no dots or slashes.
NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_-]{0,127}")


@dataclass
class Space:
    name: str
    engine_type: str = KEY_VALUE
    dimension: int = 0
    index_type: str = ""
    metric: str = ""
    enable_wal: bool = False

    def row(self) -> dict:
        return asdict(self)


def power_of_two(n: Column) -> Column:
    """A power of two from 2 to 256."""
    return F.coalesce((n >= 2) & (n <= 256) & (n.bitwiseAND(n - 1) == 0), F.lit(False))


def index_type_valid(index_type: Column) -> Column:
    """Comma-separated parts, trimmed: Flat alone, or HNSW, IVF, PQ with a power of two from 2 to 256;
    what follows the digits is ignored."""

    def part_valid(part: Column) -> Column:
        p = F.trim(part)
        base = F.regexp_extract(p, r"^([^0-9]*)", 1)
        digits = F.regexp_extract(p, r"^[^0-9]*([0-9]{1,9})", 1)
        size = F.when(digits != "", digits.cast("int"))
        rest = F.length(p) > F.length(base)
        return ((base == "Flat") & ~rest) | (base.isin("HNSW", "IVF", "PQ") & power_of_two(size))

    return F.forall(F.split(index_type, ","), part_valid)


def metric_valid(metric: Column) -> Column:
    return F.coalesce(metric.isin(*METRICS), F.lit(False))


def required_training(index_type: Column) -> Column:
    """As ann.required_training, for a column."""
    digits = F.regexp_extract(index_type, r"^IVF([0-9]{1,9})", 1)
    ivf = F.when(digits != "", digits.cast("int")).otherwise(0)
    pq = F.when(F.contains(index_type, F.lit("PQ")), 256).otherwise(0)
    return F.when(F.startswith(index_type, F.lit("HNSW")), 0).otherwise(F.greatest(ivf, pq))


def with_defaults(s: Space) -> Space:
    """An empty engine is key-value; an empty index of a vector space is Flat; the metric has no default."""
    engine = s.engine_type or KEY_VALUE
    return Space(s.name, engine, s.dimension, s.index_type or ("Flat" if engine == VECTOR else ""), s.metric, s.enable_wal)


def check_name(name: str) -> None:
    if not name:
        raise ValueError("space name is required")
    if not NAME.fullmatch(name):
        raise ValueError(f"invalid space name: {name}")


def check(s: Space, valid_index: bool) -> None:
    check_name(s.name)
    if s.engine_type not in (KEY_VALUE, VECTOR):
        raise ValueError(f"unknown engine type: {s.engine_type}")
    if s.engine_type == VECTOR:
        if not valid_index:
            raise ValueError(f"invalid index type: {s.index_type}")
        if s.metric not in METRICS:
            raise ValueError(f"invalid metric: {s.metric}")
