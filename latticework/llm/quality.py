"""A quality classifier as a sparse ensemble of rules.

Statistics of the whole text (shares of characters and words by kind, repetition, lengths) are computed
per document. Shallow boosted trees are grown on a sample of labelled rows; every path from a root gives a
conjunctive rule. A lasso logistic regression over the rules, and over the clipped statistics as linear terms, keeps few of them. The kept
rules compile to one Spark column expression that scores all documents inside the JVM.

The fit is on at most SAMPLE labelled rows, the smallest by a hash; that bound is a parameter.
Nulls: a null text is an empty text and gets its score; null ids are scored and never learned from; null
labels are left out. Repeated label rows of a document count once, by their largest value. With labels of one value or none, the score is
the share of label 1 (0.5 without labels). Other columns are kept by `with_score` and ignored elsewhere;
clashing names are safe, as the statistics stand in one struct column that is dropped again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

#: Labelled rows of a fit, and how many labels for each of them are looked up in the documents at most: some of their
#: documents may be missing or not to be learned from.
SAMPLE, CANDIDATES = 20_000, 4

STATS = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "mark", "bar", "stop", "newline", "high", "distinct", "adjacent", "longest")
KINDS = np.zeros((256, 9))
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~{}[]\\", b"!?", b"|", b".,;:", b"\n", bytes(range(128, 256)), b" \t\r\x0b\x0c")):
    KINDS[list(_bytes), _k] = 1


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATS of each text, in rows."""
    starts, ends, at = C.word_spans(raw, offsets)
    hashes = C.word_hashes(raw, starts, ends)
    out = np.zeros((len(offsets) - 1, len(STATS)))
    for k in range(len(out)):
        own = raw[offsets[k] : offsets[k + 1]]
        counts = np.bincount(own, minlength=256) @ KINDS
        n, words = len(own), hashes[at[k] : at[k + 1]]
        m = len(words)
        length = ends[at[k] : at[k + 1]] - starts[at[k] : at[k + 1]]
        solid = max(1, n - counts[8])
        out[k, :2] = np.log1p(n), np.log1p(m)
        out[k, 2] = length.mean() if m else 0
        out[k, 3:9] = counts[:6] / solid
        out[k, 9] = counts[6] / max(1, m)
        out[k, 10] = counts[7] / solid
        if m:
            out[k, 11] = len(np.unique(words)) / m ** 0.8
            out[k, 12] = (words[1:] == words[:-1]).mean() if m > 1 else 0
            out[k, 13] = min(1.0, length.max() / 200)
    return out


def stats_column(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{x} double" for x in STATS))
    def stats(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            raw, offsets = C.utf8(pa.array(texts, pa.large_string(), from_pandas=True))
            rows = [statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in C.chunks(offsets)]
            yield pd.DataFrame(np.concatenate([np.zeros((0, len(STATS))), *rows]), columns=STATS)

    return stats(F.coalesce(text.cast("string"), F.lit("")))


@dataclass
class Rule:
    """All of (statistic, upper bound?, threshold) hold."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, below, t in self.terms:
            out &= x[:, k] <= t if below else x[:, k] > t
        return out

    def column(self, stat) -> Column:
        out = F.lit(True)
        for k, below, t in self.terms:
            out = out & (stat(k) <= t if below else stat(k) > t)
        return out

    def __str__(self) -> str:
        return f"{self.weight:+.3f} if " + " and ".join(f"{STATS[k]} {'<=' if below else '>'} {t:.4g}" for k, below, t in self.terms)


@dataclass
class Model:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    linear: list[tuple[int, float, float, float, float]] = field(default_factory=list)  # statistic, weight, low, high, scale

    def column(self, stat) -> Column:
        z = F.lit(float(self.intercept))
        for r in self.rules:
            z = z + F.when(r.column(stat), float(r.weight)).otherwise(0.0)
        for k, w, low, high, scale in self.linear:
            z = z + F.least(F.greatest(stat(k), F.lit(low)), F.lit(high)) * (w / scale)
        return 1 / (1 + F.exp(-z))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r in self.rules:
            z += r.weight * r.holds(x)
        for k, w, low, high, scale in self.linear:
            z += np.clip(x[:, k], low, high) * (w / scale)
        return 1 / (1 + np.exp(-z))


def best_split(x: np.ndarray, g: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[float, int, float] | None:
    """The split with the largest gain of squared gradient sums."""
    best = None
    total, n = g.sum(), len(g)
    for k in range(x.shape[1]):
        if len(cuts[k]) == 0:
            continue
        slot = np.searchsorted(cuts[k], x[:, k], "left")
        many = np.cumsum(np.bincount(slot, minlength=len(cuts[k]) + 1))[:-1]
        sums = np.cumsum(np.bincount(slot, g, len(cuts[k]) + 1))[:-1]
        ok = (many >= least) & (n - many >= least)
        if ok.any():
            gain = np.where(ok, sums**2 / np.maximum(many, 1) + (total - sums) ** 2 / np.maximum(n - many, 1) - total**2 / n, -1)
            j = int(gain.argmax())
            if gain[j] > 1e-9 and (best is None or gain[j] > best[0]):
                best = float(gain[j]), k, float(cuts[k][j])
    return best


def grow(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, seed: int = 7) -> list[tuple]:
    """The paths of boosted trees, as tuples of terms; each tree sees half of the rows."""
    rng, paths = np.random.default_rng(seed), []
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64))) for k in range(x.shape[1])]
    z = np.full(len(x), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        some = rng.random(len(x)) < 0.5
        nodes = [((), np.ones(len(x), bool))]
        for level in range(depth):
            below = []
            for terms, mask in nodes:
                cut = best_split(x[mask & some], (y - p)[mask & some], cuts, 5) if (mask & some).sum() >= 10 else None
                if cut is None:
                    below.append((terms, mask))
                    continue
                _, k, t = cut
                left = x[:, k] <= t
                for side, part in ((True, mask & left), (False, mask & ~left)):
                    paths.append((*terms, (k, side, t)))
                    below.append((paths[-1], part))
            nodes = below
        for _, mask in nodes:
            if mask.any():
                h = (p * (1 - p))[mask].sum() + 1
                z[mask] += rate * np.clip((y - p)[mask].sum() / h, -3, 3)
    return list(dict.fromkeys(paths))


def lasso(design: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an absolute penalty, by accelerated proximal gradient steps."""
    n, m = design.shape
    v = np.ones(m)
    for _ in range(20):
        v = design.T @ (design @ v)
        size = np.linalg.norm(v)
        v /= max(size, 1e-12)
    rate = 1 / (0.25 * size / n + 0.25)
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    wy, by, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(design @ wy + by))) - y
        new = wy - rate * (design.T @ e) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = by - rate * e.mean()
        tn = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = new + (t - 1) / tn * (new - w), nb + (t - 1) / tn * (nb - b)
        w, b, t = new, nb, tn
    return b, w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.0015) -> Model:
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))))
    rules = [Rule(p) for p in grow(x, y)]
    held = np.stack([r.holds(x) for r in rules], axis=1) if rules else np.zeros((len(x), 0), bool)
    _, once = np.unique(held, axis=1, return_index=True)
    once = np.sort(once[(held[:, once].mean(0) > 0) & (held[:, once].mean(0) < 1)])
    rules, held = [rules[k] for k in once], held[:, once]
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    spread = np.clip(x, low, high).std(0)
    use = np.flatnonzero(spread > 1e-9)
    scale = spread[use] / 0.4
    design = np.hstack([held.astype(float), np.clip(x, low, high)[:, use] / scale])
    b, w = lasso(design, y, penalty)
    for r, v in zip(rules, w, strict=False):
        r.weight = float(v)
    linear = [(int(k), float(v), float(low[k]), float(high[k]), float(s)) for k, v, s in zip(use, w[len(rules) :], scale, strict=True) if v]
    return Model(float(b), [r for r in rules if r.weight], linear)


def candidates(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, y) of the labels 0 and 1, each id once; of more than CANDIDATES * sample about so many, the smallest by a hash
    of the id. Written, and small enough for a broadcast."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    marks = C.materialize(marks, "labels")
    n, most = marks.count(), CANDIDATES * sample
    return marks if n <= most else marks.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < F.lit(int((1 << 63) * (most / n))))


def learn(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """The model from (doc_id, st) and labels, both restricted by the caller to what may be learned from. Of more labelled
    rows than `sample` those with the smallest hashes are taken. A threshold on the hash leaves about half as many again
    before they are sorted, so what reaches the driver does not grow with the tables."""
    marks = candidates(labels, label_col, id_col, sample)
    rows = C.materialize(stats.select("doc_id", "st").join(F.broadcast(marks), "doc_id").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "st"), 1)), "labelled")
    n = rows.count()
    if n > 1.5 * sample:
        rows = rows.where(F.col("h") < F.lit(int((1 << 63) * (1.5 * sample / n))))
    rows = rows.orderBy("h", "doc_id").limit(sample).select("doc_id", "y", "st.*").toPandas()
    rows = rows.sort_values(["doc_id", *STATS])  # the same fit whatever order the rows came in
    return fit(rows[list(STATS)].to_numpy(float), rows["y"].to_numpy(float))


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, st) of every row, written to the shared folder."""
    return C.materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), stats_column(F.col(text_col)).alias("st")), "statistics")


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from (doc_id, st)."""
    return stats.select("doc_id", model.column(lambda k: F.col("st")[STATS[k]]).alias("score"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, whose score reaches the threshold."""
    st = f"st_{uuid.uuid4().hex}"
    scored = docs.withColumn(st, stats_column(F.col(text_col)))
    return scored.where(model.column(lambda k: F.col(st)[STATS[k]]) >= threshold).drop(st)
