"""Language identification: multinomial naive Bayes over hashed character n-grams.

The characters (code points, lower-cased one by one) of a text give n-grams of 1 to 4, hashed into BUCKETS numbers.
Their counts by language, and the number of training texts of each language, are summed in Spark. The matrix of smoothed
log-probabilities is broadcast; each task scores a batch of texts as a sparse product: the entries of the matrix at the n-grams
that occur, summed by text and language, plus the log-prior of the language. Matrices are of at most BLOCK languages (a fixed
bound); with more languages the texts are scored once for each block, and the blocks' best sums are put together.

The score is the posterior of the prediction, with all sums divided by a temperature. It is fitted on a slice of the
training texts (at most CALIBRATION, by a hash of the text) that a model without that slice predicts: the one with the
least mean log-loss, where a right answer counts as (right + 1) / (texts + 2) of one. The counts of the slice are in the
final model.

A letter is a character of a Unicode category L. Nulls: a null or letterless text is `und` with score 0; rows without a
language are not learned from. An empty training set predicts `und`. Repeated rows count again. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

BITS, ORDERS = 16, (1, 2, 3, 4)
BUCKETS = 1 << BITS
#: Languages of one matrix (64 MB at most).
BLOCK = 256
#: One of so many training texts is in the slice for the temperature, and of these so many are looked at.
SLICE, CALIBRATION = 16, 4096
SMOOTHING = 0.5
TEMPERATURES = tuple(float(x) for x in np.geomspace(1, 1000, 61))


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    prior: np.ndarray
    temperature: float = 1.0

    def blocks(self, most: int) -> list[Model]:
        cut = [slice(i, i + most) for i in range(0, len(self.langs), most)]
        return [Model(self.langs[c], np.ascontiguousarray(self.logp[:, c]), self.prior[c], self.temperature) for c in cut]


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased code points of all texts one after another, and the offsets of each text (nulls are empty)."""
    raw, offsets = C.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), lead[offsets]


def grams(x: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of each n-gram of characters, by its first character (the last n - 1 have none)."""
    h = np.zeros(len(x), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: max(0, len(x) - n + 1)]
        h = (h ^ x[n - 1 : n - 1 + len(h)]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            yield (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def inside(offsets: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which n-grams of a buffer end in the text that they begin in."""
    out = np.ones(max(0, size - n + 1), bool)
    for k in range(1, n):
        at = offsets[1:] - k
        out[at[(at >= 0) & (at < len(out))]] = False
    return out


def text_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(characters, offsets, first text) of about CHUNK_BYTES each."""
    column = column.cast(pa.large_string())
    for i, j in C.chunks(C.utf8(column)[1]):
        yield *characters(column[i:j]), i


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", calibration: int = CALIBRATION) -> Model:
    """The model of all rows with a text and a language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bool], np.ndarray] = {}
        for b in batches:
            langs, part = np.array(b.column(0).to_pylist(), object), np.asarray(b.column(2))
            for x, offsets, first in text_chunks(b.column(1)):
                size = np.diff(offsets)
                code = {k: i for i, k in enumerate(sorted(set(zip(langs[first : first + len(size)].tolist(), part[first : first + len(size)].tolist(), strict=True))))}
                which = np.array([code[k] for k in zip(langs[first : first + len(size)].tolist(), part[first : first + len(size)].tolist(), strict=True)])
                of = np.repeat(which, size)
                sums = np.zeros((len(code), BUCKETS + 1), np.int64)
                for n, g in zip(ORDERS, grams(x), strict=True):
                    ok = inside(offsets, n, len(x))
                    for i in range(0, len(code), 16):  # the languages of a chunk, some at a time
                        own = ok & (of[: len(g)] >= i) & (of[: len(g)] < i + 16) if len(code) > 16 else ok
                        some = min(16, len(code) - i)
                        sums[i : i + some, :BUCKETS] += np.bincount((of[: len(g)][own] - i) * BUCKETS + g[own], minlength=some * BUCKETS).reshape(some, BUCKETS)
                sums[:, BUCKETS] = np.bincount(which, minlength=len(code))  # how many texts
                for k, i in code.items():
                    total[k] = total[k] + sums[i] if k in total else sums[i]
        for (lang, part), own in total.items():
            where = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(np.full(len(where), part)), pa.array(where.astype(np.int32)), pa.array(own[where])], names=["lang", "slice", "bucket", "n"])

    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), (F.pmod(F.xxhash64(text), F.lit(SLICE)) == 0).alias("slice")).where("lang is not null and text is not null")
    counts = slim.mapInArrow(work, "lang string, slice boolean, bucket int, n long").groupBy("lang", "slice", "bucket").agg(F.sum("n").alias("n"))
    counts = C.materialize(counts, "langid")
    langs = [r[0] for r in counts.where(F.col("bucket") == BUCKETS).select("lang").distinct().orderBy("lang").collect()]
    table = np.zeros((2, BUCKETS + 1, len(langs)))
    at = {x: k for k, x in enumerate(langs)}
    rows = counts.toArrow()
    table[np.asarray(rows["slice"].combine_chunks()).astype(int), rows["bucket"].to_numpy(), np.array([at[x] for x in rows["lang"].to_pylist()], int)] = rows["n"].to_numpy()
    final = of_counts(langs, table.sum(0))
    if len(langs) > 1 and table[1, BUCKETS].any() and table[0, BUCKETS].all():
        final.temperature = fitted(slim.where("slice"), of_counts(langs, table[0]), calibration)
    return final


def of_counts(langs: list[str], table: np.ndarray) -> Model:
    """The model of counts (buckets, then texts, x languages)."""
    grams_, texts = table[:BUCKETS] + SMOOTHING, table[BUCKETS] + SMOOTHING
    return Model(langs, np.log(grams_ / grams_.sum(0)).astype(np.float32), np.log(texts / texts.sum()))


def fitted(rows: DataFrame, model: Model, most: int) -> float:
    """The temperature with the least log-loss on at most so many rows (lang, text), the smallest by a hash of the text."""
    n = rows.count()
    few = rows.where(F.abs(F.xxhash64("text", F.lit(1))) <= F.lit(min((1 << 63) - 1, int((1 << 63) * (1.2 * most / n)))) if n > most else F.lit(True))
    few = few.select("lang", "text").orderBy(F.xxhash64("text", F.lit(1))).limit(most)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = totals(b.column(1), sent.value)
            lang = np.array([sent.value.langs.index(x) for x in b.column(0).to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(list(z), pa.list_(pa.float64()))], names=["lang", "z"])

    found = few.mapInArrow(work, "lang int, z array<double>").toArrow()
    sent.destroy()
    z, y = np.array(found["z"].to_pylist()), found["lang"].to_numpy()
    right = (z.argmax(1) == y).sum()
    target = (right + 1) / (len(y) + 2)

    def loss(t: float) -> float:
        p = z / t - (z / t).max(1, keepdims=True)
        p = np.exp(p) / np.exp(p).sum(1, keepdims=True)
        own, other = p[np.arange(len(y)), y], 1 - p[np.arange(len(y)), y]
        return -(target * np.log(np.maximum(own, 1e-300)) + (1 - target) * np.log(np.maximum(other, 1e-300))).mean()

    return min(TEMPERATURES, key=loss)


def totals(texts: pa.Array, model: Model) -> np.ndarray:
    """texts x languages: log-prior plus the log-probabilities of all n-grams."""
    out = np.tile(model.prior, (len(texts), 1))
    columns = [np.ascontiguousarray(c, np.float64) for c in model.logp.T]
    for x, offsets, first in text_chunks(texts):
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) + first
        for n, g in zip(ORDERS, grams(x), strict=True):
            ok = inside(offsets, n, len(x))
            g, doc = g[ok].astype(np.int64), of[: len(g)][ok]
            if len(g):
                begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                for k, column in enumerate(columns):
                    out[doc[begin], k] += np.add.reduceat(np.take(column, g), begin)
    return out


def lettered(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    blocks = model.blocks(block)
    several = len(blocks) > 1
    slim = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if several:
        slim = C.materialize(slim, "numbered")
    found = None
    for part in blocks or [model]:
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for b in batches:
                some = np.array([lettered(t) for t in b.column(2).to_pylist()], bool) & bool(model.langs)
                best, name, rest = np.full(len(some), -np.inf), np.full(len(some), "und", object), np.zeros(len(some))
                if some.any():
                    z = totals(b.column(2).filter(pa.array(some)), model) / model.temperature
                    best[some] = z.max(1)
                    name[some] = np.array(model.langs, object)[z.argmax(1)]
                    rest[some] = np.exp(z - z.max(1, keepdims=True)).sum(1)  # of the posterior's denominator, over e^best
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best), pa.array(rest), pa.array(name, pa.string())], names=["uid", "doc_id", "best", "rest", "lang"])

        one = slim.mapInArrow(work, "uid long, doc_id long, best double, rest double, lang string")
        if several:
            one = C.materialize(one, "language-block")
            sent.destroy()
        found = one if found is None else found.union(one)
    if several:
        found = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.max_by("lang", F.struct("best", "lang")).alias("lang"), F.collect_list(F.struct("best", "rest")).alias("b"), F.max("best").alias("best"))
        found = found.withColumn("rest", F.aggregate("b", F.lit(0.0), lambda s, x: s + F.when(x["rest"] > 0, x["rest"] * F.exp(x["best"] - F.col("best"))).otherwise(0.0)))
    return found.select("doc_id", F.col("lang").alias("lang_pred"), F.when(F.col("rest") > 0, 1 / F.col("rest")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows where `training` holds, predict every row."""
    return predict(docs, learn(docs.where(training), lang_col, text_col), id_col, text_col)
