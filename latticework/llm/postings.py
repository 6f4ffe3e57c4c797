"""Benchmark decontamination by a distributed positional inverted index.

The index is stored by document shards: a row holds, for a run of training documents, the sorted hashes
of their words and for each word the ascending positions at which it stands, so a shard answers any
phrase by itself and postings are never shuffled; a word that is everywhere is split over the shards.
A phrase is matched in a shard from its rarest word: its positions, moved by their offset in the phrase,
are intersected with the lists of the other words, rarest first; a phrase with an absent word costs one
look-up. Proximity matches (all words within a span, in any order) use the same lists. The different windows are
numbered and sent to the shards in blocks of at most WINDOWS, so what is broadcast has a fixed bound; the items that
have a window, which may be very many, are joined to the numbers of the windows that were found.

Words are compared by 64-bit hashes and each exact phrase match by those of all its words. Nulls: a null
text has no words; a null doc_id keeps its row; items with a null item_id are matched but not listed.
Repeated rows of documents are judged each by itself, repeated item_ids are one item. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

#: Bytes of text of one shard.
SHARD_BYTES = 4 << 20
#: Windows of one broadcast block, each a number and at most `width` 8-byte hashes.
WINDOWS = 100_000

#: Bytes that separate words: ASCII but for digits and letters.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:128] = True
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = False

INDEX = "shard long, doc_ids binary, nulls binary, first binary, terms binary, begin binary, positions binary"


def hashed_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and for each text the index of its first word (one more at the end)."""
    starts, ends, at = C.word_spans(raw, offsets, NOT_WORD)
    return C.word_hashes(C.LOWER[raw], starts, ends), at


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all documents, one row for each shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            raw, offsets = C.utf8(b.column(1))
            for i, j in C.chunks(offsets, SHARD_BYTES):
                words, at = hashed_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                order = np.argsort(words, kind="stable").astype(np.uint32)
                ordered = words[order]
                begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
                ids = b.column(0)[i:j]
                row = (shard, ids.fill_null(0).to_numpy().tobytes(), np.asarray(ids.is_null()).tobytes(), at.astype(np.uint32).tobytes(), ordered[begin].tobytes(), np.append(begin, len(words)).astype(np.uint32).tobytes(), order.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=[x.split()[0] for x in INDEX.split(", ")])
                shard += 1

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return C.materialize(slim.mapInArrow(work, INDEX), "postings")


def windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window): each different window of each item as word hashes (binary). Items of fewer
    words, but not none, are one window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = hashed_words(*C.utf8(b.column(1)))
            ids, out = b.column(0).to_pylist(), []
            for k, item in enumerate(ids):
                own = words[at[k] : at[k + 1]]
                out += [(item, own[i : i + width].tobytes()) for i in range(max(1, len(own) - width + 1)) if len(own)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.binary())], names=["item_id", "window"])

    slim = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(work, "item_id string, window binary").distinct()


class Shard:
    """One row of the index."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.first = np.frombuffer(row["first"], np.uint32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.begin = np.frombuffer(row["begin"], np.uint32)
        self.positions = np.frombuffer(row["positions"], np.uint32)

    def lists(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the range of its positions; empty if it is absent."""
        if not len(self.terms):
            return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        k = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        there = self.terms[k] == words
        return np.where(there, self.begin[k], 0).astype(np.int64), np.where(there, self.begin[k + 1], 0).astype(np.int64)

    def phrase(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Positions at which words with these lists stand one after another in one document."""
        order = np.argsort(hi - lo, kind="stable")
        found = self.positions[lo[order[0]] : hi[order[0]]].astype(np.int64) - order[0]
        found = found[found >= 0]
        for k in order[1:]:
            if not len(found):
                return found
            own = self.positions[lo[k] : hi[k]]
            at = np.minimum(np.searchsorted(own, found + k), len(own) - 1)
            found = found[own[at] == found + k]
        doc = np.searchsorted(self.first, found, "right") - 1
        return found[found + len(lo) <= self.first[doc + 1]]

    def near(self, lo: np.ndarray, hi: np.ndarray, span: int) -> np.ndarray:
        """Positions p of the rarest word such that every word stands within span - 1 words of p in its document."""
        order = np.argsort(hi - lo, kind="stable")
        found = self.positions[lo[order[0]] : hi[order[0]]].astype(np.int64)
        doc = np.searchsorted(self.first, found, "right") - 1
        left, right = np.maximum(found - span + 1, self.first[doc]), np.minimum(found + span, self.first[doc + 1])
        for k in order[1:]:
            own = self.positions[lo[k] : hi[k]]
            ok = np.searchsorted(own, right) > np.searchsorted(own, left)
            found, left, right = found[ok], left[ok], right[ok]
        return found


#: Sorted intervals v of words, those that overlap or touch made one.
MERGED = """aggregate(v, cast(array() as array<array<bigint>>), (a, x) -> if(size(a) = 0 or x[0] > a[size(a) - 1][1], concat(a, array(x)),
    concat(slice(a, 1, size(a) - 1), array(array(a[size(a) - 1][0], greatest(a[size(a) - 1][1], x[1]))))))"""


def search(index: DataFrame, wanted: DataFrame, span: int | None = None) -> DataFrame:
    """(shard, row, doc_id, n_words, intervals, items): for every indexed document the merged intervals of
    words inside occurrences of the windows (item_id, window), and the items that occur. With a span,
    proximity matches instead of phrases: the rarest word of each window is the interval."""
    spark = index.sparkSession
    wanted = C.materialize(wanted.select("window", "item_id"), "test-windows")
    numbered = C.materialize(wanted.select("window").distinct().withColumn("number", F.monotonically_increasing_id()), "numbered-windows")
    blocks = max(1, -(-numbered.count() // WINDOWS))
    schema = "shard long, row int, doc_id long, n_words long, intervals array<array<long>>, windows array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]
    out = None
    for block in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).toArrow()
        held = rows["window"].to_pylist()
        size = np.array([len(w) // 8 for w in held], np.int64)
        every = np.frombuffer(b"".join(held), np.uint64)
        sent = spark.sparkContext.broadcast((rows["number"].to_numpy(), every, size))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            numbers, every, size = sent.value
            edge = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
            for b in batches:
                for r in range(b.num_rows):
                    row = b.slice(r, 1).to_pylist()[0]
                    s = Shard(row)
                    lo, hi = s.lists(every)
                    least = np.minimum.reduceat(hi - lo, edge[:-1]) if len(every) else np.zeros(0)
                    hit: list[tuple[np.ndarray, int]] = []
                    windows: dict[int, list[int]] = {}
                    for k in np.flatnonzero(least > 0):
                        a, z = int(edge[k]), int(edge[k + 1])
                        found = s.phrase(lo[a:z], hi[a:z]) if span is None else s.near(lo[a:z], hi[a:z], span)
                        if len(found):
                            hit.append((found, z - a if span is None else 1))
                            for d in np.unique(np.searchsorted(s.first, found, "right") - 1).tolist():
                                windows.setdefault(d, []).append(int(numbers[k]))
                    inside = np.zeros(s.first[-1] + 1, np.int32)
                    for found, width in hit:
                        np.add.at(inside, found, 1)
                        np.add.at(inside, found + width, -1)
                    covered = np.concatenate(([0], (np.cumsum(inside[:-1]) > 0).astype(np.int8), [0]))
                    spans: dict[int, list[list[int]]] = {}
                    for d in windows:
                        a, z = s.first[d], s.first[d + 1]
                        own = np.concatenate(([0], covered[a + 1 : z + 1], [0]))
                        turn = np.flatnonzero(np.diff(own))
                        spans[d] = turn.reshape(-1, 2).tolist()
                    n = len(s.ids)
                    columns = ([row["shard"]] * n, range(n), pa.array(s.ids, mask=s.nulls), np.diff(s.first), [spans.get(d, []) for d in range(n)], [windows.get(d, []) for d in range(n)])
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

        found = C.materialize(index.mapInArrow(work, schema), "found-windows")
        sent.destroy()
        out = found if out is None else out.union(found)
    if blocks > 1:
        flat = out.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("intervals"))).alias("v"), F.flatten(F.collect_list("windows")).alias("windows"))
        out = flat.select("shard", "row", "doc_id", "n_words", F.expr(MERGED).alias("intervals"), "windows")
    of = wanted.where("item_id is not null").join(numbered, "window").select("number", "item_id")
    hits = out.select("shard", "row", F.explode("windows").alias("number"))
    items = hits.join(C.small(C.materialize(of, "items-of-windows")), "number").groupBy("shard", "row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return out.join(C.small(C.materialize(items, "items-found")), ["shard", "row"], "left").select("shard", "row", "doc_id", "n_words", "intervals", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, intervals, items): every document, with what of it stands in the test items."""
    found = search(build_index(docs, id_col, text_col), windows(items, width))
    n_hit = F.aggregate("intervals", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "intervals", "items")
