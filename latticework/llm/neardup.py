"""Near-duplicates of five-word shingles: SimHash links and MinHash cells give candidates, an exact Jaccard check decides.

The shingles of a text are its different runs of five words (A-Z lowered; shorter texts are one shingle). Two
texts are linked if their sets have a Jaccard similarity of at least 0.8. The SimHash operator finds those whose 64-bit
fingerprints over these shingles differ in at most 3 bits. It cannot find all: at 0.8 they differ in about 10 bits,
give or take 3, where popcounts of segments hold no pair back. So each different text also goes into 28 cells, each of
4 minima of its shingles; a linked pair shares no cell with probability (1 - 0.8^4)^28 = 4e-7 at most. Texts that
share cells or fingerprint components, directly or by others, form a block; inside a block every pair in different
components is compared by its whole sets. A block that is too large for one task is split into sub-blocks for each pair
of its parts.

A text is known by its 64-bit hash, so rows with null or repeated ids are judged like all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C
from latticework.llm import simhash

SHINGLE, CELLS, MINIMA = 5, 28, 4
#: The similarity of a link, as a ratio of whole numbers.
LEAST = (4, 5)
#: Texts and shingles of one part of a block; two parts meet in one task.
PART_TEXTS, PART_SHINGLES = 1024, 1 << 20
#: Candidates that a broadcast may hold (16 bytes each); more are joined.
CANDIDATES = 4 << 20
FACTORS = np.random.default_rng(51).integers(0, 1 << 63, CELLS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_hash(text_col: str = "text") -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one text after another, and the first of each (one more at the end)."""
    low = C.LOWER[raw]
    starts, ends, at = C.word_spans(low, offsets)
    w = C.word_hashes(low, starts, ends)
    words = np.diff(at)
    count = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    begin = np.repeat(at[:-1] - first[:-1], count) + np.arange(first[-1])
    width = np.repeat(np.minimum(words, SHINGLE), count)
    h, p = np.zeros(len(begin), np.uint64), C.powers(SHINGLE)
    for k in range(SHINGLE):
        use = width > k
        h[use] += w[begin[use] + k] * p[k]
    return C.mix(h + width.astype(np.uint64)), first


def cells_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """texts x CELLS: the cells of each text. Texts without words share theirs."""
    out = np.zeros((len(first) - 1, CELLS), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for i in range(CELLS):
            key = np.full(len(some), i + 1, np.uint64)
            for f in FACTORS[i * MINIMA : (i + 1) * MINIMA]:
                key = C.mix(key * np.uint64(C.BASE) + np.minimum.reduceat(h * f, first[some]))
            out[some, i] = key
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, doc_id, cells, fp) of each row; node is the hash of the text, fp its fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = C.utf8(b.column(2))
            parts, fps = [np.zeros((0, CELLS), np.uint64)], [np.zeros(0, np.uint64)]
            for i, j in C.chunks(offsets):
                h, first = shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append(cells_of(h, first))
                fps.append(simhash.majority(h, first))
            flat = np.concatenate(parts).view(np.int64).ravel()
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, CELLS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cells, pa.array(np.concatenate(fps).view(np.int64))], names=["node", "doc_id", "cells", "fp"])

    slim = docs.select(text_hash(text_col).alias("node"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(work, "node long, doc_id long, cells array<long>, fp long")


def shingle_sets(docs: DataFrame, candidates: DataFrame, text_col: str) -> DataFrame:
    """(node, root, hashes) of each different text among the candidates (node, root); hashes are sorted."""
    slim = docs.select(text_hash(text_col).alias("node"), F.col(text_col).cast("string").alias("text"))
    sent = None
    if candidates.count() <= CANDIDATES:  # their texts are picked out where they are read
        rows = candidates.select("node", "root").toArrow().sort_by("node")
        sent = docs.sparkSession.sparkContext.broadcast((rows["node"].to_numpy(), rows["root"].to_numpy()))
        slim = slim.select("node", F.lit(None).cast("long").alias("root"), "text")
    else:
        slim = slim.join(candidates, "node").select("node", "root", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            there, roots = np.arange(len(own)), b.column(1)
            if sent is not None:
                nodes, of = sent.value
                at = np.minimum(np.searchsorted(nodes, own), max(0, len(nodes) - 1))
                there = np.flatnonzero(nodes[at] == own) if len(nodes) else np.zeros(0, np.int64)
                roots = pa.array(of[at]) if len(nodes) else roots
            raw, offsets = C.utf8(b.column(2).take(pa.array(there)))
            for i, j in C.chunks(offsets):
                h, first = shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sets = [np.unique(h[a:z]).view(np.int64) for a, z in zip(first[:-1], first[1:], strict=True)]
                size = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                rows = pa.array(there[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), roots.take(rows), hashes], names=["node", "root", "hashes"])

    found = slim.mapInArrow(work, "node long, root long, hashes array<long>")
    found = C.materialize(found.dropDuplicates(["node"]), "shingle-sets")
    if sent is not None:
        sent.destroy()
    return found


def block_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span each component of the sets whose Jaccard similarity is at least LEAST."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, label, out = np.zeros(int(codes.max(initial=-1)) + 1, np.int32), np.arange(n), []
    top, bottom = LEAST
    for i in range(n - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])  # pairs that are connected already need no link
        j = j[(bottom * np.minimum(size[j], size[i]) >= top * np.maximum(size[j], size[i]))]
        if not len(j):
            continue
        mark[codes[first[i] : first[i + 1]]] = 1
        edge = np.concatenate(([0], np.cumsum(size[j])))
        at = np.repeat(first[j] - edge[:-1], size[j]) + np.arange(edge[-1])
        total = np.concatenate(([0], np.cumsum(mark[codes[at]], dtype=np.int64)))
        common = total[edge[1:]] - total[edge[:-1]]
        mark[codes[first[i] : first[i + 1]]] = 0
        for x in j[bottom * common >= top * (size[i] + size[j] - common)].tolist():
            if label[x] != label[i]:
                out.append((i, x))
                label[label == label[x]] = label[i]
    return out


def links(sets: DataFrame) -> DataFrame:
    """(u, v), u > v: links whose components are those of all similar pairs of a block (node, root, hashes)."""
    weight = F.greatest(F.count(F.lit(1)) / PART_TEXTS, F.sum(F.size("hashes")) / PART_SHINGLES)
    large = C.materialize(sets.groupBy("root").agg(F.ceil(weight).cast("int").alias("parts")).where("parts > 1"), "large-blocks")
    keyed = sets.withColumn("key", F.col("root"))
    if not large.isEmpty():
        keyed = sets.join(large, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        keyed = keyed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keyed = keyed.withColumn("key", F.when(F.col("parts") == 1, F.col("root")).otherwise(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            found = block_links(sets) if len(sets) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["u", "v"])

        for b in batches:
            size = b.column(2).offsets.to_numpy()
            hashes = b.column(2).values.to_numpy()
            for r, (k, node) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k != key:
                    yield from out()
                    key, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(hashes[size[r] : size[r + 1]].copy())
        yield from out()

    found = keyed.select("key", "node", "hashes").repartition("key").sortWithinPartitions("key", "node").mapInArrow(work, "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def candidate_blocks(nodes: DataFrame) -> DataFrame:
    """(node, root) of the texts (node, cells, fp) that share a cell or a fingerprint component with another, directly or by
    others."""
    total = CELLS * nodes.count()
    cells = nodes.select("node", F.posexplode("cells").alias("i", "c")).select("node", F.xxhash64("i", "c").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most").select("cell", "least", "n")
    near = C.join_counted(cells, C.materialize(shared, "shared-cells"), "cell", "n", total).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    linked = simhash.components(simhash.links(nodes.select("fp").distinct()))
    rooted = nodes.select("node", "fp").join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("fp"))
    rooted = C.materialize(rooted, "fingerprint-classes")
    alike = C.materialize(rooted.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-fingerprints")
    close = C.join_counted(rooted, alike, "fp", "n", total // CELLS).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    blocks = simhash.components(near.union(close).distinct())
    return C.materialize(blocks.union(blocks.select(F.col("root").alias("node"), "root")).distinct(), "minhash-blocks")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, doc_id, n, component, first): the different pairs of text hash and id, the number of their rows, the smallest
    text hash of their component, and whether they are the component's first by id (nulls last) and text hash."""
    rows = C.materialize(signatures(docs, id_col, text_col), "minhash")
    nodes = C.materialize(rows.dropDuplicates(["node"]).select("node", "cells", "fp"), "minhash-nodes")
    found = simhash.components(links(shingle_sets(docs, candidate_blocks(nodes), text_col)))
    pairs = C.materialize(rows.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n")), "minhash-pairs")
    C.discard(rows)
    total = pairs.count()
    many = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("ids"))
    of = C.materialize(many.join(found, "node", "left").select("node", "ids", F.coalesce("root", "node").alias("component")), "minhash-components")
    pairs = C.materialize(C.join_counted(pairs, of, "node", "ids", total).select("node", "doc_id", "n", "component"), "minhash-classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = C.materialize(pairs.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("ids")), "minhash-first")
    first = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.node") == F.col("node"))
    return C.join_counted(pairs, best, "component", "ids", total).select("node", "doc_id", "n", "component", first.alias("first"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their component; of rows equal in id and text one stays."""
    judged = C.materialize(classes(docs, id_col, text_col), "near-duplicates")
    marked = docs.withColumn("_node", text_hash(text_col))
    gone = judged.where("not first").select(F.col("node").alias("_gone"), F.col("doc_id").alias("_id"))
    kept = marked.join(gone, (F.col("_node") == F.col("_gone")) & F.col(id_col).cast("long").eqNullSafe(F.col("_id")), "left_anti")
    if not judged.where("first and n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "_node"])
    return kept.drop("_node")
