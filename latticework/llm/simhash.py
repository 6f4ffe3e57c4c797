"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to its per-segment bit counts (32 segments of 2 bits). The Manhattan
distance of two such vectors is a lower bound of the Hamming distance of the fingerprints, so
fingerprints that link (at most 3 bits) lie within Manhattan distance 3, and differ in at most 3 of the
6 groups that the segments form. Each fingerprint goes into the 20 grid cells that fix the counts of 3
groups (about 24 bits of each); every linked pair meets in at least one cell. Inside every cell the Manhattan
bound is tested first, then what is left by the exact Hamming distance. A cell gives a spanning forest of its
links, never all pairs; a cell of very many different fingerprints is split into sub-cells for each pair of its parts.

Nulls: a null text has no words, so fingerprint zero; a null doc_id keeps its row, and component_id is
the smallest non-null doc_id of its component (null if there is none). Repeated rows are kept. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

#: Bits of a segment, and how many segments (from the lowest) each of the six groups has.
SEGMENT, GROUPS = 2, (6, 6, 5, 5, 5, 5)
#: Different fingerprints of one cell that one task compares; larger cells are split.
CELL_LIMIT = 8192
#: Cells up to this size are compared many at a time, larger ones one by one; the tests are the same.
SMALL_CELL = 48
ODD = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks() -> list[int]:
    """For each choice of three groups the bits of their segments."""
    first = [sum(GROUPS[:g]) for g in range(len(GROUPS))]
    bits = [((1 << SEGMENT * n) - 1) << SEGMENT * f for f, n in zip(first, GROUPS, strict=True)]
    return [_signed(sum(bits[g] for g in c)) for c in combinations(range(len(GROUPS)), 3)]


MASKS = masks()


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    starts, ends, at = C.word_spans(raw, offsets)
    if not len(starts):
        return out
    inside = ~C.SPACE[raw]
    keep = inside.copy()
    follows = ends[ends < len(raw)]
    keep[follows[~inside[follows]]] = True  # one separator after each word
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    text = np.where(inside, C.LOWER[raw], np.uint8(32))[keep].tobytes()
    starts, ends = place[starts], place[ends]
    words = np.diff(at)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    which = np.repeat(np.arange(len(count)), count)
    begin = at[which] + np.arange(first[-1]) - first[which]
    stop = ends[begin + np.minimum(words[which], shingle) - 1].tolist()
    begin = starts[begin].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(text[a:b], seed) for a, b in zip(begin, stop, strict=True)), np.uint64, len(begin))
    return majority(hashes, first)


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from the hashes of its shingles; first has the first of each text, and one more at the end."""
    count = np.diff(first)
    out = np.zeros(len(count), np.uint64)
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for k in np.flatnonzero(count).tolist():  # one text at a time: the bits take eight times the hashes
        own = octets[first[k] : first[k + 1]]
        ones = sum(np.unpackbits(own[i : i + 65536], axis=1).sum(0, dtype=np.int64) for i in range(0, len(own), 65536))
        out[k] = np.packbits(2 * ones > count[k]).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = C.utf8(b.column(1))
            parts = [fingerprints_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in C.chunks(offsets)]
            fp = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(work, "doc_id long, fp long")


def embedding(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the segments, each written as so many ones (0: 00, 1: 01, 2: 11)."""
    odd = np.uint64(ODD)
    high = fp >> np.uint64(1)
    return ((fp | high) & odd) | (((fp & high) & odd) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings: counts written as ones differ in as many bits as their difference."""
    return np.bitwise_count(a ^ b)


def roots(u: np.ndarray, v: np.ndarray, n: int, start: np.ndarray | None = None) -> np.ndarray:
    """For n nodes with links u-v the smallest node of each one's component."""
    label = np.arange(n) if start is None else start
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def cell_links(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each component inside each cell. Rows are sorted by key."""
    n = len(keys)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(edge)
    emb, label = embedding(fps), np.arange(n)

    def verified(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = manhattan(emb[i], emb[j]) <= most
        i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= most
        return i[near], j[near]

    length = np.repeat(size, size)
    left = np.repeat(edge[1:], size) - np.arange(n)
    small = length <= SMALL_CELL
    found = [(np.zeros(0, np.int64),) * 2]
    for d in range(1, min(int(size.max(initial=0)), SMALL_CELL)):
        i = np.flatnonzero(small & (left > d))
        if len(i):
            found.append(verified(i, i + d))
    label = roots(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), n, label)
    for k in np.flatnonzero(size > SMALL_CELL):
        a, b = int(edge[k]), int(edge[k + 1])
        for i in range(a, b, 256):
            x, y = np.nonzero(manhattan(emb[i : min(i + 256, b), None], emb[None, i:b]) <= most)
            apart = label[x + i] != label[y + i]  # pairs that are connected already need no link
            x, y = x[apart] + i, y[apart] + i
            label = roots(*verified(x, y), n, label)
    linked = np.flatnonzero(label != np.arange(n))
    return fps[linked], fps[label[linked]]


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(u, v), u > v: links whose components are those of all pairs of fingerprints (distinct column fp)
    within `most` <= 3 differing bits."""
    if not 0 <= most <= 3:
        raise ValueError("the grid of cells holds for at most 3 differing bits")
    high, odd = F.shiftrightunsigned("fp", 1), F.lit(ODD)
    emb = F.col("fp").bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(high).bitwiseAND(odd), 1))
    cells = fps.select("fp", emb.alias("e")).select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("e").bitwiseAND(F.lit(m))) for i, m in enumerate(MASKS)])).alias("cell"))
    hot = C.materialize(cells.groupBy("cell").count().where(F.col("count") > CELL_LIMIT), "simhash-hot")
    if not hot.isEmpty():
        parts = F.coalesce(F.ceil(F.col("count") / CELL_LIMIT), F.lit(1)).cast("int")
        cells = cells.join(hot, "cell", "left").select("fp", "cell", parts.alias("parts")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        cells = cells.select("fp", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        cells = cells.select("fp", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = cell_links(k, f, most)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            keys = np.concatenate((keys, b.column(1).to_numpy()))
            fp = np.concatenate((fp, b.column(0).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            if cut > 100_000:  # the last cell may go on in the next batch
                yield from out(keys[:cut], fp[:cut])
                keys, fp = keys[cut:], fp[cut:]
        if len(keys):
            yield from out(keys, fp)

    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(work, "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable, for nodes with a link. Large-star and
    small-star rounds, as joins and aggregates, until nothing changes; no list of neighbours is built, and
    the links of hubs are not shuffled to one task."""
    edges = C.materialize(edges.select("u", "v"), "links")
    state = F.struct(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")))
    before = None
    while True:
        now = edges.agg(state).first()[0]
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, old = now, edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).withColumn("m", F.least("u", "m"))
        least = C.materialize(least, "stars")
        large = C.join_counted(both, least, "u", "degree", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = C.materialize(large, "large-stars")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = C.materialize(large.join(small, "u").select(pair.alias("p")).select("p.u", "p.v").where("u <> v").distinct(), "links")
        for table in (old, least, large):
            C.discard(table)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_rows, n_linked): the class of each document, how many rows
    share its fingerprint, and whether other fingerprints are in its component."""
    fps = C.materialize(fingerprints(docs, id_col, text_col), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows"))
    nodes = C.materialize(nodes, "simhash-nodes")
    found = components(links(nodes.select("fp"), most))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = C.materialize(rooted, "simhash-roots")
    smallest = C.materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n_linked")), "simhash-components")
    different, total = (x or 0 for x in rooted.agg(F.count(F.lit(1)), F.sum("n_rows")).first())
    classes = C.join_counted(rooted, smallest, "root", "n_linked", different).select("fp", "component_id", "n_rows", "n_linked")
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return C.join_counted(fps, C.materialize(classes, "simhash-classes"), "fp", "n_rows", total).select("doc_id", fingerprint, "component_id", "n_rows", "n_linked")
