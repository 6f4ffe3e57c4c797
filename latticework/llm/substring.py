"""Removal of repeated passages by Rabin-Karp hashes of every window of `width` words.

Each task hashes every window of its documents, keeps the first of equal ones (by doc_id, then start) and
reports the others as repeated. The first ones go, with their place, to a bucket by hash range; there
equal hashes of all tasks meet and all but the first are reported too. The reported windows come back
packed for each part of the documents and merge into maximal removal intervals. The number of buckets follows the amount of text, and
a task gives at most one row of a bucket per hash, so frequent passages do not gather anywhere.

Windows count as equal if they meet in one bucket and have equal 64-bit hashes there. The bucket comes from a
second, independent hash, and the number B of buckets grows with the text, so over n windows n^2 / (B 2^65)
false pairs are expected: 0.0003 over 30 GB, about 1 over 100 TB.

Nulls: a null text has no words; null ids come before all others, and rows of one id in the order of
their texts (such tables are numbered by a written, sorted copy). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

#: Bytes of text whose windows one bucket gets, and of text whose windows a task holds at once: about 1.3 million windows.
BUCKET_BYTES = 8 << 20
#: The bases of the two hashes of a window.
BASES = (C.BASE ^ 0x55550, 0xD6E8FEB86659FD93)


def window_hashes(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of every window, its document (index) and its start (in words)."""
    starts, ends, at = C.word_spans(raw, offsets)
    words = np.diff(at)
    count = np.maximum(words - width + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[doc] + start
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), doc, start
    words = C.word_hashes(raw, starts, ends)
    first, second = (C.mix(C.rolling(w, begin, begin + width, base)) for w, base in zip((words, C.mix(words)), BASES, strict=True))
    return first, second, doc, start


def merged(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [a, b) covered by windows at these starts."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > width)
    return starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + width


OUT = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("runs", pa.binary()), ("starts", pa.binary())])
HITS = pa.schema([("part", pa.int64()), ("runs", pa.binary()), ("starts", pa.binary())])


def prime(n: int) -> int:
    """The smallest prime of at least n."""
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def by_part(uids: np.ndarray, starts: np.ndarray, parts: int) -> list[tuple[int, bytes, bytes]]:
    """Windows (document, start) packed together for each part of the documents, uid modulo parts."""
    if not len(uids):
        return []
    part = uids % parts
    order = np.lexsort((starts, uids, part))
    part, uids, starts = part[order], uids[order], starts[order]
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return [(int(part[i]), *encode_runs(uids[i:j], starts[i:j])) for i, j in zip(edge, [*edge[1:], len(part)], strict=True)]


def encode_runs(d: np.ndarray, s: np.ndarray) -> tuple[bytes, bytes]:
    """Document ids with their run lengths, and starts as differences within a document's run."""
    run = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    step = s.astype(np.int64)
    step[1:] -= s[:-1]
    step[run] = s[run]
    runs = d[run].astype("<i8").tobytes() + np.diff(np.append(run, len(d))).astype("<u4").tobytes()
    return runs, (step.astype("<u2") if step.max() < 65536 else step.astype("<u4")).tobytes()


def decode_runs(runs: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = len(runs) // 12
    many = np.frombuffer(runs, "<u4", k, 8 * k).astype(np.int64)
    n = int(many.sum())
    step = np.frombuffer(starts, "<u2" if len(starts) == 2 * n else "<u4").astype(np.int64)
    total, begin = np.cumsum(step), np.cumsum(many) - many
    return np.repeat(np.frombuffer(runs, "<i8", k), many), (total - np.repeat(total[begin] - step[begin], many)).astype(np.uint32)


def repeated(rows: DataFrame, buckets: int, parts: int, width: int = 20) -> DataFrame:
    """(part, runs, starts) of (uid, text) with unique uids: the starts of windows whose words also start
    earlier, packed for each part of the documents."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pa.array(np.argsort(b.column(0).to_numpy(), kind="stable")))
            ids = b.column(0).to_numpy()
            raw, offsets = C.utf8(b.column(1))
            for lo, hi in C.chunks(offsets, BUCKET_BYTES):
                done = []
                for i, j in C.chunks(offsets[lo : hi + 1]):
                    i, j = i + lo, j + lo
                    h, other, doc, start = window_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                    bucket = ((other >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                    done.append((h, bucket.astype(np.uint32), (doc + i).astype(np.int32), start.astype(np.uint32)))
                h, where, doc, start = (np.concatenate(x) for x in zip(*done, strict=True))
                del done
                _, kept = np.unique(h, return_index=True)
                again = np.ones(len(h), bool)
                again[kept] = False
                for part, runs, packed in by_part(ids[doc[again]], start[again], parts):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((buckets + part, None, runs, packed), OUT.types, strict=True)], schema=OUT)
                kept.sort()
                h, where, doc, start = h[kept], where[kept], doc[kept], start[kept]
                order = np.argsort(where, kind="stable")
                edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), np.diff(where[order]) > 0)))
                for part in np.split(order, edge[1:]) if len(edge) else []:
                    row = (int(where[part[0]]), h[part].tobytes(), *encode_runs(ids[doc[part]], start[part]))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, OUT.types, strict=True)], schema=OUT)

    def second(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c in ("hashes", "runs", "starts")]
        if key[0].as_py() >= buckets:  # reported already
            return pa.table([pa.array([key[0].as_py() - buckets] * table.num_rows, pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], schema=HITS)
        h = np.frombuffer(b"".join(columns[0]), np.uint64)
        doc, start = (np.concatenate(x) for x in zip(*map(decode_runs, *columns[1:]), strict=True))
        del columns, table
        order = np.argsort(h)
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[order[1:]] == h[order[:-1]]
        shared = order[same[1:] | same[:-1]]  # windows whose hash another task has too
        h, doc, start = h[shared], doc[shared], start[shared]
        order = np.lexsort((start, doc, h))
        h, doc, start = h[order], doc[order], start[order]
        later = np.concatenate((np.zeros(min(1, len(h)), bool), h[1:] == h[:-1]))
        return pa.Table.from_pylist([dict(zip(HITS.names, x, strict=True)) for x in by_part(doc[later], start[later], parts)], schema=HITS)

    windows = rows.mapInArrow(first, "bucket long, hashes binary, runs binary, starts binary")
    return windows.groupBy("bucket").applyInArrow(second, "part long, runs binary, starts binary")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, text): uid is unique and in the order of doc_id. It is the doc_id itself if that is
    unique and never null; else rows are sorted and numbered in a written table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    rows = rows.orderBy(F.asc_nulls_first("doc_id"), "text").select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return C.materialize(rows, "numbered")


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed): what is left of each document, its words joined
    by one space, and the removed intervals (of words, end exclusive)."""
    rows = numbered(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    parts = prime(buckets)
    names = ("doc_id", "n_words", "n_removed", "kept_text", "removed")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        hits = [decode_runs(x["runs"], x["starts"]) for x in right.select(["runs", "starts"]).to_pylist()]
        uids, at_word = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*hits, strict=True) if hits else ((), ())))
        order = np.argsort(uids, kind="stable")
        uids, at_word = uids[order], at_word[order].astype(np.int64)
        own = left["uid"].to_numpy()
        low, high = np.searchsorted(uids, own, "left"), np.searchsorted(uids, own, "right")
        raw, offsets = C.utf8(left["text"])
        ids, out = left["doc_id"].to_pylist(), []
        for i, j in C.chunks(offsets):
            piece = raw[offsets[i] : offsets[j]]
            starts, ends, at = C.word_spans(piece, offsets[i : j + 1] - offsets[i])
            text = piece.tobytes()
            for k in range(i, j):
                lo, hi = int(at[k - i]), int(at[k - i + 1])
                a, z = merged(at_word[low[k] : high[k]], width)
                gone = np.zeros(hi - lo + 1, np.int32)
                gone[a] += 1
                gone[z] -= 1
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + lo
                kept = b" ".join([text[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                out.append((ids[k], hi - lo, hi - lo - len(keep), kept.decode(), np.stack((a, z), axis=1).tolist()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)

    part = F.pmod("uid", F.lit(parts)).alias("part")
    hits = repeated(rows.select("uid", "text"), buckets, parts, width)
    pairs = rows.select("uid", "doc_id", "text", part).groupBy("part").cogroup(hits.groupBy("part"))
    return pairs.applyInArrow(apply, "doc_id long, n_words long, n_removed long, kept_text string, removed array<array<long>>")
