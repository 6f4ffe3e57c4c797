"""Best-fit packing by a grouping genetic algorithm on distributed islands.

Documents are tokenized (one end token each) and cut into pieces of at most `capacity` tokens. Full
pieces are sequences by themselves. The others are dealt by a hash into problems of about ITEMS pieces,
and each problem is evolved on several islands with different seeds. An individual is a list of bins; the first
ones are best-fit packings of random orders. Crossover injects a choice of the well-filled bins of one parent whole
into the other, removes the bins that now hold duplicates, exchanges displaced documents for shorter ones where
that fills a bin better, and places the rest best-fit, longest first. After each epoch the elite of each
island migrates to the next island of its problem; in the last epoch a best-fit decreasing packing comes in as one
more migrant, so the result is never worse than that. Badly filled bins of all problems are then dissolved and packed
again together, round by round, until one problem is left.

The fitness is the number of bins, then how unevenly the room is spread; evolution ends early only when all bins
but one are full, as nothing can be better. Each round logs its crossovers, bins and lower bound.

Pieces are numbered when they are written to the shared folder, so repeated rows and null or repeated
ids pack like any others. Null and empty texts are one piece of one token. Other columns are ignored.
"""

from __future__ import annotations

import array
import functools
import logging
import random
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

log = logging.getLogger(__name__)

#: Pieces of one problem, islands of one problem, epochs (with a migration between them), individuals of an island.
ITEMS, ISLANDS, EPOCHS, SIZE = 4096, 2, 3, 6
#: Work of an island in an epoch: pieces that its crossovers may pass over. Small problems evolve for more generations.
EFFORT = 30_000
#: Displaced pieces and bins with room of which a crossover tries exchanges, at most.
TRIED = 48
#: Bins filled less than this share are dissolved and packed again with those of other problems.
WELL_FILLED = 0.995
#: Bytes of texts' chunks and their ids that a worker remembers; longer chunks than LONGEST characters are not.
REMEMBER, LONGEST = 200_000_000, 256
#: ASCII signs but the apostrophe, which may start a piece with letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: The splitting rule of byte-level BPE vocabularies of this kind (fixed value), but for its `\s+(?!\S)`: where no two characters of
#: white space stand together that is the same as `\s+`, and a rule that does not look ahead is matched about twice as fast.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def fast_encoder(path: str):
    """The vocabulary of a tokenizers file as a tiktoken encoder, or None if its merges are not in the
    order of its ids or if it prepares texts in another way. Only for texts without white space beside white space."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model, split = j["model"], j["pre_tokenizer"] or {}
    if j["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model["type"] != "BPE":
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(shown))}
    special = {t["content"] for t in j["added_tokens"]}
    ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    for i, m in enumerate(model["merges"]):
        x, y = m if isinstance(m, list) else m.split(" ")
        if model["vocab"].get(x + y) != 256 + i:
            return None
    return tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Ids of texts, as the tokenizers file defines them. Texts of Latin letters, ASCII signs and single spaces and line
    ends are encoded whole by tiktoken with the same vocabulary. Of all others, a space between two characters that are
    not white space is always a boundary of the byte-level splitting rule, so the chunks between such spaces are
    encoded each by itself, and repeated ones are looked up. New chunks of Latin letters are encoded by
    tiktoken too, several times as fast; all others by tokenizers itself."""

    def __init__(self, path: str) -> None:
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        fast = fast_encoder(path)
        self.fast = fast and fast.encode_ordinary
        self.split = re.compile(r"(?<=\S) (?=\S)").split
        self.rare = re.compile(r"[^\S \n]").search
        self.plain = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
        self.simple = re.compile(r"[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
        self.doubled = re.compile(r"[ \n]{2}").search
        self.known = Known(self.chunk)

    def odd(self, text: str) -> bool:
        """Whether white space may stand beside a space."""
        return "  " in text or " \n" in text or "\n " in text or bool(self.rare(text))

    def whole(self, text: str) -> bool:
        """Whether tiktoken may encode the text as it is."""
        return bool(self.simple(text)) and not self.doubled(text) and not any(t in text for t in self.special)

    def chunk(self, x: str) -> bytes:
        """Ids of a space and a chunk. Letters followed by signs are two pieces of the splitting rule."""
        if self.fast and (x.isascii() or self.plain(x)) and not any(t in x for t in self.special):
            stem = x.rstrip(SIGNS)
            if stem.isalpha():
                if len(stem) == len(x):
                    return array.array("I", self.fast(" " + x)).tobytes()
                return self.known[stem] + array.array("I", self.fast(x[len(stem) :])).tobytes()
            return array.array("I", self.fast(" " + x)).tobytes()
        return array.array("I", self.encoder.encode(" " + x, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """32-bit ids of each text, little-endian."""
        whole = [bool(self.fast) and self.whole(t) for t in texts]
        parts = [self.split(t) if self.odd(t) else t.split(" ") for t, w in zip(texts, whole, strict=True) if not w]
        first = self.encoder.encode_batch([p[0] for p in parts], add_special_tokens=False)
        ids = self.known.__getitem__
        rest = (b"".join([array.array("I", e.ids).tobytes(), *map(ids, p[1:])]) for p, e in zip(parts, first, strict=True))
        out = [array.array("I", self.fast(t)).tobytes() if w else next(rest) for t, w in zip(texts, whole, strict=True)]
        return out if sys.byteorder == "little" else [np.frombuffer(x, ">u4").astype("<u4").tobytes() for x in out]


class Known(dict):
    """Ids of chunks, found when first asked for; forgotten when they take REMEMBER bytes."""

    def __init__(self, find) -> None:
        self.find, self.held = find, 0

    def __missing__(self, x: str) -> bytes:
        out = self.find(x)
        if len(x) <= LONGEST:
            self.held += sys.getsizeof(x) + sys.getsizeof(out) + 100
            if self.held > REMEMBER:
                self.clear()
                self.held = 0
            self[x] = out
        return out


@functools.cache
def tokens_of(path: str) -> Tokens:
    """One for each worker process, which keeps its chunks from task to task."""
    return Tokens(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than capacity."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, piece, start, length, ids): every piece with its token ids (binary, little-endian
    unsigned 32-bit), written to the shared folder; uid is unique."""
    path = path or tokenizer_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, uid, end = tokens_of(path), TaskContext.get().partitionId() << 40, np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1)
            for i, j in C.chunks(C.utf8(texts)[1], 2 << 20):
                rows = []
                for doc_id, ids in zip(doc_ids[i:j], tokens.encode([t or "" for t in texts[i:j].to_pylist()]), strict=True):
                    ids += end
                    for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        rows.append((uid, doc_id, k, start, length, ids[4 * start : 4 * (start + length)]))
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return C.materialize(slim.mapInArrow(work, "uid long, doc_id long, piece int, start long, length long, ids binary"), "pieces")


SCHEMA = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def best_fit(items: list[int], lengths: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Place each item into the open bin with the least room that is enough, else into a new bin."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for k, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(k)
            mask |= 1 << r
    for x in items:
        n = lengths[x]
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            stack = by_room[r]
            k = stack.pop()
            if not stack:
                mask ^= 1 << r
            bins[k].append(x)
        else:
            r, k = capacity, len(bins)
            bins.append([x])
            room.append(r)
        r -= n
        room[k] = r
        if r:
            by_room.setdefault(r, []).append(k)
            mask |= 1 << r


Packing = tuple[list[list[int]], list[int]]


def fitness(p: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more uneven fill (room left in few bins)."""
    return -len(p[0]), sum((capacity - r) ** 2 for r in p[1])


def exchange(displaced: list[int], lengths: list[int], bins: list[list[int]], room: list[int]) -> list[int]:
    """What is displaced after pieces of bins with room have been exchanged for longer displaced ones that fill the bin
    better; two pieces of a bin may go for one."""
    open_ = sorted((k for k, r in enumerate(room) if r), key=room.__getitem__)[:TRIED]
    out = displaced[TRIED:]
    for x in displaced[:TRIED]:
        n, best, found = lengths[x], 0, None
        for k in open_:
            r, own = room[k], bins[k]
            for i, y in enumerate(own):
                gain = n - lengths[y]
                if best < gain <= r:
                    best, found = gain, (k, (y,))
                for z in own[:i]:
                    if best < gain - lengths[z] <= r:
                        best, found = gain - lengths[z], (k, (z, y))
        if found is None:
            out.append(x)
            continue
        k, gone = found
        bins[k] = [y for y in bins[k] if y not in gone] + [x]
        room[k] -= best
        out += gone
    return out


def crossover(a: Packing, b: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """Inject whole well-filled bins of b into a; drop bins of a with duplicates; exchange and best-fit the displaced."""
    least = max(1, capacity // 256)
    limit, share = rng.choice((0, 0, least)), rng.uniform(0.1, 0.6)
    taken = [k for k, r in enumerate(b[1]) if r <= limit and rng.random() < share]
    inside = bytearray(len(lengths))
    for k in taken:
        for x in b[0][k]:
            inside[x] = 1
    bins, room = [list(b[0][k]) for k in taken], [b[1][k] for k in taken]
    displaced: list[int] = []
    worst = sorted(a[1], reverse=True)[min(len(a[1]) - 1, rng.randint(2, 5))] if a[1] else 0
    worst = min(worst, rng.choice((1, least // 2 + 1, worst)))
    for items, r in zip(*a, strict=True):
        if r and r >= worst or any(inside[x] for x in items):  # the emptiest bins are opened too
            displaced += [x for x in items if not inside[x]]
        else:
            bins.append(list(items))
            room.append(r)
    displaced.sort(key=lengths.__getitem__, reverse=True)
    displaced = exchange(displaced, lengths, bins, room)
    if rng.random() < 0.5:
        displaced.sort(key=lengths.__getitem__, reverse=True)
    else:
        displaced.sort(key=lambda x: lengths[x] * rng.uniform(0.8, 1), reverse=True)
    best_fit(displaced, lengths, bins, room, capacity)
    return bins, room


def packed_by(order: list[int], lengths: list[int], capacity: int) -> Packing:
    p: Packing = ([], [])
    best_fit(order, lengths, *p, capacity)
    return p


def decreasing(lengths: list[int], capacity: int) -> Packing:
    """Best-fit decreasing."""
    return packed_by(sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True), lengths, capacity)


def evolve(lengths: list[int], capacity: int, seed: int, start: list[Packing], effort: int = EFFORT, size: int = SIZE) -> tuple[Packing, int]:
    """The elite of a steady-state population, and how many crossovers there were. A child that is as good as one that
    is there takes the place of the worst only if it is better than that."""
    rng = random.Random(seed)
    score = lambda p: fitness(p, capacity)
    population = list(start)
    while len(population) < max(2, size):
        population.append(packed_by(rng.sample(range(len(lengths)), len(lengths)), lengths, capacity))
    population.sort(key=score, reverse=True)
    scores = [score(p) for p in population]
    done = 0
    while done < max(2, effort // max(1, len(lengths))):
        if sum(r > 0 for r in population[0][1]) <= 1:
            break
        done += 1
        i, j = rng.sample(range(len(population)), 2)
        child = crossover(population[i], population[j], lengths, capacity, rng)
        s = score(child)
        if s > scores[-1] and s not in scores:
            at = next(k for k, other in enumerate(scores) if s > other)
            population.insert(at, child)
            scores.insert(at, s)
            population.pop()
            scores.pop()
    return population[0], done


def islands(items: DataFrame, n: int, capacity: int, tag: str, history: list[dict] | None = None) -> DataFrame:
    """(uid, length, seq, room): items (uid, length) packed within problems dealt by a hash."""
    problems = max(1, round(n / ITEMS))
    cell = F.pmod(F.xxhash64("uid", F.lit(tag)), F.lit(problems)).alias("problem")
    dealt = items.select(cell, "uid", "length")
    first = dealt.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))

    def pack(lengths: np.ndarray, bins: list[list[int]]) -> tuple[bytes, bytes]:
        label = np.zeros(len(lengths), np.int32)
        for k, b in enumerate(bins):
            label[b] = k
        return lengths.astype(np.int16).tobytes(), label.tobytes()

    def row(key: tuple, uids: np.ndarray, lengths: np.ndarray, elite: Packing, crossovers: int) -> pd.DataFrame:
        packed = pack(lengths, elite[0])
        return pd.DataFrame({"problem": [int(key[0])], "island": [int(key[1])], "uids": [uids.tobytes()], "lengths": [packed[0]], "bins": [packed[1]], "crossovers": [crossovers]})

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        lengths = pdf["length"].to_numpy()
        return row(key, pdf["uid"].to_numpy(), lengths, *evolve(lengths.tolist(), capacity, 7919 * int(key[0]) + int(key[1]), []))

    def unpack(label: bytes, lengths: np.ndarray) -> Packing:
        label = np.frombuffer(label, np.int32)
        order = np.argsort(label, kind="stable")
        bins = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(label[order])) + 1)]
        return bins, [capacity - int(lengths[b].sum()) for b in bins]

    def again(epoch: int):
        def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            lengths = np.frombuffer(pdf["lengths"].iloc[0], np.int16).astype(np.int64)
            start = [unpack(x, lengths) for x in pdf["bins"]]
            if epoch == EPOCHS - 1:
                start.append(decreasing(lengths.tolist(), capacity))
            elite, crossovers = evolve(lengths.tolist(), capacity, 104729 * int(key[0]) + int(key[1]) + 15485863 * epoch, start)
            return row(key, np.frombuffer(pdf["uids"].iloc[0], np.int64), lengths, elite, crossovers + int(pdf["crossovers"].max()))

        return work

    schema = "problem long, island int, uids binary, lengths binary, bins binary, crossovers long"
    state = C.materialize(first.groupBy("problem", "island").applyInPandas(begin, schema), "islands")
    for epoch in range(1, EPOCHS):
        to = F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))).alias("to")
        moved = state.select("problem", to, "uids", "lengths", "bins", "crossovers").withColumnRenamed("to", "island")
        state, old = C.materialize(moved.groupBy("problem", "island").applyInPandas(again(epoch), schema), "islands"), state
        C.discard(old)

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        uids = np.frombuffer(pdf["uids"].iloc[0], np.int64)
        lengths = np.frombuffer(pdf["lengths"].iloc[0], np.int16).astype(np.int64)
        bins, room = max((unpack(x, lengths) for x in pdf["bins"]), key=lambda p: fitness(p, capacity))
        where = np.concatenate([np.asarray(b) for b in bins])
        many = [len(b) for b in bins]
        offset = np.concatenate([np.cumsum(lengths[b]) - lengths[b] for b in bins])
        return pd.DataFrame({"uid": uids[where], "length": lengths[where], "sequence_id": np.repeat([uids[b[0]] for b in bins], many), "offset": offset, "room": np.repeat(room, many)})

    packed = C.materialize(state.groupBy("problem").applyInPandas(best, "uid long, length long, sequence_id long, offset long, room long"), "packed")
    total, bins = packed.agg(F.sum("length"), F.count_if(F.col("offset") == 0)).first()
    figures = {"round": tag, "problems": problems, "pieces": n, "crossovers": state.agg(F.sum("crossovers")).first()[0], "bins": bins, "bound": -(-total // capacity)}
    log.info("packing %s", figures)
    if history is not None:
        history.append(figures)
    C.discard(state)
    return packed


def plan(parts: DataFrame, capacity: int = 2048, history: list[dict] | None = None) -> DataFrame:
    """(uid, sequence_id, offset) of pieces (uid, length). A sequence is named by its first piece. The figures of each
    round are added to history."""
    if capacity >= 1 << 15:
        raise ValueError("capacity must be under 32768")
    lengths = parts.select("uid", "length")
    done = lengths.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_, round_ = lengths.where(F.col("length") < capacity), 0
    n = open_.count()
    while n:
        packed = islands(open_, n, capacity, f"round {round_}", history)
        loose = packed.where(F.col("room") > (1 - WELL_FILLED) * capacity)
        left = loose.count() if n > 1.5 * ITEMS else 0
        if left == n:
            left = 0
        kept = packed if not left else packed.where(F.col("room") <= (1 - WELL_FILLED) * capacity)
        done = done.union(kept.select("uid", "sequence_id", "offset"))
        open_, n, round_ = loose.select("uid", "length"), left, round_ + 1
    return done


def pack(docs: DataFrame, capacity: int = 2048, **options) -> tuple[DataFrame, DataFrame]:
    """The pieces with their token ids, and the plan that places them."""
    parts = pieces(docs, capacity, **options)
    return parts, plan(parts, capacity)


def sequences(parts: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves."""
    rows = parts.select("uid", "length", "ids").join(placed, "uid").groupBy("sequence_id")
    one = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))")
    return rows.agg(F.sum("length").alias("n_tokens"), one.alias("p")).select("sequence_id", "n_tokens", joined.alias("ids"))
