"""Quality rules: base counts of each text, and n-gram perplexity bands by language.

The model is an interpolated modified Kneser-Ney model over UTF-8 bytes (digits count as one symbol),
one for each language. Its n-gram counts, continuation counts, discounts and probabilities are Spark
aggregates and joins over all reference texts: those that pass the base rules and have few symbols and few repeated
words, so that junk is odd to the model however much of it there is. For scoring it is laid out as sorted arrays of
64-bit hashes with log-probabilities and back-off weights beside them. A block of at most ENTRIES entries is broadcast
at a time; a larger model is cut by the two bytes before the predicted one, so that each block holds all
that its predictions need, and the partial sums of the blocks add up to the same scores.

Every text is scored, whole and by equal parts of about PART bytes. It is rejected by the upper band of its language
if the median of its parts lies above it, so a clean text is not rejected for a passage in another language, and by
the lower band if its whole log-perplexity lies below it. The bands are the medians of these two figures over the
documents that pass the base rules, plus UPPER or less LOWER robust deviations of them. A language of fewer than FEW such
documents has no bands.

Nulls: a null text has no words and perplexity null; a null language is a group of its own. Null and
repeated ids stay as they are. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

ORDER = 5
ENTRIES = 4_000_000
LOWER, UPPER, FEW = 8.0, 8.0, 20
PART = 128
#: What makes a text one that the model is counted on, in hundredths.
SYMBOLS, REPEATS = 1, 30

#: Digits become one symbol; zero bytes are left to the padding before a text.
FOLD = np.arange(256, dtype=np.uint64)
FOLD[48:58] = 48
FOLD[0] = 32

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def grams(raw: np.ndarray, order: int) -> np.ndarray:
    """The packed n-gram that ends at each byte of one text, after order - 1 zero bytes."""
    padded = np.concatenate((np.zeros(order - 1, np.uint64), FOLD[raw]))
    out = np.zeros(len(raw), np.uint64)
    for k in range(order):
        out = (out << np.uint64(8)) | padded[k : k + len(raw)]
    return out


def batch_grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The same for all texts of a buffer; no n-gram reaches into the text before."""
    out = grams(raw, order)
    for k in range(order - 1):  # the first bytes of each text see less
        at = offsets[:-1][np.diff(offsets) > k] + k
        out[at] &= np.uint64((1 << 8 * (k + 1)) - 1)
    return out


def reference(counts: list[np.ndarray]) -> np.ndarray:
    """Whether a text with these base_counts is one that the model is counted on: it passes the base rules, at most
    SYMBOLS of a hundred characters of its words are symbols, and at most REPEATS of a hundred words are repeated."""
    words, chars, symbols, _, repeat = counts
    return (words >= 50) & (100 * symbols <= SYMBOLS * chars) & (100 * repeat <= REPEATS * words)


def count(docs: DataFrame, order: int = ORDER, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, k, c): how often each n-gram of the highest order occurs in the texts that pass the base rules."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy().astype(np.uint64)
            raw, offsets = C.utf8(b.column(1))
            for lo, hi in C.chunks(offsets, 12 << 20):
                found = []
                for i, j in C.chunks(offsets[lo : hi + 1]):
                    i, j = i + lo, j + lo
                    own, part = offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
                    use = reference(base_counts(part, own))
                    keys = batch_grams(part, own, order)
                    keys |= np.repeat(code[i:j], np.diff(own)) << np.uint64(40)
                    found.append(keys[np.repeat(use, np.diff(own))])
                keys = np.concatenate(found)
                del found
                keys.sort()
                edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
                c = np.diff(np.append(edge, len(keys)))
                keys = keys[edge]
                lang = pa.DictionaryArray.from_arrays(pa.array((keys >> np.uint64(40)).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, pa.array((keys & np.uint64((1 << 40) - 1)).astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "k", "c"])

    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(work, "lang string, k long, c long").groupBy("lang", "k").agg(F.sum("c").alias("c"))


def estimate(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, n, kind, k, v): natural logs of probabilities (kind 'p', k an n-gram) and of back-off weights
    (kind 'b', k the context of an n-gram of order n)."""
    tables = {order: C.materialize(counts, f"counts-{order}")}
    for n in range(order - 1, 0, -1):
        suffix = F.col("k").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("k")
        tables[n] = C.materialize(tables[n + 1].select("lang", suffix).groupBy("lang", "k").agg(F.count(F.lit(1)).alias("c")), f"counts-{n}")
    out, lower = None, None
    for n in range(1, order + 1):
        t = tables[n]
        of = lambda i: F.sum((F.col("c") == i).cast("long")).cast("double")
        d = t.groupBy("lang").agg(*[of(i).alias(f"n{i}") for i in (1, 2, 3, 4)]).withColumn("y", F.expr("n1 / nullif(n1 + 2 * n2, 0)"))
        exact = [F.expr(f"{i} - {i + 1} * y * n{i + 1} / nullif(n{i}, 0)") for i in (1, 2, 3)]  # null where no count can tell
        disc = [F.when(x.isNull(), i / 2).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), x))).alias(f"d{i}") for i, x in enumerate(exact, 1)]
        t = t.join(C.small(C.materialize(d.select("lang", *disc), "discounts")), "lang").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        t = t.select("lang", "k", F.shiftright("k", 8).alias("ctx"), "c", "d")
        ctx = t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g"))
        t = t.join(ctx, ["lang", "ctx"]).withColumn("s", F.col("k").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
        if lower is None:
            p = t.select("lang", "k", ((F.col("c") - F.col("d")) / F.col("total") + F.col("g") / 256).alias("p"))
        else:
            p = t.join(lower.select("lang", F.col("k").alias("s"), F.col("p").alias("q")), ["lang", "s"]).select("lang", "k", ((F.col("c") - F.col("d")) / F.col("total") + F.col("g") * F.col("q")).alias("p"))
        lower = p = C.materialize(p, f"probabilities-{n}")
        rows = p.select("lang", F.lit(n).alias("n"), F.lit("p").alias("kind"), "k", F.ln("p").alias("v"))
        rows = rows.union(ctx.select("lang", F.lit(n).alias("n"), F.lit("b").alias("kind"), F.col("ctx").alias("k"), F.ln("g").alias("v")))
        out = rows if out is None else out.union(rows)
    return C.materialize(out, "model")


def block_of(pair: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a prediction, by the two bytes before the predicted one."""
    return (C.mix(pair + np.uint64(1)) >> np.uint64(20)) % np.uint64(blocks)


class Arrays:
    """A block of the model: for each language, order and kind, sorted hashes and the values beside them."""

    def __init__(self, table: pa.Table, langs: list[str], order: int) -> None:
        """From rows (part, k, v); a part is the number of the language, times 64, plus twice n, plus 1 for back-off weights."""
        self.order, self.parts = order, {}
        key, k, v = (table[c].to_numpy() for c in ("part", "k", "v"))
        k = k.view(np.uint64)
        by = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(by)), bool), np.diff(key[by]) != 0)))
        for mine in np.split(by, edge[1:]) if len(by) else []:
            x = int(key[mine[0]])
            h = C.mix(k[mine])
            at = np.argsort(h)
            self.parts[langs[x // 64], x % 64 // 2, "b" if x % 2 else "p"] = h[at], v[mine][at]

    def find(self, lang: str, n: int, kind: str, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and which of the n-grams are there."""
        h, v = self.parts.get((lang, n, kind), (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        if not len(h):
            return np.zeros(len(k), np.float32), np.zeros(len(k), bool)
        x = C.mix(k)
        at = np.minimum(np.searchsorted(h, x), len(h) - 1)
        return v[at], h[at] == x

    def logp(self, lang: str, k: np.ndarray) -> np.ndarray:
        """Log-probability of the last byte of each packed n-gram."""
        out, todo = np.zeros(len(k)), np.arange(len(k))
        for n in range(self.order, 0, -1):
            v, there = self.find(lang, n, "p", k[todo])
            out[todo[there]] += v[there]
            todo = todo[~there]
            if not len(todo):
                return out
            bow, known = self.find(lang, n, "b", k[todo] >> np.uint64(8))
            out[todo[known]] += bow[known]
            k = k & np.uint64((1 << 8 * (n - 1)) - 1)
        out[todo] -= np.log(256)
        return out


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    starts, ends, at = C.word_spans(raw, offsets)
    texts = len(offsets) - 1
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    chars = total(((raw & 0xC0) != 0x80) & ~C.SPACE[raw])
    symbols = total(SYMBOL[raw])
    lines = np.zeros(texts, np.int64)
    for k in range(texts):
        seen: set[bytes] = set()
        for line in raw[offsets[k] : offsets[k + 1]].tobytes().split(b"\n"):
            if line in seen:
                lines[k] += 1
            elif line.strip(b" \t\r\x0b\x0c"):
                seen.add(line)
    words = np.diff(at)
    many = np.maximum(words - 2, 0)
    doc = np.repeat(np.arange(texts), many)
    begin = at[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    covered = np.zeros(len(starts) + 1, np.int32)
    if len(begin):
        h = C.mix(C.rolling(C.word_hashes(raw, starts, ends), begin, begin + 3) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(h)
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[order[1:]] == h[order[:-1]]
        twice = begin[order[same[1:] | same[:-1]]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 3, -1)
    repeat = np.diff(np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))[at])
    return [words, chars, symbols, lines, repeat]


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def model_block(model: DataFrame, langs: list[str], order: int, block: int, blocks: int) -> Arrays:
    """The part of the model that the predictions of a block need."""
    code = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)]) if langs else F.create_map().cast("map<string,int>")
    part = (F.try_element_at(code, "lang") * 64 + F.col("n") * 2 + (F.col("kind") == "b").cast("int")).cast("int").alias("part")
    rows = model.select(part, "k", F.col("v").cast("float").alias("v"), F.when(F.col("kind") == "p", F.shiftright("k", 8)).otherwise(F.col("k")).bitwiseAND(F.lit(0xFFFF)).alias("pair"), (F.col("n") < 3).alias("coarse"))
    if blocks > 1:

        def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = block_of(b.column(3).to_numpy().view(np.uint64), blocks) == block
                yield b.filter(pa.array(own | np.asarray(b.column(4)))).select([0, 1, 2])

        rows = rows.mapInArrow(mine, "part int, k long, v float")
    return Arrays(rows.select("part", "k", "v").toArrow(), langs, order)


def score(docs: DataFrame, model: DataFrame, order: int = ORDER, entries: int = ENTRIES, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, base counts, nll, n_bytes, parts): nll is the negative log-likelihood of the text, parts
    has the mean one of a byte in each part of the text. Each block of the model is sent, used and taken back before the next."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    blocks = max(1, -(-model.count() // entries))
    langs = sorted(r["lang"] for r in model.select("lang").distinct().collect())
    slim = slim.withColumn("uid", F.monotonically_increasing_id())
    if blocks > 1:
        slim = C.materialize(slim, "numbered")
    schema = "uid long, doc_id long, lang string, " + ", ".join(f"{x} long" for x in BASE) + ", nll double, n_bytes long, parts array<float>"
    names = [x.split()[0] for x in schema.split(", ")]
    found = None
    for block in range(blocks):
        sent = spark.sparkContext.broadcast(model_block(model, langs, order, block, blocks))

        def work(batches: Iterator[pa.RecordBatch], block=block, sent=sent) -> Iterator[pa.RecordBatch]:
            arrays = sent.value
            for b in batches:
                langs = np.array(b.column(1).to_pylist(), object)
                raw, offsets = C.utf8(b.column(2))
                for i, j in C.chunks(offsets):
                    own = offsets[i : j + 1] - offsets[i]
                    part = raw[offsets[i] : offsets[j]]
                    k = batch_grams(part, own, order)
                    code = np.repeat(np.arange(j - i), np.diff(own))
                    size = np.diff(own)
                    many = np.where(size > 0, np.maximum(size // PART, 1), 0)
                    edge = np.concatenate(([0], np.cumsum(many)))
                    inside = (np.arange(len(k)) - own[code]) * many[code] // size[code] + edge[code]
                    sums = np.zeros(edge[-1])
                    use = np.ones(len(k), bool) if blocks == 1 else block_of((k >> np.uint64(8)) & np.uint64(0xFFFF), blocks) == block
                    for lang in set(langs[i:j].tolist()):
                        at = np.flatnonzero(use & (langs[i:j] == lang)[code])
                        if len(at):
                            sums -= np.bincount(inside[at], arrays.logp(lang, k[at]), len(sums))
                    nll = np.bincount(np.repeat(np.arange(j - i), many), sums, j - i).astype(float)  # of no parts it is whole numbers
                    parts = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array((sums / np.maximum(1, np.bincount(inside, minlength=len(sums)))).astype(np.float32)))
                    counts = base_counts(part, own) if block == 0 else [np.zeros(j - i, np.int64)] * 5
                    rows = [b.column(3)[i:j], b.column(0)[i:j], b.column(1)[i:j], *(pa.array(c.astype(np.int64)) for c in counts), pa.array(nll), pa.array(size), parts]
                    yield pa.RecordBatch.from_arrays(rows, names=names)

        one = C.materialize(slim.select("doc_id", "lang", "text", "uid").mapInArrow(work, schema), "perplexity")
        sent.destroy()
        found = one if found is None else found.union(one)
    if blocks > 1:
        first = [F.first(c).alias(c) for c in ("doc_id", "lang", "n_bytes")]
        found = found.groupBy("uid").agg(*first, *[F.sum(c).alias(c) for c in (*BASE, "nll")], F.collect_list("parts").alias("p"))
        added = F.aggregate(F.slice("p", 2, blocks), F.get("p", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))  # a list of each block
        found = C.materialize(found.withColumn("parts", added), "perplexity")
    return found.select("doc_id", "lang", *BASE, "nll", "n_bytes", "parts")


def judge(scored: DataFrame, lower: float = LOWER, upper: float = UPPER, few: int = FEW) -> DataFrame:
    """Adds base_failed, log_ppl (of the whole text), the quartiles q1, mid and q3 of its parts, the bands low and high, kept, and
    the band that rejects it ('low', 'high' or null)."""
    fails = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    x = scored.withColumn("base_failed", fails).withColumn("log_ppl", F.expr("nll / nullif(n_bytes, 0)")).withColumn("parts", F.array_sort("parts"))
    quartile = lambda k: F.get("parts", F.expr(f"cast((size(parts) - 1) * {k} div 4 as int)")).cast("double")
    x = C.materialize(x.withColumn("q1", quartile(1)).withColumn("mid", quartile(2)).withColumn("q3", quartile(3)).drop("parts"), "quartiles")
    good = x.where("not base_failed and mid is not null").select("lang", "log_ppl", "mid")
    median = lambda c, name: F.percentile_approx(c, 0.5, 10_000).alias(name)
    middle = good.groupBy("lang").agg(median("log_ppl", "m"), median("mid", "n"), F.count(F.lit(1)).alias("texts"))
    apart = good.join(C.small(C.materialize(middle.where(F.col("texts") >= few), "middle")), "lang")
    apart = apart.groupBy("lang").agg(F.first("m").alias("m"), F.first("n").alias("n"), median(F.abs(F.col("log_ppl") - F.col("m")), "s"), median(F.abs(F.col("mid") - F.col("n")), "t"))
    bands = apart.select("lang", (F.col("m") - lower * 1.4826 * F.col("s")).alias("low"), (F.col("n") + upper * 1.4826 * F.col("t")).alias("high"))
    x = x.join(C.small(C.materialize(bands, "bands")), "lang", "left")
    band = F.when(F.col("base_failed"), None).when(F.col("mid") > F.col("high"), "high").when(F.col("log_ppl") < F.col("low"), "low")
    return x.withColumn("band", band).withColumn("kept", ~F.col("base_failed") & F.col("band").isNull())


def quality_rules(docs: DataFrame, order: int = ORDER, **options) -> DataFrame:
    """(doc_id, lang, base counts, base_failed, log_ppl, q1, mid, q3, low, high, band, kept) of every document."""
    return judge(score(docs, estimate(count(docs, order), order), order, **options))
