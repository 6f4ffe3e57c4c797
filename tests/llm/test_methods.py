"""What each method itself must do: against brute force, on hard instances, with small bounds and very long texts."""

import ipaddress
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticework.llm import common as C
from latticework.llm import langid, packing, perplexity, pii, postings, quality, secrets, simhash, substring, urlfilter


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    made = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(4000)} | {b"a" * k for k in range(1, 60)})
    x = y = "a"
    for _ in range(12):  # the two words of 4096 letters that every polynomial hash modulo 2**64 confuses
        x, y = x + x.translate(str.maketrans("ab", "ba")), y.translate(str.maketrans("ab", "ba")) + y
    made += [x.encode(), x.translate(str.maketrans("ab", "ba")).encode()]
    raw, offsets = C.utf8(pa.array([b" ".join(made).decode()]))
    starts, ends, _ = C.word_spans(raw, offsets)
    h = C.word_hashes(raw, starts, ends)
    assert len(h) == len(made) == len(set(h.tolist()))
    moved = C.word_hashes(np.concatenate((np.full(3, 32, np.uint8), raw)), starts + 3, ends + 3)
    assert (moved == h).all()


@pytest.mark.parametrize("few", [0, 100_000])
def test_hot_keys_are_joined_like_others(spark, monkeypatch, few):
    monkeypatch.setattr(C, "HOT", 10)
    monkeypatch.setattr(C, "FEW_KEYS", few)
    many = spark.createDataFrame([(0, i) for i in range(60)] + [(i, i) for i in range(1, 41)], "k long, v long")
    one = many.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 7").withColumn("w", F.col("k") + 100)
    got = C.join_counted(many, one, "k", "n", 100)
    want = many.join(one, "k")
    assert Counter(got.select(want.columns).collect()) == Counter(want.collect())


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}  # noqa: RUF012

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.shared_dir(Session())


# Packing


def triplets(n, capacity, rng):
    """Items that fill n bins exactly, three to a bin."""
    out = []
    for _ in range(n):
        a = rng.randint(capacity * 38 // 100, capacity * 49 // 100)
        b = rng.randint(capacity // 4, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_genetic_search_finds_what_best_fit_decreasing_misses(seed):
    lengths = triplets(5, 1000, random.Random(seed))
    assert len(packing.decreasing(lengths, 1000)[0]) == 6
    found = [packing.evolve(lengths, 1000, 100 * seed + island, [], effort=150_000) for island in range(4)]
    elite, crossovers = min(found, key=lambda x: len(x[0][0]))
    assert len(elite[0]) == 5 and crossovers > 0
    assert sorted(x for b in elite[0] for x in b) == list(range(15))


def test_packing_counts_crossovers_and_is_no_worse_than_best_fit_decreasing(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 200)
    rng = random.Random(2)
    lengths = [rng.randint(1, 900) for _ in range(700)] + triplets(30, 2048, rng)
    history = []
    parts = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    placed = packing.plan(parts, 2048, history).collect()
    assert len(placed) == len(lengths) and len({r.uid for r in placed}) == len(lengths)
    bins = defaultdict(list)
    for r in placed:
        bins[r.sequence_id].append((r.offset, lengths[r.uid]))
    for own in bins.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, [*own[1:], (sum(n for _, n in own), 0)], strict=True)) and own[0][0] == 0
        assert sum(n for _, n in own) <= 2048
    assert history[0]["crossovers"] > 0 and history[0]["problems"] > 1 and history[0]["bins"] >= history[0]["bound"]
    assert len(bins) <= len(packing.decreasing(lengths, 2048)[0]) + 1


def test_remembered_chunks_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBER", 20_000)
    known = packing.Known(lambda x: x.encode() * 2)
    for i in range(2000):
        assert known[f"word{i}"] == f"word{i}word{i}".encode()
        assert known.held <= 20_000
    known["x" * 1000]
    assert "x" * 1000 not in known


# URL filters


@pytest.mark.parametrize(("most", "parts"), [(10, 8), (10, 1)])
def test_url_lists_beyond_the_bound_give_equal_results(spark, most, parts):
    rng = random.Random(3)
    hosts = [f"h{i}.{rng.choice(('com', 'net', 'org'))}" for i in range(60)]
    urls = [f"http://{rng.choice(('', 'www.', 'a.b.'))}{rng.choice(hosts)}/{rng.choice(('de', 'fr', 'en'))}/{i}" for i in range(400)] + [None, "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([(h,) for h in hosts[:40]] + [(hosts[0],), (None,)], "host string")
    want = Counter(urlfilter.judge(pages, blocked=hosts[:40]).collect())
    assert Counter(urlfilter.judge(pages, blocked=table, most=most, parts_=parts).collect()) == want
    assert {r.listed_host for r in want if r.listed_host} <= set(hosts[:40]) and any(r.listed_host for r in want)


# Personal data


def test_spans_inside_a_long_base_span_are_not_added():
    t = "1.2.3.4_1.2.3.4_1.2.3.4_1.2.3.4_1.2.3.4_555-123-4567@a.bc"
    base = pii.base_spans(t)
    assert ("email", 0, len(t)) in base and pii.fit().added(t, base) == []


def test_taken_intervals_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 8)))]
        taken, held = pii.Taken(spans), list(spans)
        for _ in range(10):
            a = rng.randrange(60)
            b = a + rng.randint(1, 6)
            free = all(e <= a or b <= s for s, e in held)
            assert taken.clear(a, b) == free
            if free:
                taken.add(a, b)
                held.append((a, b))


def test_short_ip_addresses_are_candidates():
    rng = random.Random(9)
    for _ in range(300):
        x = ipaddress.IPv6Address(rng.getrandbits(128) & ~(((1 << 64) - 1) << rng.choice((16, 32, 48))))
        t = f"the server {x} is down"
        assert ("ip", 11, 11 + len(str(x))) in pii.candidates(t), t
    model = pii.fit()
    assert [k for k, *_ in model.added("server at 2001:db8::1 is down", [])] == ["ip"]
    assert model.added("call std::vector a::b at 12:30", []) == []


# Languages


def plain_bayes(training, texts):
    """Naive Bayes by dictionaries: totals of each language for each text."""
    lower = lambda t: "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    bucket = {}

    def grams(t):
        x = np.array([ord(c) for c in lower(t)], np.uint32)
        for n in langid.ORDERS:
            for i in range(len(x) - n + 1):
                key = tuple(x[i : i + n].tolist())
                if key not in bucket:
                    bucket[key] = int([g for k, g in zip(langid.ORDERS, langid.grams(np.array(key, np.uint32)), strict=True) if k == n][0][0])
                yield bucket[key]

    counts, seen = defaultdict(Counter), Counter()
    for t, lang in training:
        counts[lang].update(grams(t))
        seen[lang] += 1
    size = {lang: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for lang, c in counts.items()}
    docs = sum(seen.values()) + langid.SMOOTHING * len(seen)
    return [{lang: math.log((seen[lang] + langid.SMOOTHING) / docs) + sum(n * math.log((counts[lang][g] + langid.SMOOTHING) / size[lang]) for g, n in Counter(grams(t)).items()) for lang in sorted(counts)} for t in texts]


def test_language_against_plain_bayes(spark):
    """Three languages that share an alphabet, with different frequencies of pairs; one with accents; a rare one."""
    rng = random.Random(4)
    syllables = {"aa": ["ba", "da", "ne", "lo"], "bb": ["ab", "ad", "en", "ol"], "cc": ["ba", "ad", "én", "Öl"]}
    text = lambda lang, k: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(k))
    rows = [(i, text(lang, rng.randint(1, 12)), lang) for i, lang in enumerate(rng.choice(("aa", "aa", "aa", "bb", "cc")) for _ in range(150))]
    training, probes = rows[:100], rows[100:] + [(900, "ba ½ ab", None), (901, "½²Ⅷ 12", None), (902, "", None), (903, None, None), (904, "ل", None)]
    schema = "doc_id long, text string, lang string"
    model = langid.learn(spark.createDataFrame(training, schema).repartition(3))
    want = plain_bayes([(t, lang) for _, t, lang in training], [t or "" for _, t, _ in probes])
    frame = spark.createDataFrame(probes, schema).repartition(2)
    for block in (256, 1):  # all languages at once, and one at a time
        got = {r.doc_id: r for r in langid.predict(frame, model, block=block).collect()}
        assert len(got) == len(probes) and model.temperature >= 1
        for (i, t, _), z in zip(probes, want, strict=True):
            if not any(c.isalpha() for c in t or ""):
                assert got[i].lang_pred == "und" and got[i].score == 0
                continue
            best = max(z, key=z.get)
            share = 1 / sum(math.exp((x - z[best]) / model.temperature) for x in z.values())
            assert got[i].lang_pred == best and abs(got[i].score - share) < 1e-3, t
    right = [got[i].lang_pred == lang for i, _, lang in rows[100:]]
    assert np.mean(right) > 0.85
    assert len({round(r.score, 3) for r in got.values()}) > 5  # short texts are less sure


# Secrets


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    key = "AKIA" + "Q" * 16
    history = spark.createDataFrame([("a.txt", 1, f"x {key}"), ("a.txt", 2, "clean"), ("b.txt", 1, f"x {key}"), ("c.txt", 1, None)], "doc_id string, version int, text string")
    found, known = secrets.scan_incremental(history, ledger, more=("version",))
    assert {(r.doc_id, r["version"]) for r in found.collect() if r.spans} == {("a.txt", 1), ("b.txt", 1)}
    rows = lambda: spark.read.schema(secrets.LEDGER).parquet(ledger.path).count()
    assert rows() == known.count() == 3
    again, _ = secrets.scan_incremental(history, ledger, more=("version",))
    assert rows() == 3 and Counter(again.select("doc_id", "version", "blob").collect()) == Counter(found.select("doc_id", "version", "blob").collect())
    later = history.union(spark.createDataFrame([("a.txt", 3, "token = abcdefghijklmnop")], history.schema))
    assert {r.doc_id for r in secrets.scan_incremental(later, ledger)[0].collect() if r.spans} == {"a.txt", "b.txt"} and rows() == 4
    fewer = secrets.RULES[:2]
    assert secrets.version_of(rules=fewer) != secrets.version_of()
    secrets.scan_incremental(later, ledger, rules=fewer)
    assert rows() == 8  # changed rules scan every blob again
    assert secrets.Ledger(spark, str(tmp_path / "none")).read(secrets.version_of()).count() == 0


def test_the_session_names_a_durable_ledger(spark, tmp_path):
    from latticework.llm import queries

    spark.createDataFrame([(1, "password: abcdefghijklmnop"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert secrets.configured(spark) is None
    spark.conf.set(secrets.SETTING, str(tmp_path / "ledger"))
    try:
        one = Counter(queries.op9_secrets(spark, str(tmp_path)).collect())
        assert Counter(queries.op9_secrets(spark, str(tmp_path)).collect()) == one
        assert secrets.configured(spark).read(secrets.version_of()).count() == 2
    finally:
        spark.conf.unset(secrets.SETTING)


# Quality


def test_statistics_against_plain_python():
    rng = random.Random(6)
    texts = ["", " ", "One, two! | three\n\n12 #x é", "a a b", "x" * 500] + ["".join(rng.choice("abc ABC é日\n.,!|#1") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    got = quality.statistics(*C.utf8(pa.array(texts)))
    for t, x in zip(texts, got, strict=True):
        raw = t.encode()
        w = raw.split()
        n = lambda kinds: sum(raw.count(bytes([c])) for c in kinds)  # noqa: B023, E731
        solid = max(1, len(raw) - n(b" \t\r\x0b\x0c"))
        want = [math.log1p(len(raw)), math.log1p(len(w)), np.mean([len(y) for y in w]) if w else 0, n(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / solid, n(b"0123456789") / solid, n(b"#*$%&<>@^~{}[]\\") / solid, n(b"!?") / solid, n(b"|") / solid, n(b".,;:") / solid,
                raw.count(b"\n") / max(1, len(w)), sum(c > 127 for c in raw) / solid, len(set(w)) / len(w) ** 0.8 if w else 0, np.mean([p == q for p, q in zip(w, w[1:], strict=False)]) if len(w) > 1 else 0, min(1.0, max(map(len, w)) / 200) if w else 0]
        assert np.allclose(x, want), t


def test_sample_of_labels_has_a_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or quality.Model())
    st = "struct<" + ", ".join(f"{x}: double" for x in quality.STATS) + ">"
    stats = spark.range(4000).select(F.col("id").alias("doc_id"), F.from_json(F.to_json(F.struct(*[F.col("id").cast("double").alias(x) for x in quality.STATS])), st).alias("st"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    for sample in (100, 3900, 10_000):
        quality.learn(stats, labels, sample=sample)
    assert seen == [100, 3900, 4000]


# Perplexity


def test_kneser_ney_against_plain_python(spark):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(60 + 10 * i)) for i in range(12)]
    texts = [t for t in texts if not perplexity.base_counts(*C.utf8(pa.array([t])))[4][0] * 100 > perplexity.REPEATS * len(t.split())]
    assert len(texts) > 4
    order = 3
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(99, "$$$ " * 80, "en"), (100, "short", "en")], "doc_id long, text string, lang string")
    model = perplexity.estimate(perplexity.count(docs, order), order)
    arrays = perplexity.model_block(model, ["en"], order, 0, 1)
    c = {order: Counter()}
    for t in texts:
        padded = b"\x00" * (order - 1) + t.encode()
        c[order].update(padded[i : i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        c[n] = Counter(g[1:] for g in c[n + 1])

    def probability(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        counts, ctx = c[n], g[:-1]
        total = sum(v for k, v in counts.items() if k[:-1] == ctx)
        if not total:
            return probability(g[1:])
        of = [0, *(sum(v == i for v in counts.values()) for i in (1, 2, 3, 4))]
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else None
        d = [0.0]
        for i in (1, 2, 3):
            d.append(max(0.05, min(i - 0.05, i - (i + 1) * y * of[i + 1] / of[i])) if y is not None and of[i] else i / 2)
        own = counts.get(g, 0)
        spared = sum(d[min(v, 3)] for k, v in counts.items() if k[:-1] == ctx)
        return (own - d[min(own, 3)] if own else 0) / total + spared / total * probability(g[1:])

    for g in [b"abc", b"bcd", b"a b", b"\x00\x00a", b"zab", b"abz", b"zzz", b" ab"]:
        got = float(arrays.logp("en", np.array([int.from_bytes(g, "big")], np.uint64))[0])
        assert abs(got - math.log(probability(g))) < 1e-4, g


def test_both_bands_reject(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(80, 200))), "en") for i in range(150)]
    junk = [(200 + i, " ".join(f"{x}$$$ ###" for x in rows[i][1].split()), "en") for i in range(100)]
    dull = [(500, " ".join(random.Random(1).sample(["".join(w) for w in __import__("itertools").permutations("aabbb", 4)], 60) + ["ab"]), "en")]
    easy = (501, " ".join(vocabulary[0] * (1 + i % 3) + vocabulary[1] * (i // 3 % 5) for i in range(200)), "en")
    docs = spark.createDataFrame(rows + junk + dull + [easy], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexity.quality_rules(docs, 4).collect()}
    assert all(got[r[0]].kept for r in rows)
    assert all(got[r[0]].band == "high" for r in junk if not got[r[0]].base_failed) and not any(got[r[0]].kept for r in junk)
    scored = perplexity.judge(perplexity.score(docs, perplexity.estimate(perplexity.count(docs, 4), 4), 4), lower=1.0)
    assert {r.band for r in scored.collect()} >= {"low", "high", None}


# Very long texts


def test_texts_longer_than_a_working_chunk(spark):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 8))) for _ in range(20_000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(450_000))
    assert len(long.encode()) > C.CHUNK_BYTES
    tail = long.rsplit(" ", 40)[-40:]
    docs = spark.createDataFrame([(1, long, "en"), (2, "before " + " ".join(tail) + " after", "fr"), (3, None, None), (4, long + " x", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 40 and got[4].kept_text == "" or got[4].n_words - got[4].n_removed <= 1
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    bench = spark.createDataFrame([(7, " ".join(tail[-12:]))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in postings.contamination(docs, bench).collect()} == {1: 12, 2: 12, 3: 0, 4: 12}
    assert {r.doc_id for r in langid.identify(docs, F.lit(True)).collect() if r.lang_pred == "en"} >= {1, 4}
    scored = {r.doc_id: r for r in perplexity.quality_rules(docs, 3).collect()}
    assert scored[1].n_words == 450_000 and scored[4].n_words == 450_001
    parts, placed = packing.pack(docs)
    sizes = {r.doc_id: r["n"] for r in parts.join(placed, "uid").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes[4] > sizes[1] > 450_000 and sizes[3] == 1
