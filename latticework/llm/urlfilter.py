"""URL filters by a Bloom filter cascade, in DataFrame expressions only.

Level 1 is a Bloom filter of the listed keys. Level 2 encodes those keys of the corpus's complete key
universe that pass level 1 without being listed, level 3 the listed keys that pass level 2, and so on until no key is
left over. For any key of that universe the first level that it fails tells exactly whether it is listed,
with no join: the bits are literals of the plan, one for each level. The false-positive rate of level 1 is set so that
level 2 has about as many keys as are listed, so the bits are bounded by the size of the list, however large the
universe is. A list of more than MOST keys is cut by a hash of the key: each part has its own cascade over its part of the
universe, up to PARTS of them; beyond MOST * PARTS keys, where the bits would no longer be small, the keys are
looked up by a join, with equal results.

Rules are keys `host` + `path prefix`; the keys of a url are its host and parent domains, with as many
labels as any rule or listed host has, followed by path prefixes of the rules' lengths. The longest listed key wins.
Urls without a rule are blocked if their host or a parent domain is on the host list, else allowed. The rules are few and
given as pairs; the host list may be a sequence or a table of any size.

Nulls: a null url, or one without `://`, has an empty host and path, so no rule; it is allowed. Rows with a
null or repeated page_id stay. Null hosts of a list are left out, repeated ones count once. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

#: Listed keys of one cascade at most (2 million keys are about 6 MB of bits), and cascades of a plan.
MOST, PARTS = 2_000_000, 8

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Hosts that are blocked with all subdomains where no rule says otherwise.
BLOCKED_HOSTS = ("casino-win.example.com", "free-bets.example.com", "ads-track.example.com", "spam-farm.example.com", "cheap-pills.example.com", "adult-x.example.net")


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: str  # the bits, as comma-separated longs

    def contains(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        places = F.array(*[place(key, self.seed, i, self.bits) for i in range(self.hashes)])
        return F.forall(places, lambda at: F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)


def place(key: Column, seed: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1000 * seed + i)), F.lit(bits).cast("long"))


def encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the n keys (column key)."""
    bits = max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(bits / max(n, 1) * math.log(2)))
    hashes = min(hashes, 30)
    at = keys.select(F.explode(F.array(*[place(F.col("key"), seed, i, bits) for i in range(hashes)])).alias("p"))
    words = at.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = dict(words.collect())  # one row of 64 bits each: bounded by MOST
    return Level(bits, hashes, seed, ",".join(str(found.get(k, 0)) for k in range(bits // 64)))


@dataclass
class Cascade:
    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].contains(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def part_of(key: Column, parts: int) -> Column:
    """The part of the list that a key belongs to."""
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(parts))


@dataclass
class Parted:
    """A cascade for each part of the keys."""

    cascades: list[Cascade]

    def contains(self, key: Column) -> Column:
        if len(self.cascades) == 1:
            return self.cascades[0].contains(key)
        out = F.lit(False)
        for k, cascade in enumerate(self.cascades):
            out = F.when(part_of(key, len(self.cascades)) == k, cascade.contains(key)).otherwise(out)
        return out


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the listed keys over a universe, both with one column key."""
    listed = C.materialize(listed.where("key is not null").select("key").distinct(), "listed")
    universe = C.materialize(universe.where("key is not null").select("key").distinct(), "universe")
    r, s = listed.count(), universe.count()
    inside, outside, levels = listed, None, []
    n = r
    while n:
        k = len(levels)
        rate = min(0.5, r / (math.sqrt(2) * max(s, 1))) if k == 0 else 0.5
        levels.append(encode(inside, n, rate, k + 1))
        if outside is None:
            outside = universe.where(levels[0].contains(F.col("key"))).join(listed, "key", "left_anti")
        else:
            outside = outside.where(levels[k].contains(F.col("key")))
        outside = C.materialize(outside, f"cascade-{k + 1}")
        inside, outside, n = outside, inside, outside.count()
    return Cascade(levels)


def build_parted(listed: DataFrame, universe: DataFrame, most: int, parts: int) -> Parted | None:
    """Cascades of at most about `most` keys each, or None if that takes more than `parts` of them."""
    listed = C.materialize(listed.where("key is not null").select("key").distinct(), "listed")
    need = max(1, -(-listed.count() // most))
    if need > parts:
        return None
    mine = lambda keys, k: keys if need == 1 else keys.where(part_of(F.col("key"), need) == k)
    return Parted([build(mine(listed, k), mine(universe, k)) for k in range(need)])


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys under which a url could be listed, as an array: for each shape (labels, path length) of a listed key."""
    keys = [F.when((F.length(path) >= n) & (host != ""), F.concat(F.substring_index(host, ".", -m), F.substring(path, 1, n) if n else F.lit(""))) for m, n in shapes]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1)


def joined(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows with found, the listed ones among their keys, by a join of the different keys."""
    every = C.materialize(rows.select("keys").distinct().withColumn("key", F.explode("keys")), "keys")
    hits = every.join(listed.select("key").distinct(), "key", "left_semi").groupBy("keys").agg(F.collect_set("key").alias("found"))
    return rows.join(hits, "keys", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def judge(pages: DataFrame, rules=RULES, blocked: Sequence[str] | DataFrame = BLOCKED_HOSTS, id_col: str = "page_id", url_col: str = "url", most: int = MOST, parts_: int = PARTS) -> DataFrame:
    """(page_id, host, path, rule, listed_host, verdict) of every row. rules is a short, given list, and its verdicts are part
    of the plan; blocked is a sequence of hosts or a table with a column host."""
    spark = pages.sparkSession
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    verdicts = dict(rules)
    one = lambda xs, name: spark.range(1).select(F.explode(F.array(*map(F.lit, xs)).cast("array<string>")).alias(name))
    hosts = blocked.select("host") if isinstance(blocked, DataFrame) else one(blocked, "host")
    hosts = C.materialize(hosts.where("host is not null and host <> ''").distinct(), "blocked-hosts")
    labels = [r["n"] for r in hosts.select((F.size(F.split("host", "[.]"))).alias("n")).distinct().collect()]  # a few small numbers
    shapes = {(n, 0) for n in labels} | {(k.partition("/")[0].count(".") + 1, len(k) - len(k.partition("/")[0])) for k in verdicts}
    rows = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), sorted(shapes)))
    listed = hosts.select(F.col("host").alias("key")).union(one(list(verdicts), "key"))
    cascades = build_parted(listed, rows.select(F.explode("keys").alias("key")), most, parts_)
    found = rows.withColumn("found", F.filter("keys", cascades.contains)) if cascades else joined(rows, listed)
    is_rule = lambda x: F.contains(x, F.lit("/"))
    first = lambda c: F.get(c, F.lit(0))
    order = lambda which: F.array_sort(F.filter("found", which), lambda a, b: F.length(b) - F.length(a))
    found = found.withColumn("rule", first(order(is_rule))).withColumn("listed_host", first(order(lambda x: ~is_rule(x))))
    verdict = F.lit(None).cast("string")
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    other = F.when(F.col("listed_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", "listed_host", F.coalesce(verdict, other).alias("verdict"))
