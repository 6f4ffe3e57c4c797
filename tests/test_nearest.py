import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import metrics as M
from latticework.operators import ann, nearest, vectors


def brute(metric, ids, q, v, k):
    """(ids, keys) of all pairs scored exactly."""
    d = nearest.block_distances(metric, q.astype(np.float64), v.astype(np.float64))
    d = np.where(np.isnan(d), np.inf, -d if metric == "InnerProduct" else d)
    order = np.array([np.lexsort((ids, x))[:k] for x in d])
    return ids[order], np.take_along_axis(d, order, 1)


def odd(metric, kind):
    """Vectors with copies, near copies and zeros; 9000 rows are several tiles."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(9000, 12))
    v = np.abs(v) if metric == "JensenShannon" and kind != "negative" else v
    v[5000:5600] = v[3]
    v[6000:6300] = v[4] * (1 + 1e-7 * rng.random((300, 1)))
    if kind == "zeros":
        v[7000:7020], v[8000:8500, 2] = 0.0, 0.0
    return (v * 1e-9 if kind == "small" else v).astype(np.float64 if kind == "double" else np.float32)


@pytest.mark.parametrize("kind", ["single", "double", "zeros", "small", "negative"])
@pytest.mark.parametrize("metric", M.METRICS)
def test_best_equals_brute_force(metric, kind):
    v = odd(metric, kind)
    ids = np.random.default_rng(5).permutation(len(v)).astype(np.int64)
    asked = np.r_[0:30, 5000:5005, 6000:6005, 7000:7003, 8000:8003]
    best = nearest.Best(ids[asked], v[asked], 7, metric)
    for part in np.array_split(np.arange(len(v)), 3):
        some = part[best.worth(ids[part], v[part])]
        best.add(ids[some], v[some])
    want_id, want_key = brute(metric, ids, v[asked], v, 7)
    assert np.array_equal(best.key[best.group], want_key)
    assert np.array_equal(best.id[best.group], want_id)


@pytest.mark.parametrize("metric", M.METRICS)
def test_memory_of_a_task_does_not_grow_with_pairs(metric):
    """4096 queries and 2048 rows took several arrays of 64 MB, one number for each pair."""
    v = np.abs(np.random.default_rng(6).normal(size=(6144, 8))).astype(np.float32)
    tracemalloc.start()
    best = nearest.Best(np.arange(4096), v[:4096], 10, metric)
    best.add(np.arange(2048), v[4096:])
    assert sum(b.num_rows for b in best.batches()) == 40960
    assert sum(len(x) for x, _, _ in nearest.within(v[:4096], v[4096:], 0.1, metric)) >= 0
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48e6


def test_jensenshannon_by_a_matrix_product():
    """There was a logarithm for each element of each pair; the bound holds for copies, far sizes and zeros."""
    v = np.abs(np.random.default_rng(10).normal(size=(3000, 64))).astype(np.float32)
    v[:300] *= np.float32(1e-7)
    v[300:400, ::2] *= np.float32(1e-12)
    v[400:410, 3] = 0
    rough = nearest.Rough("JensenShannon", v[:500], v, 0.0)
    key, exact = rough.tile(0, 500, 0, 3000), nearest.block_distances("JensenShannon", v[:500].astype(np.float64), v.astype(np.float64))
    assert rough.product and np.array_equal(np.isnan(key), np.isnan(exact))
    assert np.nanmax(np.abs(key - exact) / rough.slack[:, None]) <= 1
    u = np.linspace(0, 60, 100_001)
    f = (np.log(2) - np.logaddexp(0, -u)) / (1 + np.exp(-u)) + (np.log(2) - np.logaddexp(0, u)) / (1 + np.exp(u))
    fit = nearest.WAVES[0] + sum(w * np.cos(j * nearest.PITCH * u) / np.cosh(u / 2) for j, w in enumerate(nearest.WAVES[1:]))
    assert np.abs(f - fit).max() < nearest.FIT


@pytest.mark.parametrize("metric", ["L2", "InnerProduct", "JensenShannon"])
def test_long_rows_leave_the_bound_of_others(metric, monkeypatch):
    """One row a thousand times as long made the bound so wide that all pairs of its slab were scored exactly."""
    v = np.abs(np.random.default_rng(12).normal(size=(6000, 16))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[[70, 4000]] *= np.float32([[1e3], [1e-7]])
    v[5000] *= np.float32(1e6)
    ids, asked = np.arange(len(v))[::-1].copy(), np.r_[0:40, 70, 4000]
    scored, pairs = [], nearest.pair_distances
    monkeypatch.setattr(nearest, "pair_distances", lambda m, q, v, p=0.0: scored.append(len(q)) or pairs(m, q, v, p))
    best = nearest.Best(ids[asked], v[asked], 7, metric)
    some = best.worth(ids, v)
    best.add(ids[some], v[some])
    want_id, want_key = brute(metric, ids, v[asked], v, 7)
    assert np.array_equal(best.key[best.group], want_key) and np.array_equal(best.id[best.group], want_id)
    assert sum(scored) < 0.2 * len(asked) * len(v)
    if metric == "JensenShannon":
        return
    scored.clear()
    radius, d = 0.3, nearest.block_distances(metric, v[asked].astype(np.float64), v.astype(np.float64))
    x, y, got = map(np.concatenate, zip(*nearest.within(v[asked], v, radius, metric), strict=True))
    order, (a, b) = np.lexsort((y, x)), np.nonzero(d > radius if metric == "InnerProduct" else d < radius)
    assert np.array_equal(x[order], a) and np.array_equal(y[order], b) and np.array_equal(got[order], nearest.rounded(d[a, b]))
    assert sum(scored) < 0.2 * len(asked) * len(v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_pairs_do_not_go_through_a_shuffle(spark):
    """Lists and cells are searched in blocks: no join makes a row of each pair."""
    space = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "id long, vector array<float>")
    cs = [[0.0, 0.0], [3.0, 3.0], [6.0, 1.0]]
    for found in (ann.ivf_join(space.where("id < 9"), ann.assign(space, cs), cs, 3, probes=2), ann.hashed_join(space.where("id < 9"), space, 3)):
        assert "Join" not in plan_of(found) and found.count() == 27


def test_one_pass_for_many_queries(spark):
    space = spark.range(6000).select("id", F.array(*[F.sin(F.col("id") * j).cast("float") for j in range(1, 4)]).alias("vector"))
    found = vectors.knn_join(space, space, 2)
    assert plan_of(found).count("MapInArrow") == 1 and found.where("rank = 1 and id = query_id and distance = 0").count() == 6000


@pytest.mark.parametrize("metric", ["L2", "InnerProduct"])
def test_list_join_equals_lists_searched_one_by_one(spark, metric):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(200)] + [(200, None)]
    space = spark.createDataFrame([*rows, (201, rows[5][1])], "id long, vector array<float>").repartition(3)
    cs = ann.centres(space.where("vector is not null"), 6).tolist()
    lists = ann.assign(space.where("vector is not null"), cs).cache()
    found = ann.ivf_join(space.where("id % 40 = 0"), lists, cs, 4, metric, probes=2, block=2).collect()
    for q in range(0, 200, 40):
        want = [tuple(r) for r in ann.ivf_topk(lists, cs, rows[q][1], 4, metric, probes=2).collect()]
        assert sorted(tuple(r)[1:] for r in found if r.query_id == q) == want
    assert {r.query_id for r in found} == set(range(0, 200, 40))


def test_hashed_join_finds_what_shares_a_cell(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 6)).astype(np.float32)
    v[100:140] = v[7]
    space = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>").repartition(3)
    found = {(r.query_id, r.rank): r.id for r in ann.hashed_join(space.where("id % 20 = 0 or id = 7"), space, 5, tables=3, width=3, block=4).collect()}
    cells, ids = ann.cells_of(v, 3, 3, 1.0), np.arange(300)
    for q in [7, *range(0, 300, 20)]:
        near = ids[(cells == cells[q]).any(1)]
        want = brute("L2", near, v[q : q + 1], v[near], 5)[0][0]
        assert [found.get((q, i + 1)) for i in range(5)] == [*want, *[None] * (5 - len(want))]


def test_one_search_for_many_queries_by_codes(spark):
    space = spark.range(1200).select("id", F.array(*[F.sin(F.col("id") * j).cast("float") for j in range(1, 5)]).alias("vector")).cache()
    pq = ann.ProductQuantizer.fit(space, 4, 2, codes=8)
    found = pq.join(space, pq.encode(space, "vector"), 3)
    assert plan_of(found).count("MapInArrow") == 1 and found.count() == 3600


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(11)
    tie = (rng.integers(0, 10**7, 3000) + 0.5) / 1e6
    d = np.concatenate([rng.random(3000) * 9, tie, np.nextafter(tie, 9), np.nextafter(tie, 0), tie * 2.0**20, 10 ** rng.uniform(-12, 300, 3000), [0.0, -0.0, 1e-7, 5e-7, np.inf, np.nan]])
    d = np.concatenate([d, -d])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(d.tolist())], "i long, d double").coalesce(1)
    want = df.select(F.round("d", 6).alias("d")).toArrow()["d"].to_numpy()
    assert np.array_equal(nearest.rounded(d), want, equal_nan=True)


@pytest.mark.parametrize("kind", ["single", "double", "zeros", "small", "infinite"])
@pytest.mark.parametrize("metric", ["L2", "InnerProduct", "L1", "Linf"])
def test_within_equals_brute_force(metric, kind, monkeypatch):
    """Only pairs that the product leaves open are scored term by term."""
    v = odd(metric, kind)
    if kind == "infinite":
        v[10, 2], v[11, 3], v[12:14, 4] = np.inf, np.nan, (3e38, -3e38)
    q, exact = v[:40], []
    d = nearest.block_distances(metric, q.astype(np.float64), v.astype(np.float64))
    radius = float(np.partition(d[np.isfinite(d)], 9000)[9000])  # the distance of some pair
    scored = nearest.pair_distances
    monkeypatch.setattr(nearest, "pair_distances", lambda m, a, b, p=0.0: (exact.append(len(a)), scored(m, a, b, p))[1])
    with np.errstate(invalid="ignore"):
        x, y = np.nonzero(d > radius if metric == "InnerProduct" else d < radius)
    found = sorted((int(i), int(j), float(r)) for part in nearest.within(q, v, radius, metric) for i, j, r in zip(*part, strict=True))
    assert found == list(zip(x.tolist(), y.tolist(), nearest.rounded(d[x, y]).tolist(), strict=True))
    if kind in ("single", "double"):
        assert sum(exact) < 2000


def test_range_join_has_no_decimal_arithmetic_for_each_row(spark):
    """Spark's round makes a BigDecimal of each of the rows, which may be a tenth of all pairs."""
    space = spark.range(300).select("id", F.array(*[F.sin(F.col("id") * j).cast("float") for j in range(1, 4)]).alias("vector"))
    found = vectors.range_join(space.where("id % 20 = 0"), space, 0.5)
    want = space.alias("a").where("a.id % 20 = 0").crossJoin(space.alias("b")).select(F.col("a.id").alias("q"), F.col("b.id"), M.distance("L2", F.col("b.vector"), F.col("a.vector")).alias("d"))
    assert "round" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.where("d < 0.5").select("q", "id", F.round("d", 6)).collect()))
