import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import metrics as M
from latticework.functions import vectortext as T
from latticework.operators import ann, auth, catalog, kv, management, vectors
from latticework.plans import catalogue
from latticework.plans import engine as engine_module
from latticework.plans.engine import Engine, Query
from latticework.sources import stores
from latticework.streaming import upsert


def ramp(spark, n=100):
    return spark.createDataFrame([(1000 + i, [float(i + j) for j in range(4)]) for i in range(n)], "id long, vector array<float>")


def test_index_grammar(spark):
    good = {f"{b}{2**k}" for b in ("HNSW", "IVF", "PQ") for k in range(1, 9)} | {"Flat", "IVF32,Flat", "HNSW64,Flat", "PQ8,Flat", "IVF64,PQ16", "HNSW128,PQ32", " HNSW32 ", " HNSW32 , Flat ", "Flat,Flat"}
    bad = {f"{b}{n}" for b in ("HNSW", "IVF", "PQ") for n in ("", 1, 3, 7, 512)} | {"Flat32", "IVF32,Invalid", "Invalid,Flat", "HNSW,Flat", "IVF,Flat", "PQ,Flat", "Flat32,Flat", "", ",", "HNSW32,,Flat", "Invalid", "Unknown32", "hnsw32"}
    rows = spark.createDataFrame([(x,) for x in good | bad], "t string").select("t", catalog.index_type_valid(F.col("t")).alias("ok"))
    assert {r.t for r in rows.collect() if r.ok} == good


def test_power_of_two(spark):
    numbers = [*range(-1, 300), 512, 1024]
    rows = spark.createDataFrame([(n,) for n in numbers], "n int").where(catalog.power_of_two(F.col("n")))
    assert sorted(r.n for r in rows.collect()) == [2**k for k in range(1, 9)]


def test_ramp_search_and_properties(spark):
    space = ramp(spark)
    best = vectors.topk(space, [50.0, 51.0, 52.0, 53.0], 5).collect()
    assert best[0].id == 1050 and best[0].distance == 0 and best[1].distance == 4.0
    assert {r.id for r in best[1:3]} == {1049, 1051} and best[1].id == 1049
    assert vectors.topk(space, [0.0] * 4, 0).count() == 1 and vectors.topk(space, [0.0] * 4, 1000).count() == 100
    inside = {r.id for r in vectors.within(space, [50.0, 51.0, 52.0, 53.0], 16.1).collect()}
    assert {r.id for r in best if r.distance < 16.1} <= inside
    assert vectors.within(space, [50.0, 51.0, 52.0, 53.0], -1).count() == 1
    similar = vectors.topk(space, [1.0, 0.0, 0.0, 0.0], 2, "InnerProduct").collect()
    assert [r.id for r in similar] == [1099, 1098]


@pytest.mark.parametrize("metric", M.METRICS)
def test_kernel_equals_expression(spark, metric):
    rng = np.random.default_rng(3)
    rows = [(i, rng.random(8).astype(np.float32).tolist()) for i in range(40)]
    space = spark.createDataFrame(rows, "id long, vector array<float>")
    joined = vectors.knn_join(space.where("id < 5"), space.repartition(3), 4, metric, block=2).collect()
    for q in range(5):
        want = [(r.rank, r.id, r.distance) for r in vectors.topk(space, rows[q][1], 4, metric).collect()]
        assert [(r.rank, r.id, r.distance) for r in sorted(joined, key=lambda r: r.rank) if r.query_id == q] == want


def test_zero_vectors_are_not_a_number(spark):
    space = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, vector array<float>")
    for metric in ("Canberra", "BrayCurtis", "JensenShannon"):
        got = vectors.topk(space, [0.0, 0.0], 2, metric).collect()
        assert np.isnan([r.distance for r in got if r.id == 1][0])
        assert 1 not in [r.id for r in vectors.within(space, [0.0, 0.0], 9.0, metric).collect()]


def test_training_gate_and_lists(spark):
    assert [ann.required_training(t) for t in ("Flat", "HNSW32", "IVF32", "IVF32,Flat", "PQ4", "IVF256,PQ8", "HNSW8,PQ4", "IVF")] == [0, 0, 32, 32, 256, 256, 0, 0]
    space = ramp(spark)
    cs = ann.centres(space, 8).tolist()
    lists = ann.assign(space, cs)
    assert lists.count() == 100 and lists.select("list_id").distinct().count() <= 8
    q = [50.0, 51.0, 52.0, 53.0]
    assert ann.ivf_topk(lists, cs, q, 1).first().id == 1050
    assert [r.id for r in ann.ivf_topk(lists, cs, q, 3, probes=8).collect()] == [r.id for r in vectors.topk(space, q, 3).collect()]
    with pytest.raises(ValueError):
        ann.ivf_topk(lists, cs, q, 1, "L1")


def test_quantizer_recall(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    space = spark.createDataFrame(rows, "id long, vector array<float>").repartition(2)
    pq = ann.ProductQuantizer.fit(space, 16, 4, codes=32)
    codes = pq.encode(space).cache()
    hits = 0
    for q in (3, 50, 199):
        exact = {r.id for r in vectors.topk(space, rows[q][1], 10).collect()}
        hits += len(exact & {r.id for r in pq.rerank(codes, space, rows[q][1], 10, short=8).collect()})
        assert pq.topk(codes, rows[q][1], 10).count() == 10
    assert hits >= 27


@pytest.mark.parametrize("name", ["ivf_kmeans_topk", "pq_topk", "pq_rerank", "hashed_topk"])
def test_index_queries_recall(spark, name):
    where = "/root/testdata/sf0.01"
    exact_name = "topk_ip_join" if name == "pq_rerank" else "topk_l2_join"
    near = lambda q: {(r.query_id, r.id) for r in catalogue.queries()[q](spark, where).collect()}
    found, exact = near(name), near(exact_name)
    assert {q for q, _ in exact} == {q for q, _ in found} and len(found & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("metric", ["L2", "InnerProduct"])
def test_quantizer_join(spark, metric):
    """In blocks and whole it finds the same; with the whole table as its short list, what the exact join finds."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    space = spark.createDataFrame([*rows, (300, rows[7][1]), (301, None)], "id long, vector array<float>").repartition(3)
    pq = ann.ProductQuantizer.fit(space.where("vector is not null"), 8, 2, codes=16)
    coded = pq.encode(space.where("vector is not null"), "vector").cache()
    asked = space.where("id % 20 = 0 or id = 301")
    flat = lambda df: sorted((r.query_id, r.rank, r.id, r.distance) for r in df.collect())
    found = flat(pq.join(asked, coded, 5, metric))
    assert found == flat(pq.join(asked, coded, 5, metric, block=3)) and len(found) == 16 * 5
    exact = flat(vectors.knn_join(asked, space, 5, metric))
    assert flat(pq.join(asked, coded, 5, metric, share=1.0)) == exact
    assert len({x[:3] for x in found} & {x[:3] for x in exact}) >= 0.9 * len(exact)
    assert pq.join(asked.limit(0), coded, 5).isEmpty() and pq.join(asked, coded.limit(0), 5).isEmpty()


def test_hashed_join_scores_each_pair_once(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, [0.0] * 8), (61, [0.0] * 8), (62, None)]
    space = spark.createDataFrame(rows, "id long, vector array<double>")
    wide = ann.hashed_join(space, space, 5, bucket=1e9, width=1)
    exact = vectors.knn_join(space, space, 5)
    assert wide.groupBy("query_id", "id").count().where("count > 1").isEmpty()
    assert {q for q, in wide.select("query_id").distinct().collect()} == set(range(62)) and exact.count() == 62 * 5
    assert ann.hashed_join(space.limit(0), space, 5).isEmpty() and ann.hashed_join(space, space.limit(0), 5).isEmpty()


def test_list_pruning_reaches_the_scan(spark, tmp_path):
    space, path = ramp(spark), f"{tmp_path}/lists"
    cs = ann.centres(space, 4).tolist()
    ann.write_lists(space, cs, path)
    plan = ann.ivf_topk(spark.read.parquet(path), cs, [1.0, 2.0, 3.0, 4.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan or "PartitionFilters: [(list_id" in plan


@pytest.mark.parametrize("index_type, metric", [("IVF8", "L2"), ("IVF4,PQ2", "L2"), ("PQ2", "InnerProduct")])
def test_space_uses_its_index(spark, tmp_path, index_type, metric):
    """Searches of an index space: near the exact ones, with later batches, removals, restarts and compaction."""
    rng = np.random.default_rng(9)
    spots = rng.normal(size=(8, 4)) * 5
    rows = [(i, (spots[i % 8] + rng.normal(size=4)).astype(np.float32).tolist()) for i in range(320)]
    e = Engine(spark, str(tmp_path), "secret", probes=3)
    e.create_space(catalog.Space("v", catalog.VECTOR, 4, index_type, metric))
    assert e.search_topk("v", rows[0][1], 5).isEmpty()  # not trained yet
    e.insert_batch("v", spark.createDataFrame(rows, "id long, vector array<float>"))
    exact = lambda q, k: [r.id for r in vectors.topk(vectors.view(e.log("v").read()), q, k, metric).collect()]
    asked = [rows[i][1] for i in (0, 9, 77)]
    hits = lambda: sum(len(set(exact(q, 10)) & {r.id for r in e.search_topk("v", q, 10).collect()}) for q in asked)
    assert hits() >= 27
    best = exact(asked[0], 2)
    e.remove_vector("v", best[0])
    e.insert("v", 5000, [x * 1.01 for x in rows[best[1]][1]])
    e.insert("v", best[1], [-99.0] * 4)
    got = [r.id for r in e.search_topk("v", asked[0], 10).collect()]
    assert best[0] not in got and len(got) == len(set(got)) == 10
    assert (5000 in got) == (5000 in exact(asked[0], 10)) and (best[1] in got) == (best[1] in exact(asked[0], 10))
    number = e._index("v").read()[0]["number"]
    assert hits() >= 27 and e._index("v").read()[0]["number"] == number == 1
    e.compact("v")
    e = Engine(spark, str(tmp_path), "secret", probes=3)
    assert hits() >= 27 and e._index("v").read()[0]["number"] == 2
    assert best[0] not in [r.id for r in e.search_topk("v", asked[0], 10).collect()]


def test_layout():
    kinds = {"Flat": (0, 0), "IVF32": (32, 0), "IVF32,Flat": (32, 0), "PQ8": (0, 8), " IVF64 , PQ16": (64, 16), "HNSW8,PQ4": (0, 0)}
    assert {t: ann.layout(t) for t in kinds} == kinds


def test_kv_last_write_wins(spark):
    log = spark.createDataFrame([(1, "PUT", "k", "a"), (2, "PUT", "k", "b"), (1, "PUT", "gone", "x"), (2, "DEL", "gone", None), (1, "PUT", "back", "x"), (2, "DEL", "back", None), (3, "PUT", "back", ""), (1, "PUT", "r", "__deleted__")], "seq long, op string, key string, value string")
    assert {r.key: r.value for r in kv.view(log).collect()} == {"k": "b", "back": "", "r": "__deleted__"}
    assert {r.key: r.value for r in kv.view(log.union(log)).collect()} == {r.key: r.value for r in kv.view(log).collect()}
    assert kv.get_value(log, "k") == "b" and [r.key for r in kv.scan(log).collect()] == ["back", "k"]
    for key, said in (("gone", "key not found"), ("no", "key not found"), ("r", "key is deleted")):
        with pytest.raises(kv.KeyNotFound, match=said):
            kv.get_value(log, key)
    wal = spark.createDataFrame([(1, "C", "a", "1"), (2, "P", "b", "2"), (3, "D", "b", None), (4, "P", "c", "3")], "seq long, flag string, key string, value string")
    assert [(r.key, r.value) for r in kv.view(kv.replay(wal)).collect()] == [("c", "3")]


def test_engine_end_to_end(spark, tmp_path):
    e = Engine(spark, str(tmp_path), "secret")
    admin = e.users.authenticate("admin", "secret")
    run = lambda q, user=admin: json.loads(e.reply(json.dumps(q), user))
    assert run({"type": "CREATE_SPACE", "space": "kv"})["message"] == "SPACE_CREATED"
    assert run({"type": "CREATE_SPACE", "space": "kv"})["message"] == "space already exists"
    assert run({"type": "CREATE_SPACE", "space": "v", "engine_type": "vector", "dimension": 4})["status"] == "ERROR"
    assert run({"type": "CREATE_SPACE", "space": "v", "engine_type": "vector", "dimension": 4, "metric": "L2"})["status"] == "OK"
    assert run({"type": "PUT", "space": "kv", "key": "jsonKey", "value": '{"name":"test", "age":25}'})["message"] == "OK"
    run({"type": "PUT", "space": "kv", "key": "k", "value": "a"})
    run({"type": "PUT", "space": "kv", "key": "k", "value": "b"})
    assert run({"type": "GET", "space": "kv", "key": "k"})["value"] == "b"
    assert run({"type": "DELETE", "space": "kv", "key": "k"})["message"] == "DELETED"
    assert run({"type": "GET", "space": "kv", "key": "k"})["message"] == "key not found"
    e.insert_batch("v", ramp(spark))
    assert run({"type": "SEARCH_TOPK", "space": "v", "value": "50,51,52,53", "dimension": 1})["message"][0]["id"] == 1050
    assert "dimension mismatch" in run({"type": "INSERT_VECTOR", "space": "v", "key": "1", "value": "1"})["message"]
    assert run({"type": "INSERT_VECTOR", "space": "v", "key": "x", "value": "1,2,3,4"})["message"] == "invalid vector id"
    run({"type": "INSERT_VECTOR", "space": "v", "key": "1050", "value": "9,9,9,9"})
    assert run({"type": "GET_VECTOR", "space": "v", "key": "1050"})["message"].startswith("9.000000,")
    e.remove_vector("v", 1050)
    assert run({"type": "GET_VECTOR", "space": "v", "key": "1050"})["message"] == "ID 1050 not found"
    assert len(run({"type": "RANGE_SEARCH", "space": "v", "value": "50,51,52,53", "radius": 4.5})["message"]) == 2
    assert "not a" in run({"type": "GET", "space": "v", "key": "1"})["message"]
    run({"type": "CREATE_USER", "new_user": {"username": "ann", "password": "p", "permissions": {"kv": "read"}}})
    again = Engine(spark, str(tmp_path))
    ann_ = again.users.authenticate("ann", "p")
    with pytest.raises(auth.AuthError):
        again.users.authenticate("ann", "q")
    assert json.loads(again.reply('{"type": "PUT", "space": "kv", "key": "a", "value": "b"}', ann_))["message"] == "write permission denied"
    assert "{" in json.loads(again.reply('{"type": "GET", "space": "kv", "key": "jsonKey"}', ann_))["value"]
    assert [r["name"] for r in run({"type": "LIST_SPACES"})["message"]] == ["kv", "v"]
    assert run({"type": "GET_USER", "data": "ann"})["message"] == "Username: ann | Role: user | Permissions: kv=read"
    assert run({"type": "DELETE_SPACE", "data": "v"})["message"] == "SPACE_DELETED" and list(e.spaces) == ["kv"]
    assert run({"type": "NOTHING"})["message"] == "unsupported query type"


def test_point_read_opens_one_bucket(spark, tmp_path):
    log = stores.Log(spark, f"{tmp_path}/log", stores.KV_LOG, "key")
    assert log.read().count() == 0
    log.append(spark.createDataFrame([(f"k{i}", str(i)) for i in range(100)], "key string, value string"), "PUT")
    one = log.read_key("k7")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and "PartitionFilters" in plan and "EqualTo(key,k7)" in plan
    assert kv.view(log.compact(kv.view).read()).count() == 100


@pytest.mark.parametrize("name", ["", "..", ".", "users.json", "a/b", "/", "a b", "x" * 200])
def test_unsafe_space_names_are_refused(spark, tmp_path, name):
    e = Engine(spark, str(tmp_path), "secret")
    admin = e.users.authenticate("admin", "secret")
    run = lambda q: json.loads(e.reply(json.dumps(q), admin))
    e._saved("")
    assert run({"type": "CREATE_SPACE", "space": "kept"})["status"] == "OK"
    assert run({"type": "CREATE_SPACE", "space": name})["status"] == "ERROR" and list(e.spaces) == ["kept"]
    assert run({"type": "DELETE_SPACE", "data": name})["status"] == "ERROR"
    again = Engine(spark, str(tmp_path))
    assert list(again.spaces) == ["kept"] and list(again.users.rows) == ["admin"]


def test_writes_are_held_and_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine_module, "HELD", 5)
    monkeypatch.setattr(engine_module, "COMPACT", 3)
    e = Engine(spark, str(tmp_path), "secret")
    e.create_space(catalog.Space("kv"))
    e.create_space(catalog.Space("safe", enable_wal=True))
    for i in range(4):
        e.put("kv", f"k{i}", "a")
    assert len(e.held["kv"]) == 4 and e._log("kv").batches() == []
    e.put("kv", "k0", "b")  # the fifth
    assert "kv" not in e.held and len(e._log("kv").batches()) == 1
    e.put("kv", "k1", "c")
    assert e.get("kv", "k1") == "c" and e.get("kv", "k0") == "b" and "kv" not in e.held
    e.put("safe", "k", "v")
    assert len(e._log("safe").batches()) == 1
    e.delete("kv", "k2")
    e.close()
    assert e.held == {} and e._log("kv").generation() == 1 and len(e._log("kv").batches()) == 1
    assert {r.key: r.value for r in Engine(spark, str(tmp_path)).kv_view("kv").collect()} == {"k0": "b", "k1": "c", "k3": "a"}
    e.put("kv", "k3", "d")
    assert e.get("kv", "k3") == "d" and e.kv_view("kv").count() == 3


def test_two_writers_with_one_clock(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores.time, "time_ns", lambda: 7)
    one, two = (stores.Log(spark, f"{tmp_path}/log", stores.KV_LOG, "key") for _ in range(2))
    frame = lambda *rows: spark.createDataFrame(rows, "key string, value string").coalesce(1)
    one.append(frame(("a", "1"), ("a", "2"), ("b", "1")), "PUT")
    two.append(frame(("a", "3")), "PUT")
    one.append(frame(("b", "4"), ("b", "5")), "PUT")
    assert {r.key: r.value for r in kv.view(one.read()).collect()} == {"a": "3", "b": "5"}
    assert one.batches() == [1, 2, 3]
    folder = stores.Folder(spark, f"{tmp_path}/log/_batches")
    assert not folder.claim(f"{3:012d}") and folder.claim(f"{4:012d}") and one.next_batch() == 5


def test_an_untrained_space_gives_no_vectors(spark, tmp_path):
    e = Engine(spark, str(tmp_path), "secret")
    e.create_space(catalog.Space("v", "vector", 2, "IVF2", "L2"))
    e.insert("v", 1, [0.0, 1.0])
    with pytest.raises(kv.KeyNotFound):
        e.get_vector("v", 1)
    e.insert("v", 2, [1.0, 1.0])
    assert e.get_vector("v", 1) == [0.0, 1.0]
    with pytest.raises(ValueError):
        e.use_space("none")
    assert e.current is None


def test_range_join_equals_single_searches(spark):
    s = ramp(spark)
    got = {(r.query_id, r.id, r.distance) for r in vectors.range_join(s.where("id % 20 = 0"), s, 50.0, block=2).collect()}
    want = {(q.id, r.id, r.distance) for q in s.where("id % 20 = 0").collect() for r in vectors.within(s, list(q.vector), 50.0).collect()}
    assert got == want and want


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", i % 5, "view" if i % 3 else "click") for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
    for part in range(2):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        upsert.upsert_stream(upsert.kv_stream(stream), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    got = {r.key: r.value for r in kv.view(spark.read.parquet(f"{tmp_path}/log")).collect()}
    assert got == {r.key: r.value for r in kv.view(upsert.kv_stream(events)).collect()} and spark.read.parquet(f"{tmp_path}/log").count() == 40


def test_text_forms(spark):
    row = spark.createDataFrame([("1, 2.5 ,-3e2", [0.5, -1.0])], "t string, v array<float>").select(T.parse(F.col("t"), 3).alias("p"), T.parse(F.col("t"), 2).alias("q"), T.formatted(F.col("v")).alias("f")).first()
    assert row.p == [1.0, 2.5, -300.0] and row.q is None and row.f == "0.500000,-1.000000"
    assert T.results_json(spark.createDataFrame([], "rank long, id long, distance double")).first().results == "[]"


def test_text_rounds_as_sql(spark):
    """Multiples of 1/128 end in a 5 at the seventh decimal: SQL takes the even digit."""
    import duckdb

    vs = [[x / 128 for x in range(-9, 10, 2)], [0.1234565, 1e-9, -1e-9, 5e-7, 1e23, 2.5, 12345678.0078125], [float("inf"), -float("inf"), float("nan"), 0.0, -0.0], []]
    rows = spark.createDataFrame(list(enumerate(vs)), "id long, v array<double>")
    got = [r.t for r in rows.select("id", T.formatted(F.col("v")).alias("t")).orderBy("id").collect()]
    text = "select coalesce(array_to_string(list_transform($v::double[], lambda x: printf('%.6f', x)), ','), '')"
    assert got == [duckdb.execute(text, {"v": v}).fetchone()[0] for v in vs] and got[0].startswith("-0.070312,-0.054688")
    assert spark.createDataFrame([(None,)], "v array<float>").select(T.formatted(F.col("v")).alias("t")).first().t is None


def test_limiter(spark, tmp_path):
    x = management.Limiter(2)
    assert x.acquire() and x.acquire() and not x.acquire() and x.warning()
    with pytest.raises(ValueError):
        x.update(1)
    x.increase()
    x.save(spark, f"{tmp_path}/limit")
    assert management.Limiter.load(spark, f"{tmp_path}/limit").most == 102 and management.Limiter.load(spark, f"{tmp_path}/none").most == 1000
    assert x.stats(spark).first().available_slots == 100


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["ivf_kmeans_topk", "pq_topk"])
def test_index_queries_find_most_neighbours_of_every_query(spark, name):
    where = "/root/testdata/sf0.1"
    s = catalogue.space(spark, where)
    exact = {(r.query_id, r.id) for r in vectors.knn_join(s.where("id % 20 = 0"), s, 10).collect()}
    found = {(r.query_id, r.id) for r in catalogue.queries()[name](spark, where).collect()}
    recall = len(exact & found) / len(exact)
    print(name, "recall", recall)
    assert len(found) == len(exact) and recall >= 0.9


def test_parsed_text_is_what_sql_parses(spark):
    """The text of 9/128 is that of SQL, so its number is too."""
    rows = spark.createDataFrame([(1, [9 / 128, -1 / 128])], "id long, v array<float>")
    got = rows.select(T.parse(T.formatted(F.col("v")), 2).alias("v")).first().v
    assert got == [np.float32("0.070312"), np.float32("-0.007812")]
