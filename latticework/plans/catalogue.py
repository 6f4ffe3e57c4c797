"""Every query by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import metrics as M
from latticework.functions import vectortext as T
from latticework.operators import ann, auth, catalog, kv, management, vectors

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The stored vector that the searches look for, and the query of the inverted-list search.
QUERY_ID, IVF_QUERY_ID, LISTS = 7, 77, 16
#: Lists that the search of 32 lists reads for each query.
PROBES = 24


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def space(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def spread(s: DataFrame) -> DataFrame:
    """Over all cores; a small file is one partition."""
    return s.repartition(s.sparkSession.sparkContext.defaultParallelism)


def stored(s: DataFrame, id: int) -> list[float]:
    return list(vectors.get(s, id).first()["vector"])


# Vector searches

EMB = "cast(embedding as double[])"
Q = f"(select {EMB} as q from embeddings where vec_id = {QUERY_ID})"


def ranked(dist: str, k: int, order: str = "asc", table: str = "embeddings", where: str = "") -> str:
    return f"""with s as (select vec_id as id, {dist} as d from {table}, {Q} {where}), r as (select row_number() over (order by d {order}, id) as rank, id, round(d, 6) as distance from s)
        select cast(rank as bigint) as rank, id, distance from r where rank <= {k}"""


NAMES = {"L2": "l2", "InnerProduct": "ip", "L1": "l1", "Linf": "linf", "Lp": "lp0", "Canberra": "canberra", "BrayCurtis": "braycurtis", "JensenShannon": "jensenshannon"}


def add_topk(metric: str, name: str) -> None:
    positive = metric == "JensenShannon"  # needs positive elements
    side = "list_transform(cast(embedding as double[]), lambda x: abs(x))" if positive else EMB
    q = "list_transform(q, lambda x: abs(x))" if positive else "q"

    @query(f"topk_{name}", ranked(M.sql(metric, side, q), 10, "desc" if M.similarity(metric) else "asc"))
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = space(spark, d)
        v = stored(s, QUERY_ID)
        if positive:
            s, v = s.withColumn("vector", F.transform("vector", F.abs)), [abs(x) for x in v]
        return vectors.topk(s, v, 10, metric)


for _metric, _name in NAMES.items():
    add_topk(_metric, _name)


@query("topk_default_k", ranked(M.sql("L2", EMB, "q"), 1))
def topk_default_k(spark: SparkSession, d: str) -> DataFrame:
    s = space(spark, d)
    return vectors.topk(s, stored(s, QUERY_ID), 0)


def add_range(name: str, metric: str, radius: float, shown: float) -> None:
    test = f"d > {shown}" if M.similarity(metric) else f"d < {shown}"

    @query(name, f"with s as (select vec_id as id, {M.sql(metric, EMB, 'q')} as d from embeddings, {Q}) select id, round(d, 6) as distance from s where {test}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = space(spark, d)
        return vectors.within(s, stored(s, QUERY_ID), radius, metric)


for _args in (("range_l2", "L2", 1.7, 1.7), ("range_ip", "InnerProduct", 0.15, 0.15), ("range_l1", "L1", 8.3, 8.3), ("range_linf", "Linf", 0.37, 0.37), ("range_default_radius", "L2", 0.0, 1.0)):
    add_range(*_args)


@query("get_vector", f"select vec_id as id, embedding as vector from embeddings where vec_id = {QUERY_ID}")
def get_vector(spark: SparkSession, d: str) -> DataFrame:
    return vectors.get(space(spark, d), QUERY_ID).select("id", "vector")


@query("format_vector", "select vec_id as id, array_to_string(list_transform(cast(embedding as double[]), lambda x: printf('%.6f', x)), ',') as text from embeddings")
def format_vector(spark: SparkSession, d: str) -> DataFrame:
    return space(spark, d).select("id", T.formatted(F.col("vector")).alias("text"))


@query("parse_vector", "select vec_id as id, list_transform(string_split(array_to_string(list_transform(cast(embedding as double[]), lambda x: printf('%.6f', x)), ','), ','), lambda x: cast(x as float)) as vector from embeddings")
def parse_vector(spark: SparkSession, d: str) -> DataFrame:
    text = space(spark, d).select("id", T.formatted(F.col("vector")).alias("text"))
    return text.select("id", T.parse(F.col("text"), 64).alias("vector"))


@query("parse_errors", "select * from (values (1, null), (2, 'vector dimension mismatch: expected 3, got 2'), (3, 'invalid float at position 1'), (4, 'vector dimension mismatch: expected 3, got 1')) t(id, error)")
def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "1, 2.5 ,-3e2"), (2, "1,2"), (3, "1,x,3"), (4, "")], "id int, text string")
    return rows.select("id", T.parse_error(F.col("text"), 3).alias("error"))


@query("format_results", f"""with r as ({ranked(M.sql('L2', EMB, 'q'), 10)})
    select '[' || string_agg('{{"id": ' || id || ', "distance": ' || printf('%.6f', distance) || '}}', ', ' order by rank) || ']' as results from r""")
def format_results(spark: SparkSession, d: str) -> DataFrame:
    s = space(spark, d)
    return T.results_json(vectors.topk(s, stored(s, QUERY_ID), 10))


# Vector logs: every id is inserted; ids divisible by 5 are inserted again with the next vector's elements
# reversed; ids divisible by 7 are removed after that; ids divisible by 35 are inserted once more.

VECTOR_LOG = """with log as (
    select 1 as seq, 'PUT' as op, vec_id as id, embedding as vector from embeddings
    union all select 2, 'PUT', vec_id, list_reverse(embedding) from embeddings where vec_id % 5 = 0
    union all select 3, 'DEL', vec_id, null from embeddings where vec_id % 7 = 0
    union all select 4, 'PUT', vec_id, embedding from embeddings where vec_id % 35 = 0),
    live as (select id, vector from (select *, row_number() over (partition by id order by seq desc) as n from log) where n = 1 and op = 'PUT')"""


def vector_log(s: DataFrame) -> DataFrame:
    row = lambda seq, op, v, rows: rows.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), "id", v.alias("vector"))
    v = F.col("vector")
    out = row(1, "PUT", v, s).union(row(2, "PUT", F.reverse(v), s.where("id % 5 = 0")))
    return out.union(row(3, "DEL", F.lit(None).cast("array<float>"), s.where("id % 7 = 0"))).union(row(4, "PUT", v, s.where("id % 35 = 0")))


@query("vec_upsert_latest", f"{VECTOR_LOG} select id, vector from live")
def vec_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return vectors.view(vector_log(space(spark, d)))


@query("vec_remove_topk", f"{VECTOR_LOG}, s as (select id, {M.sql('L2', 'cast(vector as double[])', 'q')} as d from live, {Q}) select cast(rank as bigint) as rank, id, distance from (select row_number() over (order by d, id) as rank, id, round(d, 6) as distance from s) where rank <= 10")
def vec_remove_topk(spark: SparkSession, d: str) -> DataFrame:
    s = space(spark, d)
    return vectors.topk(vectors.view(vector_log(s)), stored(s, QUERY_ID), 10)


@query("vec_reinsert", f"{VECTOR_LOG} select id, vector from live where id % 35 = 0")
def vec_reinsert(spark: SparkSession, d: str) -> DataFrame:
    return vectors.view(vector_log(space(spark, d))).where("id % 35 = 0")


@query("vec_dim_mismatch", "select vec_id as id, 'vector dimension mismatch: expected 64, got ' || cast(case when vec_id % 3 = 0 then 10 else 0 end as varchar) as error from embeddings where vec_id % 3 = 0 or vec_id % 11 = 0")
def vec_dim_mismatch(spark: SparkSession, d: str) -> DataFrame:
    cut = F.when(F.col("id") % 3 == 0, F.slice("vector", 1, 10)).when(F.col("id") % 11 == 0, F.slice("vector", 1, 0)).otherwise(F.col("vector"))
    return vectors.mismatches(space(spark, d).withColumn("vector", cut), 64)


KNN = f"""select query_id, cast(rank as bigint) as rank, id, distance from (select query_id, id, round(d, 6) as distance, row_number() over (partition by query_id order by d, id) as rank
    from (select a.vec_id as query_id, b.vec_id as id, {M.sql('L2', 'cast(b.embedding as double[])', 'cast(a.embedding as double[])')} as d from embeddings a, embeddings b)) where rank <= 5"""


@query("knn_join", KNN)
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    s = space(spark, d)
    return vectors.knn_join(s, spread(s), 5)


def add_join(metric: str, name: str) -> None:
    """The ten nearest of every vector whose id is divisible by 20."""
    side = "list_transform(cast({}.embedding as double[]), lambda x: abs(x))" if metric == "JensenShannon" else "cast({}.embedding as double[])"
    order = "desc" if M.similarity(metric) else "asc"

    @query(f"topk_{name}_join", f"""select query_id, cast(rank as bigint) as rank, id, distance from (select query_id, id, round(d, 6) as distance, row_number() over (partition by query_id order by d {order}, id) as rank
        from (select a.vec_id as query_id, b.vec_id as id, {M.sql(metric, side.format('b'), side.format('a'))} as d from embeddings a, embeddings b where a.vec_id % 20 = 0)) where rank <= 10""")
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = space(spark, d)
        if metric == "JensenShannon":
            s = s.withColumn("vector", F.transform("vector", F.abs))
        return vectors.knn_join(s.where("id % 20 = 0"), spread(s), 10, metric)


for _metric, _name in NAMES.items():
    add_join(_metric, _name)


def add_range_join(name: str, metric: str, radius: float) -> None:
    test = f"d > {radius}" if M.similarity(metric) else f"d < {radius}"

    @query(name, f"select query_id, id, round(d, 6) as distance from (select a.vec_id as query_id, b.vec_id as id, {M.sql(metric, 'cast(b.embedding as double[])', 'cast(a.embedding as double[])')} as d from embeddings a, embeddings b where a.vec_id % 20 = 0) where {test}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = space(spark, d)
        return vectors.range_join(s.where("id % 20 = 0"), spread(s), radius, metric)


for _args in (("range_l2_join", "L2", 1.7), ("range_ip_join", "InnerProduct", 0.15), ("range_l1_join", "L1", 8.3), ("range_linf_join", "Linf", 0.37)):
    add_range_join(*_args)


@query("knn_label_vote", f"""with k as ({KNN}), v as (select query_id, label, count(*) as n from k join embeddings e on e.vec_id = k.id group by all)
    select query_id, label from (select *, row_number() over (partition by query_id order by n desc, label) as r from v) where r = 1""")
def knn_label_vote(spark: SparkSession, d: str) -> DataFrame:
    return vectors.label_vote(knn_join(spark, d), space(spark, d).select("id", "label"))


@query("hybrid_range_topk", ranked(M.sql("L2", EMB, "q"), 10, where="where true qualify d < 1.7").replace("qualify d < 1.7", "").replace("from s)", "from s where d < 1.7)"))
def hybrid_range_topk(spark: SparkSession, d: str) -> DataFrame:
    s = space(spark, d)
    return vectors.hybrid(s, stored(s, QUERY_ID), 1.7, 10)


@query("ivf_fixed_centroids_probe1", f"""with c as (select vec_id as cid, {EMB} as c from embeddings where vec_id < {LISTS}),
    a as (select e.vec_id as id, e.embedding, c.cid, row_number() over (partition by e.vec_id order by {M.sql('L2', 'cast(e.embedding as double[])', 'c.c')}, c.cid) as n from embeddings e, c),
    l as (select id, embedding, cid from a where n = 1), q as (select {EMB} as q, (select cid from l where id = {IVF_QUERY_ID}) as list from embeddings where vec_id = {IVF_QUERY_ID}),
    s as (select id, {M.sql('L2', EMB, 'q')} as d from l, q where l.cid = q.list)
    select cast(rank as bigint) as rank, id, distance from (select row_number() over (order by d, id) as rank, id, round(d, 6) as distance from s) where rank <= 50""")
def ivf_fixed_centroids_probe1(spark: SparkSession, d: str) -> DataFrame:
    s = space(spark, d)
    cs = [list(r["vector"]) for r in s.where(F.col("id") < LISTS).orderBy("id").collect()]
    return ann.ivf_topk(ann.assign(s, cs), cs, stored(s, IVF_QUERY_ID), 50)


@query("ivf_fixed_centroids_probe3", f"""with c as (select vec_id as cid, {EMB} as c from embeddings where vec_id < {LISTS}),
    a as (select e.vec_id as id, {EMB} as v, c.cid, row_number() over (partition by e.vec_id order by {M.sql('L2', EMB, 'c.c')}, c.cid) as n from embeddings e, c),
    p as (select q.id as query_id, q.v as q, l.id, {M.sql('L2', 'l.v', 'q.v')} as d from a q join a l on l.cid = q.cid where q.id % 20 = 0 and q.n <= 3 and l.n = 1)
    select query_id, cast(rank as bigint) as rank, id, distance from (select query_id, id, round(d, 6) as distance, row_number() over (partition by query_id order by d, id) as rank from p) where rank <= 10""")
def ivf_fixed_centroids_probe3(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20, in the three lists nearest to it."""
    s = space(spark, d)
    cs = [list(r["vector"]) for r in s.where(F.col("id") < LISTS).orderBy("id").collect()]
    return ann.ivf_join(s.where("id % 20 = 0"), ann.assign(spread(s), cs), cs, 10, probes=3)


@query("ivf_kmeans_topk")
def ivf_kmeans_topk(spark: SparkSession, d: str) -> DataFrame:
    s = space(spark, d)
    cs = ann.centres(s, 32).tolist()
    return ann.ivf_join(s.where("id % 20 = 0"), ann.assign(spread(s), cs), cs, 10, probes=PROBES)


@query("pq_topk")
def pq_topk(spark: SparkSession, d: str) -> DataFrame:
    s = space(spark, d)
    pq = ann.ProductQuantizer.fit(s, 64, 8, codes=64)
    return pq.join(s.where("id % 20 = 0"), pq.encode(spread(s), "vector"), 10)


@query("pq_rerank")
def pq_rerank(spark: SparkSession, d: str) -> DataFrame:
    s = space(spark, d)
    pq = ann.ProductQuantizer.fit(s, 64, 8, codes=64)
    return pq.join(s.where("id % 20 = 0"), pq.encode(spread(s), "vector"), 10, "InnerProduct")


@query("hnsw_exact_topk", ranked(M.sql("L2", EMB, "q"), 10))
def hnsw_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    """Spaces with a graph index are searched exactly."""
    s = space(spark, d)
    return vectors.topk(s, stored(s, QUERY_ID), 10)


@query("hashed_topk")
def hashed_topk(spark: SparkSession, d: str) -> DataFrame:
    s = space(spark, d)
    return ann.hashed_join(s.where("id % 20 = 0"), spread(s), 10)


# Key-value logs: the events of each user; an error event deletes the key.

KV_LOG = """with log as (select cast(user_id as varchar) as key, case when event_type = 'error' then 'DEL' else 'PUT' end as op, event_type as value, ts, event_id from events),
    live as (select key, value from (select *, row_number() over (partition by key order by ts desc, event_id desc) as n from log) where n = 1 and op = 'PUT')"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def kv_log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DEL").otherwise("PUT").alias("op")
    return events(spark, d).select(F.struct("ts", "event_id").alias("seq"), op, F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"))


@query("kv_latest", "select cast(user_id as varchar) as key, arg_max(event_type, row(ts, event_id)) as value from events group by 1")
def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    return kv.view(kv_log(spark, d).withColumn("op", F.lit("PUT")))


@query("kv_get", f"{KV_LOG} select value from live where key = '3'")
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    return kv.get(kv_log(spark, d), "3").select("value")


@query("kv_multi_get", f"{KV_LOG}, w(key) as (values ('1'), ('2'), ('5'), ('8'), ('no such key')) select w.key, live.value from w left join live on live.key = w.key")
def kv_multi_get(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([(x,) for x in ("1", "2", "5", "8", "no such key")], "key string")
    return kv.multi_get(kv_log(spark, d), keys)


@query("kv_delete", f"{KV_LOG} select key, value from live")
def kv_delete(spark: SparkSession, d: str) -> DataFrame:
    return kv.view(kv_log(spark, d))


@query("kv_delete_then_put", """with log as (select o_custkey as k, 1 as seq, 'PUT' as op, o_orderpriority as v, o_orderkey as o from orders
    union all select c_custkey, 2, 'DEL', null, 0 from customer where c_nationkey % 2 = 0 union all select c_custkey, 3, 'PUT', c_mktsegment, 0 from customer where c_nationkey % 4 = 0),
    l as (select *, row_number() over (partition by k order by seq desc, o desc) as n from log) select cast(k as varchar) as key, v as value from l where n = 1 and op = 'PUT'""")
def kv_delete_then_put(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    one = lambda rows, n, op, key, value, o: rows.select(F.struct(F.lit(n).alias("n"), o.cast("long").alias("o")).alias("seq"), F.lit(op).alias("op"), F.col(key).cast("string").alias("key"), value.alias("value"))
    log = one(orders, 1, "PUT", "o_custkey", F.col("o_orderpriority"), F.col("o_orderkey"))
    log = log.union(one(customer.where("c_nationkey % 2 = 0"), 2, "DEL", "c_custkey", F.lit(None).cast("string"), F.lit(0)))
    return kv.view(log.union(one(customer.where("c_nationkey % 4 = 0"), 3, "PUT", "c_custkey", F.col("c_mktsegment"), F.lit(0))))


@query("kv_reserved_value", "with l as (select cast(user_id as varchar) as key, arg_max(case when event_type = 'purchase' then '__deleted__' else event_type end, row(ts, event_id)) as value from events group by 1) select key, value from l where value <> '__deleted__'")
def kv_reserved_value(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("value") == "purchase", kv.DELETED).otherwise(F.col("value"))
    return kv.readable(kv.view(kv_log(spark, d).withColumn("op", F.lit("PUT")).withColumn("value", value)))


@query("kv_ordered_scan", f"{KV_LOG} select key, value from live where starts_with(key, '1')")
def kv_ordered_scan(spark: SparkSession, d: str) -> DataFrame:
    return kv.scan(kv_log(spark, d), "1")


@query("kv_overwrite_count", "select cast(user_id as varchar) as key, count(*) filter (event_type <> 'error') as versions, count(*) filter (event_type = 'error') as deletes from events group by 1")
def kv_overwrite_count(spark: SparkSession, d: str) -> DataFrame:
    return kv.overwrites(kv_log(spark, d))


@query("kv_replay_uncommitted", """with log as (select user_id as k, ts, event_id, case when event_id % 4 = 0 then 'D' when event_id % 3 = 0 then 'C' else 'P' end as flag, event_type as v from events),
    l as (select *, row_number() over (partition by k order by ts desc, event_id desc) as n from log where flag <> 'C') select cast(k as varchar) as key, v as value from l where n = 1 and flag = 'P'""")
def kv_replay_uncommitted(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("event_id") % 4 == 0, "D").when(F.col("event_id") % 3 == 0, "C").otherwise("P").alias("flag")
    wal = events(spark, d).select(F.struct("ts", "event_id").alias("seq"), flag, F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"))
    return kv.view(kv.replay(wal))


@query("kv_composite_key", "select cast(conv_id as varchar) || ':' || role as key, arg_max(text, turn) as value from conversations group by conv_id, role")
def kv_composite_key(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return kv.view(rows.select(F.col("turn").alias("seq"), F.lit("PUT").alias("op"), F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("key"), F.col("text").alias("value")))


# Batches of a stored log: the events whose id leaves 0 to 3 over 4, in that order; in each the last event of a user.

BATCHED = "select cast(user_id as varchar) as key, arg_max(event_type, row(event_id % 4, ts, event_id)) as value from events group by 1"


def stored_log(spark: SparkSession, d: str):
    import uuid

    from latticework.sources import stores

    log = stores.Log(spark, f"{stores.shared_dir(spark)}/log-{uuid.uuid4().hex}", stores.KV_LOG, "key")
    rows = kv_log(spark, d).withColumn("op", F.lit("PUT"))
    for b in range(4):
        log.append(kv.view(rows.where(F.col("seq.event_id") % 4 == b)), "PUT")
    return log


@query("kv_put_batch", BATCHED)
def kv_put_batch(spark: SparkSession, d: str) -> DataFrame:
    return kv.view(stored_log(spark, d).read())


@query("kv_compact", BATCHED)
def kv_compact(spark: SparkSession, d: str) -> DataFrame:
    """The live rows only, as stored after compaction."""
    return stored_log(spark, d).compact(kv.view).read().where("op = 'PUT'").select("key", "value")


@query("kv_mark_committed", """select cast(user_id as varchar) as key, arg_max(event_type, row(ts, event_id)) as value from events where event_id % 3 <> 0 group by 1""")
def kv_mark_committed(spark: SparkSession, d: str) -> DataFrame:
    """What a recovery replays once every third entry has been marked as committed."""
    wal = kv_log(spark, d).select("seq", F.lit("P").alias("flag"), "key", "value")
    return kv.view(kv.replay(kv.mark_committed(wal, wal.where(F.col("seq.event_id") % 3 == 0))))


# Catalog, users and connections, over given rows on both sides

INDEX_TYPES = ("Flat", "Flat32", "HNSW", "HNSW1", "HNSW3", "HNSW32", "HNSW256", "HNSW512", "IVF", "IVF32", "PQ8", "PQ", "IVF32,Flat", "IVF64,PQ16", "IVF,Flat", "", ",", "HNSW32,,Flat", " HNSW32 , Flat ", "Invalid", "Unknown32", "Flat,Flat", "hnsw32")
VALID = ("Flat", "HNSW32", "HNSW256", "IVF32", "PQ8", "IVF32,Flat", "IVF64,PQ16", " HNSW32 , Flat ", "Flat,Flat")


def values(rows: list[tuple], names: str) -> str:
    show = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)
    return f"(values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({names})"


@query("index_type_valid", f"select index_type, index_type in ({', '.join(repr(x) for x in VALID)}) as valid from {values([(x,) for x in INDEX_TYPES], 'index_type')}")
def index_type_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in INDEX_TYPES], "index_type string")
    return rows.select("index_type", catalog.index_type_valid(F.col("index_type")).alias("valid"))


TRIED = (*M.METRICS, "", "l2", "Cosine")


@query("metric_valid", f"select metric, metric in ({', '.join(map(repr, M.METRICS))}) as valid from {values([(x,) for x in TRIED], 'metric')}")
def metric_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in TRIED], "metric string")
    return rows.select("metric", catalog.metric_valid(F.col("metric")).alias("valid"))


NEEDED = (("Flat", 0), ("HNSW32", 0), ("IVF32", 32), ("IVF32,Flat", 32), ("PQ8", 256), ("IVF64,PQ16", 256), ("HNSW128,PQ32", 0), ("PQ4,IVF256", 256))


@query("training_threshold", f"""select index_type, cast(case when starts_with(index_type, 'HNSW') then 0 else greatest(coalesce(try_cast(regexp_extract(index_type, '^IVF([0-9]+)', 1) as int), 0),
    case when contains(index_type, 'PQ') then 256 else 0 end) end as int) as required from {values([(x,) for x, _ in NEEDED], 'index_type')}""")
def training_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x, _ in NEEDED], "index_type string")
    return rows.select("index_type", catalog.required_training(F.col("index_type")).alias("required"))


@query("list_spaces", "select n_name as name from nation")
def list_spaces(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name")).orderBy("name")


PEOPLE = [("root", "admin", None, None), ("ann", "user", "a", "read"), ("bob", "user", "a", "write"), ("eve", "user", "b", "read"), ("nil", "user", None, None)]
COMMANDS = [(c,) for c in ("PUT", "GET", "DELETE", "INSERT_VECTOR", "SEARCH_TOPK", "GET_VECTOR", "RANGE_SEARCH", "CREATE_SPACE", "LIST_SPACES", "USE_SPACE", "put")]


def people(spark: SparkSession) -> DataFrame:
    rows = [(n, r, {} if s is None else {s: p}) for n, r, s, p in PEOPLE]
    return spark.createDataFrame(rows, "username string, role string, permissions map<string, string>")


@query("has_role_matrix", f"""select username, s.space, w.wanted, role = 'admin' or coalesce(s.space = t.own and (perm = 'write' or (perm = 'read' and w.wanted = 'read')), false) as allowed
    from {values(PEOPLE, 'username, role, own, perm')}, (values ('a'), ('b')) s(space), (values ('read'), ('write')) w(wanted)""")
def has_role_matrix(spark: SparkSession, d: str) -> DataFrame:
    each = lambda *xs: F.explode(F.array(*map(F.lit, xs)))
    rows = people(spark).withColumn("space", each("a", "b")).withColumn("wanted", each("read", "write"))
    return rows.select("username", "space", "wanted", auth.has_role(F.col("role"), F.col("permissions"), F.col("space"), F.col("wanted")).alias("allowed"))


@query("guard_matrix", f"""select username, c.command, case when upper(c.command) in ('CREATE_SPACE', 'LIST_SPACES') then role = 'admin'
    when upper(c.command) in ('PUT', 'DELETE', 'INSERT_VECTOR') then role = 'admin' or coalesce(own = 'a' and perm = 'write', false)
    when upper(c.command) in ('GET', 'SEARCH_TOPK', 'GET_VECTOR', 'RANGE_SEARCH') then role = 'admin' or coalesce(own = 'a' and perm in ('read', 'write'), false) else true end as allowed
    from {values(PEOPLE, 'username, role, own, perm')}, {values(COMMANDS, 'command').replace(' t(', ' c(')}""")
def guard_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = people(spark).withColumn("command", F.explode(F.array(*[F.lit(c) for (c,) in COMMANDS]))).withColumn("space", F.lit("a"))
    return auth.guard(rows).select("username", "command", "allowed")


@query("user_format", f"select 'Username: ' || username || ' | Role: ' || role || ' | Permissions: ' || coalesce(own || '=' || perm, 'None') as line from {values(PEOPLE, 'username, role, own, perm')}")
def user_format(spark: SparkSession, d: str) -> DataFrame:
    return people(spark).select(auth.user_format(F.col("username"), F.col("role"), F.col("permissions")).alias("line"))


@query("connection_stats", "select c_nationkey as active_connections, 100 as max_connections, c_nationkey / 100.0::double * 100 as usage_percentage, 100 - c_nationkey as available_slots from customer")
def connection_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("active"), F.lit(100).alias("most"))
    return management.connection_stats(rows)


CHANGES = [(1, 100, 10), (2, -500, 10), (3, -1000, 10), (4, -595, 10), (5, 7, 10)]


@query("limit_update_fold", f"""with recursive c as (select * from {values(CHANGES, 'seq, delta, active')}), f(seq, lim) as (select 0, 1000::bigint
    union all select c.seq, case when f.lim + c.delta > 0 and f.lim + c.delta >= c.active then f.lim + c.delta else f.lim end from f join c on c.seq = f.seq + 1)
    select arg_max(lim, seq) as max_connections from f""")
def limit_update_fold(spark: SparkSession, d: str) -> DataFrame:
    return management.limit_fold(spark.createDataFrame(CHANGES, "seq int, delta int, active int"), 1000)


@query("client_throughput", "with r as (select user_id, sum(1) / sum(1 + event_id % 7)::double as rate from events group by 1) select round(avg(rate), 6) as ops_per_second, count(*) as clients from r")
def client_throughput(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select(F.col("user_id").alias("client"), F.lit(1).alias("ops"), (1 + F.col("event_id") % 7).cast("double").alias("seconds"))
    return management.throughput(rows)


@query("stream_kv_upsert")
def stream_kv_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream into a log, then the last value of each key."""
    import uuid

    from latticework.sources import stores
    from latticework.streaming import upsert

    root = f"{stores.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = events(spark, d).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*")
    upsert.upsert_stream(upsert.kv_stream(stream), f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return kv.view(spark.read.parquet(f"{root}/log"))


ORACLES["stream_kv_upsert"] = ORACLES["kv_latest"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
