"""Commands against named spaces: each becomes a DataFrame, or a short reply for what changes something."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import vectortext as T
from latticework.operators import ann, auth, catalog, kv, vectors
from latticework.sources import stores

SPACES = "name string, engine_type string, dimension int, index_type string, metric string, enable_wal boolean"
USERS = "username string, password_hash string, role string, permissions map<string, string>"
INDEX = "number int, generation int, batch long, centres array<array<double>>, books array<array<array<double>>>"
#: Writes of a space without a write-ahead log that are held back before they go out as one batch, and batches of a log
#: after which it is compacted.
HELD, COMPACT = 1000, 64
#: The replies that clients see when a guard refuses.
REFUSALS = {auth.ADMIN: "admin access required", auth.WRITE: "write permission denied", auth.READ: "read permission denied"}
#: Commands that change spaces or users; only admins may give them.
CHANGES = ("CREATE_SPACE", "DELETE_SPACE", "CREATE_USER", "UPDATE_USER_PASSWORD", "UPDATE_USER_ROLE", "UPDATE_USER_PERMISSIONS", "DELETE_USER")


@dataclass
class Query:
    type: str
    key: str = ""
    value: str = ""
    space: str = ""
    user: str = ""
    data: str = ""
    engine_type: str = ""
    dimension: int = 0
    index_type: str = ""
    metric: str = ""
    radius: float = 0.0
    enable_wal: bool = False
    new_user: dict = field(default_factory=dict)
    delete_user: dict = field(default_factory=dict)


class Engine:
    """Spaces and users under a shared folder. Single writes go out at once in a space with a write-ahead log; in others they
    are held back and go out in batches, before any read of the space and on close."""

    def __init__(self, spark: SparkSession, root: str, admin_password: str | None = None, probes: int | None = None, short: int = 20) -> None:
        """With probes, L2 and InnerProduct searches of IVF and PQ spaces use their index, approximately: that many lists, and
        short * k candidates by codes. Without, all searches are exact."""
        self.probes, self.short = probes, short
        self.spark, self.root = spark, root.rstrip("/")
        self._spaces = stores.Document(spark, f"{self.root}/spaces.json", SPACES)
        self._users = stores.Document(spark, f"{self.root}/users.json", USERS)
        self.spaces = {r["name"]: catalog.Space(**r) for r in self._spaces.read()}
        self.users = auth.Users([auth.User(r["username"], r["password_hash"], r["role"], r["permissions"] or {}) for r in self._users.read()], admin_password)
        self.current: str | None = None
        self.changes = threading.RLock()
        self.held: dict[str, list[tuple]] = {}
        self.appends: dict[str, threading.RLock] = {}

    # spaces
    def create_space(self, space: catalog.Space) -> str:
        space = catalog.with_defaults(space)
        catalog.check_name(space.name)
        if space.name in self.spaces:
            raise ValueError("space already exists")
        ok = self.spark.createDataFrame([(space.index_type,)], "t string").select(catalog.index_type_valid(F.col("t"))).first()[0] if space.engine_type == catalog.VECTOR else True
        catalog.check(space, ok)
        self.spaces[space.name] = space
        self._spaces.write([s.row() for s in self.spaces.values()])
        return "SPACE_CREATED"

    def delete_space(self, name: str) -> str:
        catalog.check_name(name)
        self.space(name)
        self.held.pop(name, None)
        del self.spaces[name]
        self._spaces.write([s.row() for s in self.spaces.values()])
        stores.Folder(self.spark, f"{self.root}/{name}").delete()
        return "SPACE_DELETED"

    def list_spaces(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.spaces], "name string").orderBy("name")

    def use_space(self, name: str) -> catalog.Space:
        found = self.space(name)
        self.current = name
        return found

    def space(self, name: str, engine: str | None = None) -> catalog.Space:
        if name not in self.spaces:
            raise ValueError("space does not exist")
        s = self.spaces[name]
        if engine and s.engine_type != engine:
            raise ValueError(f"operation not supported: not a {engine} space")
        return s

    def _log(self, name: str) -> stores.Log:
        vector = self.space(name).engine_type == catalog.VECTOR
        return stores.Log(self.spark, f"{self.root}/{name}/log", stores.VECTOR_LOG if vector else stores.KV_LOG, "id" if vector else "key")

    def log(self, name: str) -> stores.Log:
        """The log of a space with all that was held back for it."""
        self.flush(name)
        return self._log(name)

    def append(self, name: str, rows: DataFrame) -> None:
        """Append a batch of insertions; the log is neither compacted nor indexed meanwhile."""
        log = self.log(name)
        with self.appending(name):
            log.append(rows, "PUT")

    def appending(self, name: str) -> threading.RLock:
        return self.appends.setdefault(name, threading.RLock())

    def hold(self, name: str, op: str, key, value=None) -> None:
        with self.changes:
            self.held.setdefault(name, []).append((op, key, value))
            if self.space(name).enable_wal or len(self.held[name]) >= HELD:
                self.flush(name)

    def flush(self, name: str) -> None:
        """Write what was held back as one batch; compact the log after many batches."""
        with self.changes:
            rows = self.held.get(name)
            if not rows:
                return
            log = self._log(name)
            kinds = dict(x.split(" ", 1) for x in log.schema.split(", "))
            (key, a), (value, b) = list(kinds.items())[2:]
            log.append(self.spark.createDataFrame(rows, f"op string, {key} {a}, {value} {b}").coalesce(1))
            del self.held[name]  # only once they are written
            if len(log.batches()) >= COMPACT:
                self.compact(name)

    def compact(self, name: str) -> None:
        with self.changes, self.appending(name):
            log = self.log(name)
            log.compact(vectors.view if self.space(name).engine_type == catalog.VECTOR else kv.view)

    def close(self, name: str | None = None) -> None:
        """Write what is held back, of one space or of all."""
        for x in [name] if name else list(self.held):
            self.flush(x)

    # key-value
    def put(self, name: str, key: str, value: str) -> str:
        self.space(name, catalog.KEY_VALUE)
        self.hold(name, "PUT", key, value)
        return "OK"

    def put_batch(self, name: str, rows: DataFrame) -> str:
        self.space(name, catalog.KEY_VALUE)
        self.append(name, rows)
        return "OK"

    def get(self, name: str, key: str) -> str:
        self.space(name, catalog.KEY_VALUE)
        return kv.get_value(self.log(name).read_key(key), key)

    def delete(self, name: str, key: str) -> str:
        self.space(name, catalog.KEY_VALUE)
        log = self.log(name)
        if kv.view(log.read_key(key)).isEmpty():
            raise kv.KeyNotFound("key not found")
        self.hold(name, "DEL", key)
        return "DELETED"

    def kv_view(self, name: str) -> DataFrame:
        self.space(name, catalog.KEY_VALUE)
        return kv.readable(kv.view(self.log(name).read()))

    # vectors
    def insert_batch(self, name: str, rows: DataFrame) -> str:
        space = self.space(name, catalog.VECTOR)
        bad = vectors.mismatches(rows, space.dimension).first()
        if bad:
            raise ValueError(bad["error"])
        self.append(name, rows.select("id", F.col("vector").cast("array<float>").alias("vector")))
        return "VECTOR_INSERTED"

    def insert(self, name: str, id: int, vector: list[float]) -> str:
        space = self.space(name, catalog.VECTOR)
        if len(vector) != space.dimension:
            raise ValueError(f"vector dimension mismatch: expected {space.dimension}, got {len(vector)}")
        self.hold(name, "PUT", id, vector)
        return "VECTOR_INSERTED"

    def remove_vector(self, name: str, id: int) -> None:
        self.space(name, catalog.VECTOR)
        self.hold(name, "DEL", id)

    def vectors(self, name: str) -> DataFrame:
        """The live vectors; none while an index that must be trained has too few."""
        space = self.space(name, catalog.VECTOR)
        live = vectors.view(self.log(name).read())
        return live if self.trained(name, live) else live.where(F.lit(False))

    def trained(self, name: str, live: DataFrame | None = None) -> bool:
        """Whether a space has enough vectors for its index."""
        need = ann.required_training(self.space(name, catalog.VECTOR).index_type)
        live = vectors.view(self.log(name).read()) if need and live is None else live
        return not need or live.limit(need).count() >= need

    def get_vector(self, name: str, id: int) -> list[float]:
        row = vectors.view(self.log(name).read_key(id)).first() if self.trained(name) else None
        if row is None:
            raise kv.KeyNotFound(f"ID {id} not found")
        return list(row["vector"])

    def _query(self, name: str, query: list[float]) -> catalog.Space:
        space = self.space(name, catalog.VECTOR)
        if len(query) != space.dimension:
            raise ValueError("invalid query size")
        return space

    def search_topk(self, name: str, query: list[float], k: int = 1) -> DataFrame:
        space = self._query(name, query)
        if self.probes and space.metric in ("L2", "InnerProduct") and any(ann.layout(space.index_type)) and self.trained(name):
            return vectors.topk(self._candidates(name, query, k), query, k, space.metric)
        return vectors.topk(self.vectors(name), query, k, space.metric)

    # the index of a space: learned and stored on the first search that needs it, good for one generation of the log
    def train(self, name: str) -> None:
        """Learn and store the index of a space from its live vectors. Batches that come later are searched exactly beside
        it until the log is compacted; then it is learned anew. Files of the index before it are kept for searches under way
        and go with the one after. Other engines must not append to the space meanwhile."""
        with self.changes, self.appending(name):
            space, log = self.space(name, catalog.VECTOR), self.log(name)
            batch, generation = max(log.batches(), default=0), log.generation()
            live = vectors.view(log.read().where(F.col("seq.batch") <= batch))
            found = ann.Index.fit(live, space.index_type, space.dimension)
            document, folder = self._index(name), stores.Folder(self.spark, f"{self.root}/{name}/lists")
            before = document.read()
            number = before[0]["number"] + 1 if before else 1
            found.write(live, f"{self.root}/{name}/lists/{number}")
            books = [b.tolist() for b in found.pq.books] if found.pq else []
            document.write([{"number": number, "generation": generation, "batch": batch, "centres": found.cs, "books": books}])
            for n in folder.names():
                if int(n) < number - 1:
                    folder.delete(n)

    def _index(self, name: str) -> stores.Document:
        return stores.Document(self.spark, f"{self.root}/{name}/index.json", INDEX)

    def _candidates(self, name: str, query: list[float], k: int) -> DataFrame:
        """(id, vector) from the index and from the batches after it. What these batches replace or remove is taken out before
        the short list is cut, so it costs no place there."""
        with self.changes:
            log, found = self.log(name), self._index(name).read()
            if not found or found[0]["generation"] != log.generation():
                self.train(name)
                found = self._index(name).read()
        at = found[0]
        stored = self.spark.read.schema("id long, vector array<float>, codes array<short>, list_id int").parquet(f"{self.root}/{name}/lists/{at['number']}")
        index = ann.Index(at["centres"], at["books"])
        metric = self.space(name).metric
        if max(log.batches(), default=0) <= at["batch"]:
            return index.candidates(stored, query, k, metric, self.probes, self.short)
        later = log.read().where(F.col("seq.batch") > at["batch"])
        stored = stored.join(later.select("id").distinct(), "id", "left_anti")
        return index.candidates(stored, query, k, metric, self.probes, self.short).union(vectors.view(later))

    def range_search(self, name: str, query: list[float], radius: float = 1.0) -> DataFrame:
        return vectors.within(self.vectors(name), query, radius, self._query(name, query).metric)

    # users
    def _saved(self, reply: str) -> str:
        self._users.write([{"username": u.username, "password_hash": u.password_hash, "role": u.role, "permissions": u.permissions} for u in self.users.rows.values()])
        return reply

    def authorize(self, user: auth.User, q: Query) -> None:
        need = dict(auth.GUARDS).get(q.type.upper())
        if need == auth.ADMIN and user.role != auth.ADMIN or need in (auth.READ, auth.WRITE) and not user.may(q.space, need):
            raise auth.AuthError(REFUSALS[need])

    def execute(self, q: Query, user: auth.User):
        """The reply to a command: text, or a DataFrame for what lists or searches. Commands that change
        spaces or users take turns."""
        self.authorize(user, q)
        if q.type in CHANGES:
            with self.changes:
                return self._run(q, user)
        return self._run(q, user)

    def _run(self, q: Query, user: auth.User):
        new = q.new_user
        if q.type in (*CHANGES, "GET_USER") and self.users.get(user.username).role != auth.ADMIN:
            raise auth.AuthError(REFUSALS[auth.ADMIN])
        match q.type:
            case "CREATE_SPACE":
                return self.create_space(catalog.Space(q.space, q.engine_type, q.dimension, q.index_type, q.metric, q.enable_wal))
            case "DELETE_SPACE":
                return self.delete_space(q.data)
            case "LIST_SPACES":
                return self.list_spaces()
            case "USE_SPACE":
                self.use_space(q.space)
                return "SPACE_CHANGED"
            case "PUT":
                return self.put(q.space, q.key, q.value)
            case "GET":
                return self.get(q.space, q.key)
            case "DELETE":
                return self.delete(q.space, q.key)
            case "INSERT_VECTOR":
                v = T.parse_one(q.value, self.space(q.space, catalog.VECTOR).dimension)
                return self.insert(q.space, self._id(q.key), v)
            case "SEARCH_TOPK":
                return self.search_topk(q.space, T.parse_one(q.value, self.space(q.space, catalog.VECTOR).dimension), q.dimension)
            case "RANGE_SEARCH":
                return self.range_search(q.space, T.parse_one(q.value, self.space(q.space, catalog.VECTOR).dimension), q.radius)
            case "GET_VECTOR":
                self.space(q.space, catalog.VECTOR)
                return ",".join(f"{x:.6f}" for x in self.get_vector(q.space, self._id(q.key)))
            case "CREATE_USER":
                return self._saved(self.users.create(new["username"], new["password"], new.get("role", "user"), new.get("permissions")))
            case "UPDATE_USER_PASSWORD":
                return self._saved(self.users.set_password(new["username"], new["password"]))
            case "UPDATE_USER_ROLE":
                return self._saved(self.users.set_role(new["username"], new["role"]))
            case "UPDATE_USER_PERMISSIONS":
                return self._saved(self.users.set_permissions(new["username"], new.get("permissions", {})))
            case "DELETE_USER":
                return self._saved(self.users.delete(q.delete_user["username"]))
            case "GET_USER":
                return self.users.describe(q.data)
        raise ValueError("unsupported query type")

    @staticmethod
    def _hits(found: DataFrame) -> str:
        """Hits in the order of the search: by rank, or by distance for a range search."""
        return T.results_json(found, "rank" if "rank" in found.columns else "distance").first()["results"]

    @staticmethod
    def _id(key: str) -> int:
        try:
            return int(key)
        except ValueError:
            raise ValueError("invalid vector id") from None

    def reply(self, line: str, user: auth.User, text: bool = False) -> str:
        """A JSON command to a JSON reply. With text, lists and hits are JSON text within the message, as
        clients on the wire expect them, else plain lists."""
        try:
            q = Query(**json.loads(line))
            out = self.execute(q, user)
            if isinstance(out, DataFrame) and text:
                out = json.dumps({"status": "OK", "spaces": [r["name"] for r in out.collect()]}) if q.type == "LIST_SPACES" else self._hits(out)
            elif isinstance(out, DataFrame):
                out = [r.asDict() for r in out.collect()]
            return json.dumps({"status": "OK", "value" if q.type == "GET" else "message": out})
        except (ValueError, KeyError, PermissionError, TypeError) as e:
            return json.dumps({"status": "ERROR", "message": str(e.args[0]) if e.args else str(e)})
