"""Nearest neighbours of many queries inside one task, in numpy.

Every pair is looked at in few rounded steps first: a matrix product for L2, InnerProduct and JensenShannon, single precision for
the other metrics. The error of these has a bound, and only pairs that can be among the nearest by it are scored exactly, so
the result is that of scoring all pairs exactly. Tiles have a fixed size, whatever the number of queries and rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Rows that are gathered before they are searched, and pairs that are scored exactly at once.
SLAB, PAIRS = 65536, 16384
#: Queries and rows of a tile: of a matrix product, and of the other metrics, which should stay in a core's cache.
PRODUCT_TILE, TILE = (512, 4096), (16, 4096)
#: The same of a matrix product in double precision of which many pairs are kept.
DOUBLE_TILE = (64, 4096)
#: Queries and rows whose terms of JensenShannon, or whose elements in double precision, are held at once.
TERMS = (4096, 8192)
#: JensenShannon's term of x and y is m f(ln x / y), m = (x + y) / 2. f(u) lies within FIT of WAVES[0] + sum of WAVES[1 + j]
#: cos(j PITCH u) / cosh(u / 2), j from 0, and m / cosh(u / 2) is the root of x y, so all terms but the first are products of
#: functions of x and of y. The weights are a minimax fit, the bound is the largest error over all u and some room.
WAVES, PITCH, FIT = (0.693488, -0.336208, -0.299456, -0.041909, -0.015416), 0.35, 5.2e-4
#: Metrics of which keys can come from a matrix product.
PRODUCTS = ("L2", "InnerProduct", "JensenShannon")
#: Stretches of rows of about one length that are looked at apart. Vectors have a few tens of such lengths at most.
MOST_RUNS = 256
#: Sizes of elements, zero apart, of which single precision loses no more than its rounding.
PLAIN = (1e-18, 1e15)


def folded(metric: str, terms: Iterable[tuple[np.ndarray, np.ndarray]], shape: tuple[int, ...], p: float = 0.0, dtype: type = np.float64) -> np.ndarray:
    """Distances from the elements (of rows, of queries) of one dimension after another, in the order of the column expression."""
    out, a, b = np.zeros(shape, dtype), np.empty(shape, dtype), np.empty(shape, dtype)
    low = np.zeros(shape, dtype) if metric == "BrayCurtis" else None
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for x, y in terms:
            if metric == "InnerProduct":
                out += np.multiply(x, y, out=a)
            elif metric == "JensenShannon":
                m = np.multiply(0.5, np.add(x, y, out=a), out=a)
                np.multiply(-x, np.log(np.divide(m, x, out=b), out=b), out=b)
                b -= np.multiply(y, np.log(np.divide(m, y, out=a), out=a), out=a)
                out += b
            elif metric == "L2":
                np.subtract(x, y, out=a)
                out += np.multiply(a, a, out=a)
            else:
                np.abs(np.subtract(x, y, out=a), out=a)
                if metric == "Linf":
                    np.maximum(out, a, out=out)
                elif metric == "Lp":
                    out += np.power(a, p, out=a)
                elif metric == "Canberra":
                    out += np.divide(a, np.add(np.abs(x), np.abs(y), out=b), out=a)
                elif metric in ("L1", "BrayCurtis"):
                    out += a
                    if low is not None:
                        low += np.abs(np.add(x, y, out=b), out=b)
                else:
                    raise ValueError(f"invalid metric: {metric}")
        return out / low if low is not None else np.multiply(out, 0.5, out=out) if metric == "JensenShannon" else out


def block_distances(metric: str, q: np.ndarray, v: np.ndarray, p: float = 0.0) -> np.ndarray:
    """queries x rows."""
    columns = np.ascontiguousarray(v.T)
    return folded(metric, ((columns[j][None, :], q[:, None, j]) for j in range(q.shape[1])), (len(q), len(v)), p)


def within(q: np.ndarray, v: np.ndarray, radius: float, metric: str, p: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, rows, distances of six decimals) of the pairs within a radius, tile by tile, in parts of about a slab."""
    held, n = [], 0
    for found in within_by_product(q, v, radius, metric) if metric in ("L2", "InnerProduct") else within_by_terms(q, v, radius, metric, p):
        held, n = [*held, found], n + len(found[0])
        if n >= SLAB:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def within_by_terms(q: np.ndarray, v: np.ndarray, radius: float, metric: str, p: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs are scored exactly, as a large share of them may be within."""
    for lo in range(0, len(v) if len(q) else 0, TILE[1]):
        rows = v[lo : lo + TILE[1]].astype(np.float64)
        for a in range(0, len(q), TILE[0]):
            d = block_distances(metric, q[a : a + TILE[0]].astype(np.float64), rows, p)
            x, y = np.nonzero(d < radius)
            yield a + x, lo + y, rounded(d[x, y])


def within_by_product(q: np.ndarray, v: np.ndarray, radius: float, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A matrix product in double precision tells all six decimals of nearly every pair; those that its error leaves open, of the
    decimals or of the radius, are scored exactly."""
    sign = -1.0 if metric == "InnerProduct" else 1.0
    order = np.argsort(lengths(v), kind="stable")
    v = v[order]
    for rough, a, b, lo, hi in tiles(metric, q, v, 0.0, np.float64):
        key, off = rough.tile(a, b, lo, hi), 4 * rough.slack[a - rough.first[0] : b - rough.first[0]]
        x, y = np.nonzero(~(key > (sign * radius + off)[:, None]))
        d, off = key[x, y], off[x]
        with np.errstate(invalid="ignore", over="ignore"):
            sure = (np.abs(d - sign * radius) > off) & clear(d * 1e6, off * 1e6)
        d *= sign
        keep = sure.copy()
        for at in np.array_split(open_ := np.flatnonzero(~sure), -(-len(open_) // PAIRS) or 1):
            d[at] = pair_distances(metric, q[a + x[at]], v[lo + y[at]])
            keep[at] = d[at] > radius if metric == "InnerProduct" else d[at] < radius
        yield a + x[keep], order[lo + y[keep]], rounded(d[keep])


def clear(scaled: np.ndarray, off: np.ndarray | float = 0.0) -> np.ndarray:
    """Whether the nearest whole number is plain, though the numbers are off by so much and by their own rounding."""
    return (np.abs(scaled - np.floor(scaled) - 0.5) > np.abs(scaled) * 2.0**-50 + 2 * off) & (np.abs(scaled) < 2.0**48)


def rounded(d: np.ndarray) -> np.ndarray:
    """Six decimals, as Spark's round gives them: half up of the shortest decimal form. Only numbers too near a tie to tell, or of a
    size at which doubles hardly have six decimals, go by that form."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = d * 1e6
        out = np.rint(scaled) / 1e6 + 0.0
        open_ = np.flatnonzero(~clear(scaled))
    for i in open_:
        x = float(d[i])
        out[i] = float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) + 0.0 if abs(x) < 2.0**53 else x
    return out


def pair_distances(metric: str, q: np.ndarray, v: np.ndarray, p: float = 0.0) -> np.ndarray:
    """One distance for each row of both."""
    x, y = np.ascontiguousarray(v.T, np.float64), np.ascontiguousarray(q.T, np.float64)
    return folded(metric, zip(x, y, strict=True), (len(q),), p)


def matrix_of(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """A list column without nulls as rows x elements, in its own precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """The same of vectors: in single precision if they are stored so, else in double."""
    v = matrix_of(column, n)
    return v if v.dtype in (np.float32, np.float64) else v.astype(np.float64)


def slabs(batches: Iterator[pa.RecordBatch], size: int = SLAB) -> Iterator[pa.Table]:
    """The rows of a task in larger parts."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def same(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the position of one, and for each vector the number of its group."""
    v = np.ascontiguousarray(v)
    if not v.size:
        return np.arange(len(v)), np.arange(len(v))
    _, first, group = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, group.ravel()


def plain(v: np.ndarray) -> bool:
    size = np.abs(v)
    return v.dtype == np.float32 and bool(np.all((size == 0) | ((size >= PLAIN[0]) & (size <= PLAIN[1]))))


def lengths(v: np.ndarray) -> np.ndarray:
    """A number that vectors of about one length (up to a factor of four) have in common."""
    with np.errstate(all="ignore"):
        size = np.log2(np.einsum("ij,ij->i", v, v)) / 4 + 0.37  # a length of 1 is well inside
        return np.floor(np.nan_to_num(size, nan=400, posinf=400, neginf=-400)).astype(np.int64)


def runs(kind: np.ndarray) -> list[tuple[int, int]]:
    """From and to of the stretches of equal numbers; all is one stretch if there are more than MOST_RUNS."""
    cuts = np.flatnonzero(np.diff(kind)) + 1
    edges = [0, *(cuts if len(cuts) < MOST_RUNS else ()), len(kind)]
    return list(zip(edges[:-1], edges[1:], strict=True))


class Rough:
    """Keys (distances, or negated similarities) of queries and rows, off the exact ones by no more than `limit` allows. They are
    numbered from `first`."""

    def __init__(self, metric: str, q: np.ndarray, v: np.ndarray, p: float, first: tuple[int, int] = (0, 0), dtype: type | None = None) -> None:
        self.metric, self.p, self.first, n = metric, p, first, q.shape[1]
        self.logs = metric == "JensenShannon" and not (q < 0).any() and not (v < 0).any()
        as_it_is = metric == "Lp" or metric == "JensenShannon" and not self.logs  # terms of any size or sign: in double only
        self.dtype = dtype or (np.float32 if not as_it_is and plain(q) and plain(v) else np.float64)
        eps = (n + 8) * float(np.finfo(self.dtype).eps)
        self.slack, self.share = np.zeros(len(q)), 4 * eps
        waves = self.logs and self.dtype == np.float32
        self.product = waves or metric in ("L2", "InnerProduct")
        self.queries, self.rows = DOUBLE_TILE if dtype else PRODUCT_TILE if self.product else TILE
        if waves:
            self.left, self.right = waved(q, True), np.ascontiguousarray(waved(v, False).T)
            total = q.sum(1, dtype=np.float64) + np.nanmax(v.sum(1, dtype=np.float64), initial=0.0)
            eps = (self.left.shape[1] + 8) * float(np.finfo(self.dtype).eps)
            self.slack = (FIT + eps * np.abs(WAVES).sum()) * total / 2  # products of an x and a y add to no more than their root
            self.slack = np.where(np.isnan(self.slack), np.inf, self.slack)
            return
        q64, v64 = q.astype(np.float64), v.astype(np.float64)
        with np.errstate(all="ignore"):
            if self.product:
                qn, vn = (q64 * q64).sum(1), (v64 * v64).sum(1)
                far = np.sqrt(np.nanmax(vn, initial=0.0))
                if metric == "L2":
                    left, right = (-2 * q64, np.ones((len(q), 1)), qn[:, None]), (v64, vn[:, None], np.ones((len(v), 1)))
                    self.slack = eps * (np.sqrt(qn) + far) ** 2
                else:
                    left, right = (-q64,), (v64,)
                    self.slack = eps * np.sqrt(qn) * far
                self.left, self.right = np.hstack(left).astype(self.dtype), np.ascontiguousarray(np.hstack(right).astype(self.dtype).T)
                self.slack = np.where(np.isnan(self.slack), np.inf, self.slack)
                return
            self.left, self.right = q.astype(self.dtype), np.ascontiguousarray(v.T.astype(self.dtype))
            if as_it_is:
                self.slack = 100 * eps * (np.nansum(np.abs(q64), 1) + np.nanmax(np.nansum(np.abs(v64), 1), initial=0.0))
            if self.logs:  # JS = sum x ln x / 2 + sum y ln y / 2 - sum m ln m, m = (x + y) / 2
                s, top = np.nanmax(q64, 0, initial=0.0) + np.nanmax(v64, 0, initial=0.0), 2 / np.e
                most = np.where(s < top, -s * np.log(np.maximum(s, 1e-300) / 2), np.maximum(top, s * np.abs(np.log(np.maximum(s, 1e-300) / 2)))).sum()
                self.own = (q64 * np.log(q64)).sum(1) / 2, (v64 * np.log(v64)).sum(1) / 2
                self.slack = np.full(len(q), eps * (most + sum(np.nanmax(np.abs(x), initial=0.0) for x in self.own)))
                self.left, self.right = self.left / 2, self.right / 2

    def tile(self, a: int, b: int, lo: int, hi: int) -> np.ndarray:
        c, r = self.first
        a, b, lo, hi = a - c, b - c, lo - r, hi - r
        q, v = self.left[a:b], self.right[:, lo:hi]
        if self.product:
            with np.errstate(all="ignore"):
                return q @ v
        shape = (len(q), v.shape[1])
        if not self.logs:
            return folded(self.metric, ((v[j][None, :], q[:, j, None]) for j in range(len(v))), shape, self.p, self.dtype)
        out, mean, log = np.zeros(shape, self.dtype), np.empty(shape, self.dtype), np.empty(shape, self.dtype)
        with np.errstate(all="ignore"):
            for j in range(len(v)):
                np.add(v[j][None, :], q[:, j, None], out=mean)
                out += np.multiply(mean, np.log(mean, out=log), out=log)
            x, y = self.own[0][a:b, None].astype(self.dtype), self.own[1][None, lo:hi].astype(self.dtype)
            return np.subtract(x + y, out, out=out)

    def limit(self, a: int, b: int, key: np.ndarray) -> np.ndarray:
        """What a key that is exactly or roughly `key` can be at most when it is taken in the other way."""
        return key + self.slack[a - self.first[0] : b - self.first[0]] + (0 if self.product else self.share * np.abs(key))


def waved(v: np.ndarray, weighed: bool) -> np.ndarray:
    """The factors of JensenShannon's terms in single precision, of one side with their weights. Zeros give no number."""
    n = v.shape[1]
    out = np.empty((len(v), 2 + n * (2 * len(WAVES) - 3)), np.float32)
    with np.errstate(all="ignore"):
        v64 = v.astype(np.float64)
        root, log = np.sqrt(v64), PITCH * np.log(v64)
        out[:, 1 - weighed], out[:, int(weighed)] = 1, WAVES[0] * v64.sum(1) / 2
        for j, w in enumerate(WAVES[1:]):
            for i, wave in enumerate((np.cos, np.sin) if j else (np.cos,)):
                at = 2 + n * (max(0, 2 * j - 1) + i)
                out[:, at : at + n] = (w if weighed else 1) * root * wave(j * log)
    return out


def tiles(metric: str, q: np.ndarray, v: np.ndarray, p: float, dtype: type | None = None) -> Iterator[tuple[Rough, int, int, int, int]]:
    """(keys, from and to of the queries, from and to of the rows) for all pairs. The error of a matrix product has the longest row
    in its bound, so rows that are sorted by `lengths` are taken length by length."""
    many = TERMS if metric == "JensenShannon" or dtype else (max(1, len(q)), max(1, len(v)))
    for first, stop in runs(lengths(v)) if metric in PRODUCTS and len(q) and len(v) else [(0, len(v) if len(q) else 0)]:
        for r in range(first, stop, many[1]):
            for c in range(0, len(q), many[0]):
                end, last = min(c + many[0], len(q)), min(r + many[1], stop)
                rough = Rough(metric, q[c:end], v[r:last], p, (c, r), dtype)
                for lo in range(r, last, rough.rows):
                    for a in range(c, end, rough.queries):
                        yield rough, a, min(a + rough.queries, end), lo, min(lo + rough.rows, last)


class Best:
    """The k nearest rows of each query so far, ties by id. Distances that are no numbers come last."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str, p: float = 0.0) -> None:
        self.ids, self.k, self.metric, self.p = ids, max(1, k), metric, p
        first, self.group = same(q)
        self.first, self.q = first, q[first]
        self.key, self.id = np.full((len(first), self.k), np.inf), np.full((len(first), self.k), np.iinfo(np.int64).max)
        self.n = np.zeros(len(first), np.int64)

    def worth(self, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Positions of the rows that can count at all: of equal vectors, and of rows that are all equally far, the k of smallest ids.
        Those of a matrix product are sorted by length."""
        if self.metric == "Lp" and self.p == 0:
            return np.argsort(ids, kind="stable")[: self.k]
        first, group = same(v)
        some = np.arange(len(v))
        if len(first) < len(v):
            order = np.lexsort((ids, group))
            start = np.searchsorted(group[order], np.arange(len(first)))
            some = np.sort(order[some - start[group[order]] < self.k])
        return some[np.argsort(lengths(v[some]), kind="stable")] if self.metric in PRODUCTS else some

    def add(self, ids: np.ndarray, v: np.ndarray, of: np.ndarray | None = None, among=None) -> None:
        """Rows, for the queries numbered `of`, or for all. `among` says which pairs count: tile(numbers, lo, hi) and pairs(x, y)."""
        of = np.arange(len(self.q)) if of is None else of
        if not len(ids) or not len(of):
            return
        for rough, a, b, lo, hi in tiles(self.metric, self.q[of], v, self.p):
            self._tile(rough, a, b, lo, hi, ids, v, of[a:b], among)

    def _tile(self, rough: Rough, a: int, b: int, lo: int, hi: int, ids: np.ndarray, v: np.ndarray, of: np.ndarray, among) -> None:
        key, last = rough.tile(a, b, lo, hi), self.key[of, -1]
        limit, few = rough.limit(a, b, last), np.flatnonzero(~(last < np.inf))
        if len(few):
            part = key[few]
            if among is not None:
                ok = among.tile(of[few], lo, hi)
                part[~ok] = np.inf
            if part.shape[1] > self.k:
                kth = np.partition(part, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)  # NaN comes last
                low = limit.copy()
                low[few] = kth
                limit[few] = rough.limit(a, b, rough.limit(a, b, low))[few]
            limit[np.isnan(limit)] = np.inf
        most = np.nextafter(limit.astype(key.dtype), key.dtype.type(np.inf))[:, None]
        near = ~(key > most) if len(few) else key <= most
        if len(few) and among is not None:
            near[few] &= ok
        at = np.flatnonzero(near)
        for i in range(0, len(at), PAIRS):
            x, y = np.divmod(at[i : i + PAIRS], hi - lo)
            self._score(of[x], lo + y, ids, v, among)

    def _score(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, v: np.ndarray, among) -> None:
        if among is not None:
            ok = among.pairs(x, y)
            x, y = x[ok], y[ok]
        d = pair_distances(self.metric, self.q[x], v[y], self.p)
        d = np.where(np.isnan(d), np.inf, -d if self.metric == "InnerProduct" else d)
        ok = (d < self.key[x, -1]) | ((d == self.key[x, -1]) & (ids[y] <= self.id[x, -1]))
        x, d, i = x[ok], d[ok], ids[y[ok]]
        if not len(x):
            return
        rows, n = np.unique(x, return_counts=True)
        self.n[rows] += n
        of = np.concatenate((np.repeat(rows, self.k), x))
        d, i = np.concatenate((self.key[rows].ravel(), d)), np.concatenate((self.id[rows].ravel(), i))
        order = np.lexsort((i, d, of))
        of = of[order]
        keep = order[np.arange(len(of)) - np.searchsorted(of, of) < self.k]
        self.key[rows], self.id[rows] = d[keep].reshape(-1, self.k), i[keep].reshape(-1, self.k)

    def batches(self, size: int = SLAB) -> Iterator[pa.RecordBatch]:
        """(query_id, id, key)."""
        at, step = np.arange(self.k), max(1, size // self.k)
        for lo in range(0, len(self.ids), step):
            g = self.group[lo : lo + step]
            there = at[None, :] < self.n[g][:, None]
            whose = np.broadcast_to(self.ids[lo : lo + step, None], there.shape)
            yield pa.RecordBatch.from_arrays([pa.array(whose[there]), pa.array(self.id[g][there]), pa.array(self.key[g][there])], names=["query_id", "id", "key"])
