"""Exact nearest neighbours by blocks: products in single precision make a short list, direct differences decide.

Ties go to the smaller id. References are broadcast in turns of bounded size; queries stay where they are, so nothing is
shuffled but the partial results of several turns, which are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Bytes of references that are broadcast at a time; the driver holds a few times as many.
BROADCAST_BYTES = 8 << 20
#: Bytes of results that the driver takes at once.
GATHERED_BYTES = 64 << 20
#: Queries and references of a tile of products, references that give a query's first bound.
QUERY_ROWS, REF_ROWS, FIRST = 256, 4096, 512
#: Short-listed pairs of a block of queries from which on direct differences cut the list, and numbers of one such difference.
PAIRS, DIFFERENCES = 1 << 22, 1 << 22
#: Which references a query may have, by its tag and theirs.
RULES = ("any", "same", "other")


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


class References:
    """Points by tag, and about their mean, scaled, for products whose rounding is bounded."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, tag: np.ndarray | None = None) -> None:
        order = np.arange(len(ids)) if tag is None else np.argsort(tag, kind="stable")
        self.ids, self.x, self.tag = ids[order], x[order], np.zeros(len(ids), np.int64) if tag is None else tag[order]
        self.by_id = np.argsort(self.ids)
        self.middle = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = float(np.sqrt(max((((x[a : a + REF_ROWS] - self.middle) ** 2).sum(axis=1).max() for a in range(0, len(x), REF_ROWS)), default=0.0))) or 1.0
        self.first = np.unique(np.linspace(0, max(0, len(ids) - 1), min(len(ids), FIRST)).astype(np.int64))
        self.right: dict[type, np.ndarray] = {}

    def _right(self, kind: type) -> np.ndarray:
        if kind not in self.right:
            out = np.empty((self.x.shape[1] + 1, len(self.x)), kind)
            for a in range(0, len(self.x), REF_ROWS):
                part = (self.x[a : a + REF_ROWS] - self.middle) / self.scale
                out[:-1, a : a + REF_ROWS], out[-1, a : a + REF_ROWS] = part.T, (part**2).sum(axis=1)
            self.right[kind] = out
        return self.right[kind]

    def screen(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """left, right, slack, own: left @ right is the squared distance over scale**2, less own, to within slack."""
        q = (x - self.middle) / self.scale
        own = (q**2).sum(axis=1)
        kind = np.float32 if own.max(initial=0) <= 1e12 else np.float64
        slack = 2 * (x.shape[1] + 8) * float(np.finfo(kind).eps) * (own + 1)
        return np.hstack([-2 * q, np.ones((len(q), 1))]).astype(kind), self._right(kind), slack, own

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where each id stands, -1 where it doesn't."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = self.by_id[np.minimum(np.searchsorted(self.ids, ids, sorter=self.by_id), len(self.ids) - 1)]
        return np.where(self.ids[at] == ids, at, -1)

    def distances(self, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(row)), max(1, DIFFERENCES // x.shape[1])
        for a in range(0, len(row), step):
            out[a : a + step] = np.sqrt(((self.x[col[a : a + step]] - x[row[a : a + step]]) ** 2).sum(axis=1))
        return out


def hits(near: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of what is finite and at most its row's limit."""
    with np.errstate(over="ignore"):
        limit = np.nextafter(np.minimum(limit, np.finfo(near.dtype).max).astype(near.dtype), near.dtype.type(np.inf))
    row, col = np.divmod(np.flatnonzero((near <= limit[:, None]).ravel()), max(1, near.shape[1]))
    value = near[row, col]
    some = value < np.inf
    return (row, col, value) if some.all() else (row[some], col[some], value[some])


def _leading(row: np.ndarray, k: int) -> np.ndarray:
    """Whether each entry is among the first k of its row; rows are sorted."""
    return np.arange(len(row)) - np.searchsorted(row, row) < k


def closest(refs: References, ids: np.ndarray, x: np.ndarray, tag: np.ndarray, wants: list[tuple[int, str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each (k, rule) the row, neighbour and distance of up to k references of each query, by row and nearest first;
    never the query's own id. Queries are sorted by tag."""
    n, queries = len(refs.ids), len(ids)
    left, right, slack, _ = refs.screen(x)
    me = refs.places(ids)
    lo, hi = (np.searchsorted(refs.tag, tag, side) for side in ("left", "right"))
    starts = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
    runs = list(zip(starts.tolist(), [*starts[1:].tolist(), queries], strict=True))
    bound, found = np.full((len(wants), queries), np.inf), [[] for _ in wants]

    def first(w: int, a: int, b: int, cols: np.ndarray) -> None:
        k, rule = wants[w]
        if len(cols) > k:
            near = left[a:b] @ right[:, cols]
            near[me[a:b, None] == cols] = np.inf
            if rule == "other":
                near[tag[a:b, None] == refs.tag[cols]] = np.inf
            bound[w, a:b] = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack[a:b]

    for w, (_, rule) in enumerate(wants):
        if rule != "same":
            first(w, 0, queries, refs.first)
            continue
        for a, b in runs:
            first(w, a, b, np.unique(np.linspace(lo[a], max(lo[a], hi[a] - 1), min(hi[a] - lo[a], FIRST)).astype(np.int64)))

    def tighten(w: int, most: int) -> None:
        if not found[w]:
            return
        k = wants[w][0]
        row, col, value = (np.concatenate(z) for z in zip(*found[w], strict=True))
        order = np.lexsort((value, row))
        row, col, value = row[order], col[order], value[order]
        at = np.searchsorted(row, np.arange(queries)) + k - 1
        full = np.flatnonzero(at < np.searchsorted(row, np.arange(queries), "right"))
        bound[w, full] = np.minimum(bound[w, full], value[at[full]] + 2 * slack[full])
        keep = value <= bound[w, row]
        row, col, value = row[keep], col[keep], value[keep]
        if len(row) > most:  # many copies
            order = np.lexsort((refs.ids[col], refs.distances(x, row, col), row))
            order = order[_leading(row[order], k)]
            row, col, value = row[order], col[order], value[order]
        found[w] = [(row, col, value)]

    for turn, c in enumerate(range(0, n, REF_ROWS)):
        d = min(n, c + REF_ROWS)
        near = left @ right[:, c:d]
        inside = np.flatnonzero((me >= c) & (me < d))
        near[inside, me[inside] - c] = np.inf
        # queries stand by tag, as references do: those with references of their tag among these stand together
        own = np.flatnonzero((lo < d) & (hi > c) & (lo < hi))
        a, b = (int(own[0]), int(own[-1]) + 1) if len(own) else (0, 0)
        parts = [(0, a, c, d, "other"), (b, queries, c, d, "other")]
        for s, e in runs:
            if a <= s < b:
                f, t = max(c, min(int(lo[s]), d)), max(c, min(int(hi[s]), d))
                parts += [(s, e, c, f, "other"), (s, e, f, t, "same"), (s, e, t, d, "other")]
        for s, e, f, t, kind in parts:
            use = [w for w, (_, rule) in enumerate(wants) if rule in ("any", kind)]
            if s >= e or f >= t or not use:
                continue
            row, col, value = hits(near[s:e, f - c : t - c], bound[use, s:e].max(axis=0))
            for w in use:
                keep = value <= bound[w, s + row]
                found[w].append((s + row[keep], f + col[keep], value[keep]))
        if not turn & (turn + 1) or sum(len(z[0]) for held in found for z in held) > PAIRS:
            for w in range(len(wants)):
                tighten(w, PAIRS // (2 * len(wants)))
    out = []
    for w, (k, _) in enumerate(wants):
        tighten(w, PAIRS)
        row, col, _ = found[w][0] if found[w] else (np.zeros(0, np.int64),) * 3
        dist = refs.distances(x, row, col)
        order = np.lexsort((refs.ids[col], dist, row))
        order = order[_leading(row[order], k)]
        out.append((row[order], refs.ids[col[order]], dist[order]))
    return out


_FOUND = "row_id long, want int, nbrs array<bigint>, dists array<double>"


def found_in(refs: References, ids: np.ndarray, x: np.ndarray, tag: np.ndarray, wants: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """_FOUND for queries in any order, QUERY_ROWS of them at a time."""
    order = np.argsort(tag, kind="stable")
    for a in range(0, len(ids), QUERY_ROWS):
        some = order[a : a + QUERY_ROWS]
        for w, (row, nbrs, dists) in enumerate(closest(refs, ids[some], x[some], tag[some], wants)):
            at = pa.array(np.searchsorted(row, np.arange(len(some) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(z)) for z in (nbrs.astype(np.int64), dists)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(np.full(len(some), w, np.int32)), *lists], names=["row_id", "want", "nbrs", "dists"])


def _whole(x: pa.ChunkedArray) -> np.ndarray:
    """matrix() of all chunks, without a further copy of them."""
    out, at = None, 0
    for chunk in x.chunks:
        if len(chunk):
            part = chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1)
            out = np.empty((len(x), part.shape[1])) if out is None else out
            out[at : at + len(chunk)] = part
            at += len(chunk)
    return np.zeros((0, 1)) if out is None else out


def gathered(df: DataFrame, bytes_: int) -> Iterator:
    """All rows of df, about bytes_ in all; all tasks run at once, and the driver takes a task's rows at a time if they are many."""
    if bytes_ <= GATHERED_BYTES:
        yield from df.collect()
        return
    held = df.persist()
    held.count()
    yield from held.toLocalIterator()
    held.unpersist()


def in_turns(rows: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> Iterator[tuple[Broadcast, int, int]]:
    """(broadcast of [row_id, x, other columns ...], turn, turns): all rows of (row_id, x, ...), about broadcast_bytes of x at a time."""
    n, d = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    turns = max(1, -(-n * (d or 0) * 8 // broadcast_bytes))
    of = F.pmod(F.xxhash64("row_id"), F.lit(turns))
    for turn in range(turns):
        got = (rows.where(of == turn) if turns > 1 else rows).toArrow()  # broadcast_bytes, about
        parts = [_whole(got.column(c)) if c == "x" else got.column(c).to_numpy() for c in rows.columns]
        del got
        yield rows.sparkSession.sparkContext.broadcast(parts), turn, turns


def nearest_each(queries: DataFrame, refs: DataFrame, wants: list[tuple[int, str]], broadcast_bytes: int = BROADCAST_BYTES, now: bool = False) -> DataFrame:
    """(row_id, want, nbrs, dists) for (row_id, x, tag) queries and references and each place in wants, a list of
    (k, rule), in one pass over the pairs; tag is a long. now: the result is written, and no broadcast is held on."""
    if not wants or any(k <= 0 or rule not in RULES for k, rule in wants):
        raise ValueError(f"k must be over 0 and the rule one of {RULES}")
    refs, queries = refs.select("row_id", "x", "tag"), queries.select("row_id", "x", "tag")
    parts = []
    for shared, _, turns in in_turns(refs, broadcast_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            table = None
            for b in batches:
                if b.num_rows:
                    table = table or References(*shared.value)
                    yield from found_in(table, b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy(), wants)

        part = queries.mapInArrow(run, _FOUND)
        if turns == 1 and not now:
            return part
        parts.append(materialize(part, "nearest"))
        shared.destroy()
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    k = F.element_at(F.array(*[F.lit(k) for k, _ in wants]), F.col("want") + 1)
    one = every.select("row_id", "want", F.explode(F.arrays_zip("dists", "nbrs")).alias("e")).groupBy("row_id", "want").agg(F.array_sort(F.collect_list("e")).alias("e")).withColumn("e", F.slice("e", F.lit(1), k))  # k rows a turn
    all_ = queries.select("row_id", F.explode(F.array(*[F.lit(w) for w in range(len(wants))])).alias("want"))
    return all_.join(one, ["row_id", "want"], "left").select("row_id", "want", F.coalesce(F.col("e.nbrs"), F.array().cast("array<bigint>")).alias("nbrs"), F.coalesce(F.col("e.dists"), F.array().cast("array<double>")).alias("dists"))


def nearest(queries: DataFrame, refs: DataFrame, k: int, rule: str = "any", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row_id, nbrs, dists) for (row_id, x, tag) queries and references; tag is a long."""
    return nearest_each(queries, refs, [(k, rule)], broadcast_bytes).drop("want")


def tagged(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "x", F.col("is_min").cast("long").alias("tag"))


def ranked(found: DataFrame) -> DataFrame:
    """(row_id, rank, nbr_id, dist), rank from 1."""
    return found.select("row_id", F.posexplode(F.arrays_zip("nbrs", "dists")).alias("p", "e")).select("row_id", (F.col("p") + 1).alias("rank"), F.col("e.nbrs").alias("nbr_id"), F.col("e.dists").alias("dist"))


def with_labels(found: DataFrame, rows: DataFrame) -> DataFrame:
    """ranked() with is_min of the row and nbr_is_min of the neighbour."""
    own = rows.select("row_id", "is_min")
    return ranked(found).join(own, "row_id").join(own.select(F.col("row_id").alias("nbr_id"), F.col("is_min").alias("nbr_is_min")), "nbr_id")
