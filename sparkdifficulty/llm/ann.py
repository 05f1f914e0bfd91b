"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node. Between tasks a vector travels as a byte for each component and a scale; the graph and the
search go by the products of these, and the best of what is found is scored again with the vectors themselves, in double
precision and one order of components. Nodes first get neighbours from cells around pivots; a cell of too many rows is split
around pivots of its own, again and again. Then neighbours of neighbours meet:
every node's neighbourhood (its neighbours and the best of those that have it as a neighbour) is compared within
itself, pairs with a new member alone, and a pair that beats a node's worst neighbour replaces it (NN-descent, Dong et al.
2011); rounds of Spark joins go on until few neighbours change. Neighbourhoods without a new member don't meet again. A query expands the best unexpanded candidates of its beam, join by join,
until none is left, and the beam's nodes are expanded to the rows that hold their vectors.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Fewer rows
than asked give all of them. Ties go to the smaller id. Vectors of other lengths than the most frequent one take no
part. Rows that repeat an id and a vector count once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, mix64
from .ngram_join import _grouped

#: Neighbours of a node in the graph, reverse neighbours it meets, and the beam of a search.
DEGREE = 30
REVERSE = 30
BEAM = 200
#: Candidates that a search expands in a step.
EXPAND = 50
#: The share of changed neighbours below which rounds of NN-descent end.
SETTLED = 0.01
#: Rounds of cells, pivots at most (their vectors are broadcast), rows of a cell for each pivot, and rows of a cell at most.
CELLINGS = 4
PIVOTS = 2048
CELL_ROWS = 400
CELL_MOST = 2500
#: Pivots at most that split a cell of more rows.
SPLIT = 16


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, x) with x as its scale, four bytes, and a byte for each component."""
    for b in batches:
        if b.num_rows:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
            scale[scale == 0] = np.finfo(np.float32).tiny
            whole = np.rint(np.clip(x / scale[:, None], -127, 127)).astype(np.int8)
            coded = np.hstack([scale[:, None].view(np.int8), whole])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in coded], pa.binary())], names=["node", "x"])


def _matrix(b: pa.RecordBatch, i: int) -> np.ndarray:
    """The vectors of a column of codes."""
    codes = b.column(i)
    if not len(codes):
        return np.zeros((0, 0))
    at = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
    rows = np.frombuffer(codes.buffers()[2], np.int8)[at[0] : at[-1]].reshape(len(codes), -1)
    return rows[:, 4:] * np.ascontiguousarray(rows[:, :4]).view(np.float32).astype(np.float64)


def _stack(held: list[pa.RecordBatch], i: int) -> np.ndarray:
    return np.vstack([_matrix(b, i) for b in held])


def _flat(held: list[pa.RecordBatch], i: int) -> np.ndarray:
    return np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held])


_LINKS = "u long, v array<bigint>, sim array<double>"


def _links(u: list[int], v: list[np.ndarray], sim: list[np.ndarray]) -> pa.RecordBatch:
    at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in v])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else np.zeros(0, t), kind)) for x, t, kind in ((v, np.int64, pa.int64()), (sim, float, pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), *lists], names=["u", "v", "sim"])


def _best(v: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((v, -sim))[:k]


def _cells(pivots: np.ndarray, celling: int):  # noqa: ANN202
    """Each node to the cells of its two nearest pivots (by angle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b, 1)
                near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :2]
                n = near.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel() + celling * PIVOTS), b.column(0).take(pa.array(np.repeat(np.arange(len(x)), n))), b.column(1).take(pa.array(np.repeat(np.arange(len(x)), n)))], names=["cell", "node", "x"])

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, part, seed, node, x), a cell's seeds in each part: each node to the cell of its nearest seed (by angle)."""
    for (cell, _), held in _grouped(batches, 2):
        seed, nodes, x = _flat(held, 2), _flat(held, 3), _stack(held, 4)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        order = np.argsort(nodes[seed])
        pivots, unit, nodes = unit[seed][order], unit[~seed], nodes[~seed]
        if not len(nodes):
            continue
        sim = unit @ pivots.T
        # vectors of one direction are as near to several seeds: they are dealt out among these, or the cell would stay whole
        tied = sim >= sim.max(axis=1, keepdims=True) - 1e-9
        pick = mix64(nodes.astype(np.uint64) ^ mix64(np.array([cell]).astype(np.uint64))) % tied.sum(axis=1).astype(np.uint64)
        child = (tied.cumsum(axis=1) > pick[:, None].astype(np.int64)).argmax(axis=1)
        to = mix64(mix64(np.array([cell]).astype(np.uint64)) + child.astype(np.uint64)).astype(np.int64)
        rows = pa.Table.from_batches(held).combine_chunks().filter(pa.array(~seed))
        yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(nodes), rows.column(4).combine_chunks()], names=["cell", "node", "x"])


def cells(dealt: DataFrame) -> DataFrame:
    """dealt is (cell, node, x); cells of more than CELL_MOST rows are split by pivots until none is left."""
    fit = None
    while True:
        size = dealt.groupBy("cell").agg(F.count("*").alias("n"))
        sized = dealt.join(F.broadcast(size), "cell")  # a row for each cell
        own = sized.where(F.col("n") <= CELL_MOST).select("cell", "node", "x")
        fit = own if fit is None else fit.union(own)
        if not size.where(F.col("n") > CELL_MOST).limit(1).count():
            return fit
        big = materialize(sized.where(F.col("n") > CELL_MOST).withColumn("parts", F.floor(F.col("n") / CELL_MOST) + 1), "cells")
        w = Window.partitionBy("cell").orderBy(F.xxhash64("node", "cell"), "node")
        seeds = big.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SPLIT).where(F.col("r") <= F.greatest(F.lit(2), F.ceil(F.col("n") / CELL_ROWS)))
        seeds = seeds.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.lit(True).alias("seed"), F.col("r").cast("long").alias("node"), "x")
        # parts only share out the work: each has all of the cell's seeds
        rows = big.select("cell", F.pmod(F.xxhash64("node"), F.col("parts")).cast("long").alias("part"), F.lit(False).alias("seed"), "node", "x")
        dealt = materialize(rows.union(seeds).repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_split, f"cell long, node long, x {dict(big.dtypes)['x']}"), "cells")
        discard(big)


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, held in _grouped(batches, 1):
        nodes, x = _flat(held, 1), _stack(held, 2)
        sim = x @ x.T
        np.fill_diagonal(sim, -np.inf)
        k = min(DEGREE, len(nodes) - 1)
        if k > 0:
            best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            yield _links(nodes.tolist(), list(nodes[best]), list(np.take_along_axis(sim, best, axis=1)))


def _merge(k: int):  # noqa: ANN202
    """Of rows sorted by u: the k best distinct neighbours of each u, and which of them weren't in its old row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, sim, new = [], [], [], []

        def out() -> pa.RecordBatch:
            b = _links(u, v, sim)
            flags = pa.ListArray.from_arrays(b.column(1).offsets, pa.array(np.concatenate(new) if new else np.zeros(0, bool)))
            return pa.RecordBatch.from_arrays([*b.columns, flags], names=["u", "v", "sim", "new"])

        for key, held in _grouped(batches, 1):
            a = np.concatenate([b.column(1).flatten().to_numpy() for b in held])
            s = np.concatenate([b.column(2).flatten().to_numpy() for b in held])
            old = np.concatenate([b.filter(b.column(3)).column(1).flatten().to_numpy() for b in held])
            a, at = np.unique(a, return_index=True)
            s = s[at]
            keep = _best(a, s, k)
            u.append(key[0])
            v.append(a[keep])
            sim.append(s[keep])
            new.append(~np.isin(a[keep], old))
            if len(u) >= 5000:
                yield out()
                u, v, sim, new = [], [], [], []
        yield out()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare a node's neighbourhood, rows (w, m, new, worst, x), within itself: pairs with a new member that beat the worst
    neighbour of one of the two."""
    u, v, sims = [], [], []
    for _, held in _grouped(batches, 1):
        nodes, new, worst, x = _flat(held, 1), _flat(held, 2), _flat(held, 3), _stack(held, 4)
        order = np.lexsort((~new, nodes))  # of a node's rows one that says it is new
        nodes, at = np.unique(nodes[order], return_index=True)
        new, worst, x = (c[order[at]] for c in (new, worst, x))
        sim = x @ x.T
        np.fill_diagonal(sim, -np.inf)
        better = (sim > worst[:, None]) & (new[:, None] | new)
        for i in np.flatnonzero(better.any(axis=1)):
            j = np.flatnonzero(better[i])
            u.append(int(nodes[i]))
            v.append(nodes[j])
            sims.append(sim[i, j])
        if len(u) >= 5000:
            yield _links(u, v, sims)
            u, v, sims = [], [], []
    yield _links(u, v, sims)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, c, inner product) of rows (u, c, x_u, x_c)."""
    for b in batches:
        if b.num_rows:
            sim = np.einsum("ij,ij->i", _matrix(b, 2), _matrix(b, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim)], names=["u", "c", "s"])


def _merged(links: DataFrame, k: int) -> DataFrame:
    return links.repartition("u").sortWithinPartitions("u").mapInArrow(_merge(k), f"{_LINKS}, new array<boolean>")


def build_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int | None = None) -> DataFrame:
    """(u, v, sim): each node's neighbours; nodes is (node, x), x coded. rounds: how many at most; all that it takes if None."""
    n = nodes.count()
    dealt = None
    for i in range(CELLINGS):
        few = nodes.orderBy(F.xxhash64("node", F.lit(i)), "node").limit(max(1, min(PIVOTS, n // CELL_ROWS))).select("x").toArrow()  # at most PIVOTS vectors
        if not few.num_rows:
            return nodes.select(F.col("node").alias("u"), F.array().cast("array<bigint>").alias("v"), F.array().cast("array<double>").alias("sim"))
        pivots = np.vstack([_matrix(b, 0) for b in few.to_batches()])
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
        near = nodes.mapInArrow(_cells(pivots, i), f"cell long, node long, x {dict(nodes.dtypes)['x']}")
        dealt = near if dealt is None else dealt.union(near)
    links = cells(dealt).repartition("cell").sortWithinPartitions("cell").mapInArrow(_in_cells, _LINKS)
    # which neighbours are new: at first all
    graph = materialize(_merged(links.withColumn("old", F.lit(False)), degree), "graph")
    while rounds is None or rounds > 0:  # every change betters a node's neighbours, so it ends
        rounds = None if rounds is None else rounds - 1
        edge = graph.select("u", F.explode(F.arrays_zip("v", "sim", "new")).alias("e")).select("u", "e.v", "e.sim", "e.new")
        w = Window.partitionBy("w").orderBy(F.desc("sim"), "m")
        back = edge.select(F.col("v").alias("w"), F.col("u").alias("m"), "sim", "new").withColumn("r", F.row_number().over(w)).where(F.col("r") <= REVERSE).select("w", "m", "new")
        meet = edge.select(F.col("u").alias("w"), F.col("v").alias("m"), "new").union(back).union(graph.select(F.col("u").alias("w"), F.col("u").alias("m"), F.lit(False).alias("new")))
        meet = materialize(meet.groupBy("w", "m").agg(F.bool_or("new").alias("new")), "meet")
        stirred = meet.groupBy("w").agg(F.bool_or("new").alias("stirred")).where("stirred").select("w")
        worst = graph.select(F.col("u").alias("m"), F.when(F.size("sim") < degree, F.lit(float("-inf"))).otherwise(F.array_min("sim")).alias("worst"))
        own = nodes.select(F.col("node").alias("m"), "x").join(worst, "m", "left").select("m", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"), "x")
        met = meet.join(stirred, "w", "left_semi").join(own, "m").select("w", "m", "new", "worst", "x").repartition("w").sortWithinPartitions("w").mapInArrow(_meet, _LINKS)
        both = graph.drop("new").withColumn("old", F.lit(True)).union(met.withColumn("old", F.lit(False)))
        after = materialize(_merged(both, degree), "graph")
        changed = after.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] or 0
        discard(graph, meet)
        graph = after
        if changed <= SETTLED * degree * n:
            break
    return graph.drop("new")


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(u, v, sim): the beam of each query node u after greedy search; queries is (u), nodes of the graph."""
    q = queries.select("u").distinct().join(nodes.withColumnRenamed("node", "u"), "u")
    q = materialize(q, "asked")
    state = materialize(graph.join(queries.select("u").distinct(), "u", "left_semi").withColumn("done", F.array().cast("array<bigint>")), "beam")
    while True:  # every step expands nodes that it hasn't expanded before, so it ends
        todo = state.withColumn("next", F.slice(F.array_except("v", "done"), 1, EXPAND))
        step = todo.select("u", F.explode("next").alias("c"))
        via = graph.select(F.col("u").alias("c"), F.col("v").alias("more"))
        new = step.join(via, "c").select("u", F.explode("more").alias("c")).distinct().where("u <> c")
        seen = todo.select("u", F.explode(F.array_union("v", "done")).alias("c"))
        fresh = new.join(seen, ["u", "c"], "left_anti")
        rows = fresh.join(nodes.select(F.col("node").alias("c"), F.col("x").alias("xc")), "c").join(q, "u").select("u", "c", "x", "xc")
        scored = rows.mapInArrow(_scored, "u long, c long, s double").groupBy("u").agg(F.collect_list(F.struct("s", "c")).alias("got"))  # at most EXPAND * DEGREE for each query
        marked = todo.select("u", "v", "sim", F.array_union("done", "next").alias("done")).join(scored, "u", "left")
        everything = F.concat(F.zip_with("sim", "v", lambda s, c: F.struct((-s).alias("s"), c.alias("c"))), F.coalesce(F.transform("got", lambda g: F.struct((-g["s"]).alias("s"), g["c"].alias("c"))), F.array().cast("array<struct<s:double,c:bigint>>")))
        kept = marked.withColumn("best", F.slice(F.array_sort(everything), 1, beam))
        after = materialize(kept.select("u", F.transform("best", lambda g: g["c"]).alias("v"), F.transform("best", lambda g: -g["s"]).alias("sim"), "done"), "beam")
        discard(state)
        state = after
        if not state.where(F.size(F.array_except("v", "done")) > 0).limit(1).count():
            return state.select("u", "v", "sim")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", rounds: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which is_query holds."""
    x = F.col(f"`{vector}`")
    own = vectors.where(F.col(f"`{id_col}`").isNotNull() & valid(x)).select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x"), is_query.alias("q"))
    lengths = own.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    own = own.where(F.size("x") == (lengths["n"] if lengths else 0)).withColumn("h", F.xxhash64("x")).withColumn("g", F.hash("x"))
    first = own.groupBy("h", "g").agg(F.min("id").alias("node"))
    rows = materialize(own.select("id", "h", "g", "q").distinct().join(first, ["h", "g"]).select("id", "node", "q"), "rows")
    whole = materialize(own.join(first.select(F.col("node").alias("id"), "h", "g"), ["id", "h", "g"], "left_semi").groupBy("id", "h", "g").agg(F.first("x").alias("x")).select(F.col("id").alias("node"), "x"), "nodes")
    nodes = materialize(whole.mapInArrow(_code, "node long, x binary"), "codes")
    graph = build_graph(nodes, max(DEGREE, k), rounds)
    asked = rows.where("q").select(F.col("node").alias("u")).distinct()
    found = search(graph, nodes, asked, max(BEAM, 2 * k))
    # the best of the beam are scored with the vectors themselves; the query's own node is as near as its vector to itself
    best = found.select("u", F.explode(F.array_append(F.slice("v", 1, 2 * k), F.col("u"))).alias("v"))
    both = best.join(whole.select(F.col("node").alias("u"), F.col("x").alias("a")), "u").join(whole.select(F.col("node").alias("v"), F.col("x").alias("b")), "v")
    near = both.select("u", "v", F.aggregate(F.zip_with("a", "b", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, y: s + y).alias("sim"))
    # a node's rows, as many as a result can use
    some = rows.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).select("node", "id")
    top = near.join(some, F.col("v") == F.col("node")).select("u", "id", "sim")
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "id"))).where(F.col("r") <= k + 1).groupBy("u").agg(F.sort_array(F.collect_list(F.struct("r", "id", "sim"))).alias("top"))  # k + 1 rows
    out = rows.where("q").select(F.col("id").alias("query_id"), F.col("node").alias("u")).join(top, "u")
    others = F.slice(F.filter("top", lambda t: t["id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("p", "t")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("t.id").alias("vec_id"), F.col("t.sim").alias("score"))
