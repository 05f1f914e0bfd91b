"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

Every source's documents are shuffled by a hash of the id and laid end to end; that tape is cut into blocks of equal
numbers of words. Slot k of the schedule is the point frac(k * golden ratio), mapped through the sources' cumulative
shares of slots; the r-th slot of a source takes its block r modulo the number of its blocks. A document is taken as
often as slots take the part of the tape that it lies on.

Cases: null and empty texts have size 0 and nothing is taken of them; a null source is a source of its own, last in
order; null ids and repeated rows are documents like others (rows equal in id and text share a place by order of text
hash). An empty table gives an empty result. Columns beside id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..preprocessing import doubles
from .common import materialize

#: frac(k * this) are the golden-ratio points.
GOLDEN = 0.6180339887498949
#: Weights of the sources in order, repeating; and how often a source may be taken at most.
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
#: Words in a block at most, and slots that the source with the least target gets at least (if it has the words).
BLOCK_WORDS = 4096
LEAST_SLOTS = 512
#: Points of the schedule in a run that is ranked by one task.
RUN = 8192
#: So many sources are broadcast at most; more are joined as any table.
FEW_SOURCES = 10_000
#: Rows of a source in one hash range of its shuffle, roughly.
RANGE_ROWS = 2000


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; 0 for null."""
    flat = F.translate(text, "\t\n\x0b\f\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(flat, " +", -1), lambda x: x != "")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Each source's target in words: the total by weight; what exceeds `most` times a source goes to the others."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = dict.fromkeys(order, 0.0), [s for s in order if sizes[s] > 0], float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        gone = set(over)
        free = [s for s in free if s not in gone]
    return out


def place_hash(id_: Column, text: Column) -> Column:
    """The hash that a document is shuffled by: of its id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS, keep_hash: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every document, and its place hash h last if asked for."""
    spark = docs.sparkSession
    id_of, text_of = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    tape = materialize(docs.select(id_of.alias("id"), F.col(f"`{source}`").alias("src"), n_words(text_of).alias("size"), place_hash(id_of, text_of).alias("h")), "mix-sizes")
    per = tape.groupBy("src").agg(F.sum("size").alias("total"), F.count("*").alias("rows")).collect()  # a row for each source
    sizes = {r["src"]: r["total"] for r in per}
    goal = targets(sizes)
    wanted = [goal[s] for s in goal if goal[s] > 0]
    block = max(1, min(block_words, int(min(wanted, default=1) / LEAST_SLOTS)))
    plan, rows_of = [], {r["src"]: r["rows"] for r in per}
    for i, s in enumerate(goal):
        blocks = -(-sizes[s] // block)
        rows = rows_of[s]
        plan.append((i, s, sizes[s], goal[s], blocks, goal[s] * blocks / sizes[s] if sizes[s] else 0.0, max(1, rows // RANGE_ROWS)))
    n_slots = round(sum(p[5] for p in plan))
    sources = spark.createDataFrame(plan, "k int, s string, source_size long, target double, blocks long, slots double, ranges int")  # a row for each source
    if len(plan) <= FEW_SOURCES:
        sources = F.broadcast(sources)

    # the schedule: points through cumulative shares, ranked per source by counts of earlier runs and within the run
    share, ends, total = 0.0, [], max(sum(p[5] for p in plan), 1e-300)
    for p in plan:
        share += p[5] / total
        ends.append(share)
    last = max((i for i, p in enumerate(plan) if p[5] > 0), default=0)
    point = F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))
    # the source whose share the point falls in; the shares' ends are one literal of the plan, however many
    choose = F.least(F.size(F.filter(doubles(ends), lambda e: e <= point)), F.lit(last))
    slots = spark.range(n_slots).select("id", F.floor(F.col("id") / RUN).alias("run"), choose.alias("k"))
    before = slots.groupBy("k", "run").count().withColumn("before", F.sum("count").over(Window.partitionBy("k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("run", "k").orderBy("id")) - 1
    ranked = slots.withColumn("r", rank).join(before, ["k", "run"]).select("k", (F.col("r") + F.coalesce("before", F.lit(0))).alias("r"))
    of = sources.select("k", "blocks")
    uses = ranked.join(of, "k").where(F.col("r") < F.lit(MOST) * F.col("blocks")).groupBy("k", (F.col("r") % F.col("blocks")).alias("block")).agg(F.count("*").alias("uses"))

    # the tape: words before a document are those of earlier hash ranges and those before it in its own
    known = tape.join(sources, F.col("src").eqNullSafe(F.col("s"))).withColumn("range", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32)))
    ahead = known.groupBy("k", "range").agg(F.sum("size").alias("words")).withColumn("ahead", F.sum("words").over(Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("k", "range", "ahead")
    inner = F.sum("size").over(Window.partitionBy("k", "range").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1))
    laid = known.withColumn("inner", inner).join(ahead, ["k", "range"]).withColumn("from", F.coalesce("inner", F.lit(0)) + F.coalesce("ahead", F.lit(0))).withColumn("to", F.col("from") + F.col("size"))

    # block j of a source is the words from floor(j * size / blocks) up to floor((j + 1) * size / blocks)
    block_of = lambda w: F.expr(f"cast((({w} + 1) * blocks - 1) div source_size as bigint)")  # noqa: E731  the last j whose block starts at or before word w
    some = laid.where("size > 0")
    pieces = some.withColumn("block", F.explode(F.sequence(block_of("`from`"), block_of("(`to` - 1)"))))
    lo, hi = F.greatest(F.col("from"), F.expr("(block * source_size) div blocks")), F.least(F.col("to"), F.expr("((block + 1) * source_size) div blocks"))
    taken = pieces.join(uses, ["k", "block"]).groupBy("h", "id", "k", "from").agg(F.sum((hi - lo) * F.col("uses")).alias("taken"))
    keys = (F.col("laid.h") == F.col("t.h")) & F.col("laid.id").eqNullSafe(F.col("t.id")) & (F.col("laid.k") == F.col("t.k")) & (F.col("laid.from") == F.col("t.from"))
    out = laid.alias("laid").join(taken.alias("t"), keys, "left")
    return out.select(F.col("laid.id").alias(id_col), F.col("src").alias(source), "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"), *([F.col("laid.h").alias("h")] if keep_hash else []))
