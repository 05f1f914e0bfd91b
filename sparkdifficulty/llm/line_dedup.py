"""Line dedup with overlapping three-line windows, in DataFrame functions only.

A line is what stands between newlines; lines of white space alone are no part of windows and are always kept. Every
three consecutive remaining lines of a document are a window. A window that occurs more than once in the corpus is
kept where it occurs first (smallest id, then smallest place); the lines that any later occurrence covers are removed.
Windows overlap, so covered places of one document merge. Documents of fewer than three such lines are left alone.

Cases: a null text stays null and an empty one empty. Rows with a null id are left alone and count for nothing. Of
rows that repeat an id, each row is handled alike: places are those of the distinct (id, text) rows, the smaller text
first. Columns beside id and text pass through,
whatever their names. A window is compared by 64 bits of one hash and 32
of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WINDOW = 3


def _filled(text: Column) -> Column:
    """(place, line) of the lines that aren't white space alone."""
    lines = F.split(text, "\n", -1)
    placed = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    return F.filter(placed, lambda s: F.length(F.trim(F.regexp_replace(s["line"], r"[\t\x0B\f\r]", " "))) > 0)


def _windows(text: Column) -> Column:
    """(number, hashes) of each window of WINDOW consecutive filled lines."""
    filled = _filled(text)
    keys = F.transform(filled, lambda s: F.struct(F.xxhash64(s["line"]).alias("a"), F.hash(s["line"], F.lit(7)).alias("b")))

    def window(keys: Column) -> Column:
        return F.when(
            F.size(keys) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(keys) - WINDOW),
                lambda i: F.struct(
                    i.alias("w"),
                    F.xxhash64(*[keys[i + j]["a"] for j in range(WINDOW)]).alias("h"),
                    F.hash(*[keys[i + j]["b"] for j in range(WINDOW)]).alias("g"),
                ),
            ),
        )

    # the array is computed once: a lambda's argument is a value, a repeated column expression is not
    return F.element_at(F.transform(F.array(keys), window), 1)


def covered_windows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text_hash, w) of every window that occurred before, in an earlier place of the corpus."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("id").isNotNull() & F.col("text").contains("\n"))
    w = own.select("id", F.xxhash64("text").alias("th"), F.explode(_windows(F.col("text"))).alias("x")).select("id", "th", "x.*")
    first = w.groupBy("h", "g").agg(F.min(F.struct("id", "th", "w")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first")
    return w.join(first, ["h", "g"]).where(F.struct("id", "th", "w") != F.col("first")).select("id", "th", "w")


def _without(text: Column, windows: Column) -> Column:
    """(text, n): the text without the lines of the windows, in time linear in its lines, and how many lines went."""
    parts = F.struct(F.split(text, "\n", -1).alias("lines"), _filled(text).alias("filled"), F.array_distinct(F.flatten(F.transform(windows, lambda w: F.sequence(w, w + (WINDOW - 1))))).alias("numbers"))

    def cut(s: Column) -> Column:
        gone = F.transform(s["numbers"], lambda k: s["filled"][k]["at"])
        kept = F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), gone)
        return F.struct(F.array_join(F.transform(kept, lambda i: s["lines"][i]), "\n").alias("text"), F.size(s["numbers"]).alias("n"))

    # a lambda's argument is computed once
    return F.element_at(F.transform(F.array(parts), cut), 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the later copies of repeated windows gone from text, and n_lines_removed long added last."""
    # map-side sets keep a document's row small; each set is as long as its document at most
    hit = covered_windows(docs, id_col, text).groupBy("id", "th").agg(F.collect_set("w").alias("ws"))
    # the caller's columns travel as one, so that their names meet none of those used here
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"))
    joined = own.join(hit, ["id", "th"], "left")
    cut = joined.select("row", F.when(F.col("ws").isNotNull(), _without(F.col("row").getField(text), F.col("ws"))).alias("cut"))
    own_columns = [F.when(F.col("cut").isNull(), F.col("row").getField(c)).otherwise(F.col("cut.text")).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return cut.select(*own_columns, F.coalesce(F.col("cut.n"), F.lit(0)).cast("long").alias("n_lines_removed"))
