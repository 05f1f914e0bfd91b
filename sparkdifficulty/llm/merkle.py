"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, in DataFrame functions only.

A paragraph is a line with its newline. Its pieces are of at most PIECE code points and end at a sentence's end where
there is one; its digest is of its text. A section closes after a paragraph whose own digest says so (one of four on
average), so that sections after an edit fall into step again; its digest is of its paragraphs' digests, the root of the
sections' digests. A fingerprint is the whole tree as text:

    root:section(paragraph[pieces],paragraph[pieces])section(...)...

with digests in hexadecimal. Equal texts have equal roots. differing() compares roots, then sections, then the paragraphs
of differing sections, then the pieces of differing paragraphs. likeness() is the Dice coefficient of the distinct pieces that two
fingerprints hold.

Cases: a null text is as an empty one: no paragraph, and the root of nothing. Two empty trees are alike (1), an empty and
a filled one are not (0). Repeated rows and null ids are documents like others; rows equal in id and text share the next
document, which is the first of another id or text in order of id (null first) and hash of the text. Columns beside id
and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIECE = 24
#: A piece: text up to a sentence's or a line's end, or PIECE code points of it.
LEAF = f"(?s)[^\\n.!?]{{0,{PIECE - 1}}}(?:[.!?]+ ?|\\n|[^\\n.!?])"
#: Hex digits of a piece's, and of a paragraph's and a section's digest; the root has 32.
PIECE_DIGITS = 6
DIGITS = 12
#: A section closes after a paragraph whose digest ends in one of these.
CLOSING = ("0", "1", "2", "3")
#: Rows that one task numbers.
RUN = 200_000


def _digest(text: Column, digits: int) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, digits)


def fingerprint(text: Column) -> Column:
    """The tree of a text."""
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))

    def paragraph(line: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), lambda x: _digest(x, PIECE_DIGITS))
        return F.concat(_digest(line, DIGITS), F.lit("["), F.array_join(pieces, ""), F.lit("]"))

    def marked(p: Column) -> Column:
        return F.concat(p, F.when(F.substring(p, DIGITS, 1).isin(*CLOSING), F.lit("|")).otherwise(F.lit(",")))

    runs = F.filter(F.split(F.array_join(F.transform(F.transform(lines, paragraph), marked), ""), r"\|", -1), lambda x: x != "")

    def section(run: Column) -> Column:
        run = F.rtrim(run, F.lit(","))
        return F.concat(_digest(F.regexp_replace(run, r"\[[0-9a-f]*\]", ""), DIGITS), F.lit("("), run, F.lit(")"))

    # a lambda's argument is computed once
    whole = F.transform(F.array(F.array_join(F.transform(runs, section), "")), lambda x: F.concat_ws(":", F.md5(F.regexp_replace(x, r"\([^)]*\)", "").cast("binary")), x))
    return F.element_at(whole, 1)


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 32)


def pieces(print_: Column) -> Column:
    """The pieces' digests that a fingerprint holds, in order."""
    held = F.array_join(F.regexp_extract_all(print_, F.lit(r"\[([0-9a-f]*)\]"), F.lit(1)), "")
    return F.regexp_extract_all(held, F.lit(f"[0-9a-f]{{{PIECE_DIGITS}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two fingerprints' distinct pieces: 1 for equal trees, 0 for none in common."""

    def dice(s: Column) -> Column:
        n = F.size(s["a"]) + F.size(s["b"])
        return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(s["a"], s["b"])) / n)

    sets = F.struct(F.array_distinct(pieces(a)).alias("a"), F.array_distinct(pieces(b)).alias("b"))
    return F.when(a == b, F.lit(1.0)).otherwise(F.element_at(F.transform(F.array(sets), dice), 1))


def differing(a: Column, b: Column) -> Column:
    """Where tree a has what tree b has not: structs (section, paragraph, piece) of numbers from 0, of the pieces of those
    paragraphs, of those sections, that b doesn't have; empty for equal roots. A paragraph whose pieces b has in another
    order or elsewhere gives a null piece."""
    whole = lambda x: F.regexp_extract_all(x, F.lit(r"[0-9a-f]+\([^)]*\)"), F.lit(0))
    inner = lambda x: F.regexp_extract_all(x, F.lit(r"[0-9a-f]+\[[0-9a-f]*\]"), F.lit(0))
    leaf = lambda x: F.regexp_extract_all(F.regexp_extract(x, r"\[([0-9a-f]*)\]", 1), F.lit(f"[0-9a-f]{{{PIECE_DIGITS}}}"), F.lit(0))

    def compare(s: Column) -> Column:
        def of_paragraph(p: Column, i: Column, k: Column) -> Column:
            missing = F.filter(F.transform(leaf(p), lambda x, j: F.when(~F.array_contains(s["leaves"], x), j)), lambda j: j.isNotNull())
            return F.transform(F.when(F.size(missing) > 0, missing).otherwise(F.array(F.lit(None).cast("int"))), lambda j: F.struct(k.alias("section"), i.alias("paragraph"), j.alias("piece")))

        def of_section(x: Column, k: Column) -> Column:
            return F.when(F.array_contains(s["sections"], x), F.array().cast(none)).otherwise(F.flatten(F.transform(inner(x), lambda p, i: F.when(F.array_contains(s["paragraphs"], p), F.array().cast(none)).otherwise(of_paragraph(p, i, k)))))

        return F.flatten(F.transform(s["own"], of_section))

    none = "array<struct<section:int,paragraph:int,piece:int>>"
    sides = F.struct(whole(a).alias("own"), whole(b).alias("sections"), inner(b).alias("paragraphs"), pieces(b).alias("leaves"))
    return F.when(root(a) == root(b), F.array().cast(none)).otherwise(F.element_at(F.transform(F.array(sides), compare), 1))


def order_of(keys: DataFrame) -> DataFrame:
    """keys (id, h, g, n, copies), distinct, with pid, ph, pg, pn of the row before each in order of all columns; the first one's is the last."""
    parts = max(1, keys.count() // RUN)
    dealt = materialize(keys.repartitionByRange(parts, F.col("id").asc_nulls_first(), "h", "g").withColumn("part", F.spark_partition_id()), "merkle-keys")
    counts = dealt.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each of RUN rows
    inner = F.row_number().over(Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "h", "g")) - 1
    ranked = materialize(dealt.withColumn("inner", inner).join(counts.select("part", "before"), "part").select("id", "h", "g", "n", "copies", (F.col("inner") + F.col("before")).alias("rank")), "merkle-ranks")
    n = ranked.count()
    before = ranked.select(F.col("id").alias("pid"), F.col("h").alias("ph"), F.col("g").alias("pg"), F.col("n").alias("pn"), ((F.col("rank") + 1) % F.lit(max(n, 1))).alias("rank"))
    return ranked.join(before, "rank").drop("rank")


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, head, next_fingerprint): each row's text, null as empty, the next document's first floor(n / 2) code points
    for a text of n, and its fingerprint. Rows are paired by keys without texts; then a document sends only that head."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), value.alias("text"), F.xxhash64(F.lit(1), F.col(f"`{id_col}`"), value).alias("h"), F.xxhash64(value, F.col(f"`{id_col}`")).alias("g"))
    keys = order_of(own.groupBy("id", "h", "g").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies")))
    texts = own.select("h", "g", "text")  # the same columns both times, so that texts are moved once
    columns = ["h", "g", "pid", "ph", "pg", "pn"]
    sent = texts.join(keys.where("copies = 1").select(columns), ["h", "g"])
    more = keys.where("copies > 1")
    if more.limit(1).count():  # of rows equal in id and text one sends
        sent = sent.union(texts.join(more.select(columns), ["h", "g"]).groupBy(columns).agg(F.min("text").alias("text")).select(*sent.columns))
    once = sent.select("pid", F.col("ph").alias("h"), F.col("pg").alias("g"), F.expr("substring(text, 1, cast(pn div 2 as int))").alias("head"), fingerprint(F.col("text")).alias("next"))
    return texts.join(once, ["h", "g"]).select(F.col("pid").alias(id_col), "text", "head", F.col("next").alias("next_fingerprint"))


def compare_edits(pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For (id, text, head, next_fingerprint): fingerprints of the text and of its edit, in which the head replaces as much
    of the text's end as half of it, and likenesses of the text's fingerprint."""
    half = F.expr("substring(text, 1, length(text) - cast(length(text) div 2 as int))")
    own = pairs.select(id_col, F.length("text").cast("long").alias("n_chars"), "text", F.concat(half, "head").alias("edited"), F.col("next_fingerprint").alias("next"))
    # arrays of one struct, so that each fingerprint is computed once
    prints = F.transform(F.array(F.struct(F.col("text"), F.col("edited"))), lambda s: F.struct(fingerprint(s["text"]).alias("a"), fingerprint(s["edited"]).alias("b")))
    both = own.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next", F.explode(prints).alias("p"))
    return both.select(id_col, "n_chars", "edited_sha256", F.col("p.a").alias("fingerprint"), F.col("p.b").alias("edited_fingerprint"), likeness(F.col("p.a"), F.col("p.b")).alias("near_edited"), likeness(F.col("p.a"), F.col("next")).alias("near_next"))
