"""From raw documents to token ids: five stages, each written and read again before the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents, in order and whatever other columns there are beside doc_id, text, source and n_chars.

Cases: documents of null or empty text pass every stage but mixing, which takes no words of them. Rows of a null id are
scored, mixed and encoded like others, and belong to no group of near copies. Rows that repeat an id are one document to
the join, so one of them stays (the one of the smallest text hash); in mixing each is a row of its own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdifficulty.llm import line_dedup, mixing, ngram_join, queries, sp_tokens, toxicity
from sparkdifficulty.llm.common import hash_fraction, load, materialize


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """(row, more): all columns in one, so that their names meet none of those used beside them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.train_by_id(docs, queries.learnable(spark, sf_dir))
    named = [f"c{i}" for i in range(len(docs.columns))]
    kept = toxicity.score(docs.toDF(*named), model, named[docs.columns.index("text")], keep_text=True).where("predicted = 0")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(named, docs.columns, strict=True)])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line windows; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    of = dict(docs.dtypes)
    length = F.when(F.col("n_lines_removed") > 0, F.length("text"))
    return kept.select(*[F.coalesce(length, F.col(f"`{c}`")).cast(of[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; of rows that repeat its id, one."""
    groups = materialize(ngram_join.join_groups(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count("*").alias("times")), "copies-of")
    own = packed(docs, F.col("doc_id").alias("id"))
    left = own.join(groups.where("component <> doc_id or times > 1").select(F.col("doc_id").alias("id")), "id", "left_anti").select("row")
    repeated = groups.where("component = doc_id and times > 1").select(F.col("doc_id").alias("id"))
    if repeated.limit(1).count():
        left = left.union(own.join(repeated, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row"))
    return unpacked(left, docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words; a part of a document counts as that chance of a copy."""
    taken = mixing.mix(docs, keep_hash=True).groupBy("h").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("times"))
    copies = F.floor(F.col("times") + hash_fraction("h")).cast("int")
    chosen = taken.select("h", copies.alias("copies")).where("copies > 0")
    own = packed(docs, mixing.place_hash(F.col("doc_id"), F.col("text")).alias("h"))
    return unpacked(own.join(chosen, "h").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and whether they decode to the text, in place of the text."""
    return sp_tokens.encode(docs, queries.PIECE_MODEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", to_tokens),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
