"""The pipeline's stages on nulls, repeated rows, clashing names and empty tables, each against what it should leave."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from sparkdifficulty.llm import mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, c1 int, id string, h long, copies string, `a.b` string, __th string"


def rows_of(docs):
    return Counter(tuple(r) for r in docs.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", 7, "x", 5, "y", "dot", "th") for i, t, s in rows], SCHEMA)


def words(rng, n):
    return " ".join(rng.choice("river stone wind house blue garden tree light paper road".split()) + rng.choice(["", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, words(rng, 60), "a" if i % 3 else "b") for i in range(30)]
    out += [(100, out[3][1] + " end", "a"), (101, out[3][1], "b"), (3, out[3][1], "a"), (3, out[3][1], "a")]  # copies, and rows that repeat an id
    out += [(None, out[5][1], "a"), (None, out[5][1], None), (200, None, "a"), (201, "", None), (202, " \n ", "b")]
    lines = "\n".join(words(rng, 8) for _ in range(5))
    return [*out, (300, "first\n" + lines, "a"), (301, lines + "\nlast one", "b")]


def test_toxic_documents_go(spark, rows, tmp_path):
    rng = random.Random(5)
    marked = [(1000 + i, words(rng, 40) + (" you moron trash" * 3 if i % 2 else ""), "a") for i in range(60)]
    docs = table(spark, rows + marked)
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(1000, 1060)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert got.schema == docs.schema
    assert rows_of(got) == rows_of(table(spark, rows + marked[::2]))
    assert isinstance(toxicity.FEATURES, int)


def test_lines_go(spark, rows):
    docs = table(spark, rows)
    got = corpus_pipeline.drop_lines(spark, docs, "")
    assert got.dtypes == docs.dtypes
    changed = rows_of(got) - rows_of(docs)
    assert [(r[0], r[1], r[4]) for r in changed] == [(301, "last one", 8)] and sum(rows_of(got).values()) == len(rows)


def test_one_of_near_copies_stays(spark, rows):
    docs = table(spark, rows)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.dtypes == docs.dtypes
    gone = rows_of(docs) - rows_of(got)
    # the copies go (301 shares all but three words with 300), and two of the three rows of id 3; null ids belong to no
    # group; a row without words is linked with nothing
    ids = Counter()
    for r, n in gone.items():
        ids[r[0]] += n
    assert ids == {3: 2, 100: 1, 101: 1, 301: 1} and not rows_of(got) - rows_of(docs)


def test_mixing_takes_rows_of_any_id(spark, rows):
    docs = table(spark, rows)
    got = rows_of(corpus_pipeline.mix_sources(spark, docs, ""))
    taken = mixing.mix(docs).collect()
    for s in ("a", "b"):
        size = sum(r["size"] for r in taken if r["source"] == s)
        target = next(r["target"] for r in taken if r["source"] == s)
        words_got = sum(len((r[1] or "").split()) * n for r, n in got.items() if r[3] == s)
        assert words_got == pytest.approx(target, abs=6 * 60) and words_got <= 3 * size
    assert {r[0] for r in got} <= {i for i, *_ in rows} and all(r[1] and r[1].split() for r in got)
    only_null = table(spark, [(None, "one two three", "a")] * 3)
    assert sum(rows_of(corpus_pipeline.mix_sources(spark, only_null, "")).values()) == 3


def test_tokens_come_last(spark, rows):
    docs = table(spark, rows)
    got = corpus_pipeline.to_tokens(spark, docs, "")
    assert got.columns == [*[c for c in docs.columns if c != "text"], "ids", "n_tokens", "exact"]
    out = got.collect()
    assert len(out) == len(rows) and sum(r["ids"] is None for r in out) == 1 and all(r["exact"] for r in out if r["ids"] is not None)


def test_empty_table(spark, tmp_path):
    docs = table(spark, [])
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_run_is_its_stages(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    assert out and {r["doc_id"] for r in out} <= set(docs) and all(len(r["ids"]) == r["n_tokens"] for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "sentencepiece"]
