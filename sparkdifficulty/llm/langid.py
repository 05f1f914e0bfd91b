"""Language of mixed-language text: scripts narrow candidates, Viterbi over words labels spans.

A word's candidates are the languages written in the script of most of its letters; the others are out, unless none is
written in it. Letters of scripts without spaces between words (Han and the kana) are words of their own.

Cases: a null text, or one without a letter, is `und` with score 0. Rows are kept one for one, repeated rows and
null ids included (a null id is neither learned from nor held out). Without any labelled row all texts are `und`.
Columns beside id, text and label are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Grams, Tokens, char_grams, chunks, hash_fraction, letters_only, map_rows, tokens

BITS = 16
ORDERS = range(1, 5)
#: A model is fitted on at most about this many labelled rows of each language.
TRAIN_ROWS = 2000
#: Nats that a change of language between two words costs.
SWITCH = 6.0
#: What a word costs in a language that isn't a candidate: more than any path saves.
RULED_OUT = 1e9
#: Letters that are words of their own.
ALONE = r"([\p{Han}\p{Hiragana}\p{Katakana}])"
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "THAI", "HANGUL", "HIRAGANA", "KATAKANA", "CJK", "OTHER")


def script_of(ch: str) -> int:
    name = unicodedata.name(ch, "OTHER").split(" ", 1)[0]
    return SCRIPTS.index(name) if name in SCRIPTS else len(SCRIPTS) - 1


_ascii = {chr(c): 0 for c in range(128)}


def script_of_word(word: str, known: dict[str, int]) -> int:
    """The script of most of the word's letters; of the one that comes first, if several are as frequent."""
    if word.isascii():
        return 0
    seen: dict[int, int] = {}
    for ch in word:
        s = known.get(ch)
        if s is None:
            s = known[ch] = script_of(ch) if ch.isalpha() else -1
        if s >= 0:
            seen[s] = seen.get(s, 0) + 1
    return max(seen, key=seen.__getitem__) if seen else len(SCRIPTS) - 1


def words_of(texts: pa.Array) -> Tokens:
    """Tokens of the texts, with letters that are words of their own set apart."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring_regex(texts, ALONE)).as_py():
        texts = pc.replace_substring_regex(texts, ALONE, r" \1 ")
    return tokens(texts)


@dataclass
class LangModel:
    """log_p[bucket, lang], and whether lang is written in a script: written[script, lang]."""

    langs: list[str]
    log_p: np.ndarray
    written: np.ndarray

    def emissions(self, unique: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each token: log-likelihood of each language (best 0), and its number of letters (0: not a word)."""
        words = [letters_only(t) for t in unique]
        at = [i for i, w in enumerate(words) if w]
        out = np.zeros((len(unique), len(self.langs)), dtype=np.float32)
        letters = np.zeros(len(unique), dtype=np.int64)
        if not at or not self.langs:
            return out, letters
        known = dict(_ascii)
        kept = [words[i] for i in at]
        g = char_grams(kept, ORDERS, BITS)
        order = np.argsort(g.word, kind="stable")
        word, bucket = g.word[order], g.bucket[order]
        starts = np.searchsorted(word, np.arange(len(kept)))
        lls = np.add.reduceat(self.log_p[bucket], starts, axis=0) / np.float32(2.0)
        scripts = np.fromiter((script_of_word(w, known) for w in kept), dtype=np.int64, count=len(kept))
        may = self.written[scripts]
        lls = lls - np.where(may | ~may.any(axis=1, keepdims=True), 0, RULED_OUT).astype(np.float32)
        out[at] = lls - lls.max(axis=1, keepdims=True)
        letters[at] = np.fromiter((len(w) - w.count("\x02") for w in kept), dtype=np.int64, count=len(kept))
        return out, letters


def viterbi(offsets: np.ndarray, emit: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word of many word sequences at once; ties go to the smaller label.

    Word t of all sequences still running is one step of NumPy work, so the loop is as long as the longest sequence.
    """
    n = np.diff(offsets)
    total, k = emit.shape
    label = np.zeros(total, dtype=np.int16)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order) or k == 0:
        return label
    first, length = offsets[:-1][order], n[order]
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    came = np.zeros(total, dtype=np.int16)
    stay = np.zeros((total, k), dtype=bool)
    score = emit[first].astype(np.float64)
    for t in range(1, int(length[0])):
        a = live[t]
        at = first[:a] + t
        s = score[:a]
        top = s.argmax(axis=1)
        leap = s[np.arange(a), top] - switch
        keep = s >= leap[:, None]
        stay[at] = keep
        came[at] = top
        score[:a] = np.where(keep, s, leap[:, None]) + emit[at]
    now = score.argmax(axis=1).astype(np.int16)
    for t in range(int(length[0]) - 1, -1, -1):
        a = live[t]
        at = first[:a] + t
        label[at] = now[:a]
        if t:
            now[:a] = np.where(stay[at, now[:a]], now[:a], came[at])
    return label


def _count_grams(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {v: i for i, v in enumerate(langs)}
        counts = np.zeros((len(langs), 1 << BITS), dtype=np.int64)
        scripts = np.zeros((len(langs), len(SCRIPTS)), dtype=np.int64)
        known = dict(_ascii)
        for b in chunks(batches, 0):
            t = words_of(b.column(0))
            lang = np.array([index[v] for v in b.column(1).to_pylist()], dtype=np.int64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(t.offsets))
            words = [letters_only(x) for x in t.unique]
            g: Grams = char_grams([w or "\x02" for w in words], ORDERS, BITS)
            for i in range(len(langs)):
                times = np.bincount(t.codes[lang[doc] == i], minlength=len(words))
                counts[i] += np.bincount(g.bucket, weights=times[g.word], minlength=1 << BITS).astype(np.int64)
                for j in np.flatnonzero(times):
                    if words[j]:
                        scripts[i, script_of_word(words[j], known)] += times[j]
        for i in range(len(langs)):
            for kind, row in (("g", counts[i]), ("s", scripts[i])):
                at = np.flatnonzero(row)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int32()), pa.array([kind] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["l", "kind", "at", "n"])

    return run


def train(docs: DataFrame, text: str, lang: str, usable: Column, train_rows: int = TRAIN_ROWS) -> LangModel:
    """Fit gram log-probabilities and scripts on a repeatable sample: at most about train_rows rows per language."""
    rows = docs.where(usable & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = rows.groupBy("l").count().collect()  # a row for each language
    langs = sorted(r["l"] for r in sizes)
    if not langs:
        return LangModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], min(1.0, train_rows / r["count"]))])
    sample = rows.where(hash_fraction("t") < share[F.col("l")]).distinct()  # copies of a text are drawn together and count once
    got = sample.mapInArrow(_count_grams(langs), "l int, kind string, at int, n long").groupBy("l", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    counts, scripts = np.zeros((len(langs), 1 << BITS)), np.zeros((len(langs), len(SCRIPTS)))
    for kind, into in (("g", counts), ("s", scripts)):
        part = got[got.kind == kind]
        into[part["l"].to_numpy(), part["at"].to_numpy()] = part["n"].to_numpy()
    p = counts + 0.5
    log_p = np.log(p / p.sum(axis=1, keepdims=True)).T.astype(np.float32)
    written = (scripts >= 0.02 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T & (scripts.T > 0)
    return LangModel(langs, np.ascontiguousarray(log_p), written)


def label_chunk(model: LangModel, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per text: language with most letters, that share of the letters, and the number of spans."""
    t = words_of(texts)
    emit, letters = model.emissions(t.unique)
    n_docs, k = len(t.offsets) - 1, len(model.langs)
    is_word = letters[t.codes] > 0
    doc = np.repeat(np.arange(n_docs), np.diff(t.offsets))[is_word]
    codes = t.codes[is_word]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])
    if k == 0 or not len(codes):
        return ["und"] * n_docs, np.zeros(n_docs), np.zeros(n_docs, np.int64)
    label = viterbi(offsets, emit[codes])
    held = np.bincount(doc * k + label, weights=letters[codes], minlength=n_docs * k).reshape(n_docs, k)
    best, total = held.argmax(axis=1), held.sum(axis=1)
    change = np.ones(len(codes), bool)
    change[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
    spans = np.bincount(doc[change], minlength=n_docs)
    names = [model.langs[b] if s else "und" for b, s in zip(best, total, strict=True)]
    return names, np.where(total > 0, held.max(axis=1) / np.maximum(total, 1), 0.0), spans


def identify(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """docs with lang_pred string, score double (share of letters in that language) and n_spans long added last."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS x languages floats, whatever the corpus
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, at):
            names, score, spans = label_chunk(shared.value, b.column(at))
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(names, pa.string()), pa.array(score), pa.array(spans.astype(np.int64))], names=[*[b.schema.names[i] for i in keep], "lang_pred", "score", "n_spans"])

    return map_rows(docs, run, "lang_pred string, score double, n_spans long", text)
