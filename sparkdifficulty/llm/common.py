"""Pieces that several corpus operators share: tables, shared folders, word chunks."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, shared_dir

__all__ = ["CHUNK_CHARS", "LETTERS", "Grams", "Tokens", "char_grams", "chunks", "crc_mod", "discard", "give_back", "hash_fraction", "letters_only", "load", "map_rows", "materialize", "mix64", "shared_dir", "tokens"]

#: Code points of one chunk of texts that a Python worker handles at once; a longer text is a chunk alone.
CHUNK_CHARS = 1_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(docs: DataFrame, run: Callable, added: str, without: str | None = None) -> DataFrame:
    """docs.mapInArrow(run) with the columns of `added` last and `without` gone; columns travel by place, so names may be any."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = [i for i, c in enumerate(docs.columns) if c != without]
    types = [t for _, t in docs.dtypes]
    out = named.mapInArrow(run, ", ".join([*[f"c{i} {types[i]}" for i in kept], added]))
    return out.toDF(*[docs.columns[i] for i in kept], *out.columns[len(kept) :])


def crc_mod(id_col: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def hash_fraction(*cols: str) -> Column:
    """A repeatable number in [0, 1) from the given columns, for bounded samples."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the machine: Python workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = CHUNK_CHARS, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one slice holds at most about `limit` bytes of text, and `rows` rows."""
    for b in batches:
        give_back()
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
            upto = min(max(upto, at + 1), at + rows)
            yield b.slice(at, upto - at)
            at = upto
    give_back()


@dataclass
class Tokens:
    """White-space tokens of a chunk: doc i has codes[offsets[i]:offsets[i+1]], which index `unique`."""

    offsets: np.ndarray
    codes: np.ndarray
    unique: list[str]


def tokens(texts: pa.Array, lower: bool = True) -> Tokens:
    """Split texts at Unicode white space (null: no token) and number the distinct tokens."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    lists = pc.utf8_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    d = flat.dictionary_encode()
    return Tokens(offsets, d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist())


#: Marks the ends of a word among code points.
EDGE = 2
#: A run of letters (Unicode categories L and, with them, M).
LETTERS = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
_ascii_letters = re.compile(r"[A-Za-z]+")


def letters_only(token: str) -> str:
    """The token's letters, runs of other characters between letters turned into one word edge."""
    return "\x02".join((_ascii_letters if token.isascii() else LETTERS).findall(token))


@dataclass
class Grams:
    """Hashed character n-grams of words: gram j is of word[j] and has hash bucket[j]."""

    word: np.ndarray
    bucket: np.ndarray


def char_grams(words: list[str], orders: range, bits: int) -> Grams:
    """n-grams of the given orders within word edges; each word is flanked by EDGE. Words without letters have none."""
    text = "\x02" + "\x02".join(words) + "\x02"
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(cp)
    edge = cp == EDGE
    lengths = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
    of = np.repeat(np.arange(len(words)), lengths)
    of = np.append(of, max(len(words) - 1, 0))
    pos = np.arange(n)
    ends = np.where(edge, pos, n)
    nxt = np.minimum.accumulate(ends[::-1])[::-1]  # the first edge at or after a position
    after = np.append(nxt[1:], n)  # the first edge after a position
    out_w, out_b = [], []
    h = cp.copy()
    with np.errstate(over="ignore"):
        for k in range(1, orders.stop):
            if k > 1:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + cp[k - 1 :] + np.uint64(k)
            if k < orders.start or len(h) == 0:
                continue
            at = np.flatnonzero((pos[: len(h)] + k - 1 <= after[: len(h)]) & ~(edge[: len(h)] & (after[: len(h)] - pos[: len(h)] <= 1)))
            if k == 1:
                at = at[~edge[at]]
            out_w.append(of[at])
            out_b.append((mix64(h[at] ^ np.uint64(k << 56)) >> np.uint64(64 - bits)).astype(np.int64))
    if not out_w:
        return Grams(np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Grams(np.concatenate(out_w), np.concatenate(out_b))
