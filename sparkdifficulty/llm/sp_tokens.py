"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here, and the normaliser, the metaspace marker, the pieces with their scores and the
byte fallback are rebuilt: a unigram model keeps its scores, a BPE model's merges follow from its pieces' scores.
Batches are encoded with several threads. parity() compares ids with the sentencepiece library.

Where no piece crosses a word's start, each distinct word is encoded once. A BPE model's user-defined
pieces are matched first, longest first, and nothing merges across them; a unigram model scores them by their length.

Cases: a null text has null ids and null decoded text, an empty one no ids. Texts are taken whole. A text that the
normaliser changes (say, one with control pieces' strings) decodes to its normalised form; `exact` tells whether the
decoded text equals the text. Rows are kept one for one; columns beside the text pass through.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import chunks, map_rows

#: The marker that stands for a space.
SPACE = "▁"
#: Fixed values of the model format: kinds of pieces, and kinds of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    """What the protobuf says of pieces, model and normaliser; defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """(number, value) of a protobuf message's fields: ints for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(wire)
        n = varint() if n is None else n
        yield key >> 3, data[at : at + n]
        at += n


def parse_model(data: bytes) -> PieceModel:
    m = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.kind = v
                elif k == 35:
                    m.byte_fallback = bool(v)
                elif k == 40:
                    m.unk_id = v
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.dummy_prefix = bool(v)
                elif k == 4:
                    m.squeeze_spaces = bool(v)
                elif k == 5:
                    m.escape_spaces = bool(v)
    return m


def _merges(vocab: dict[str, int], scores: dict[str, float]) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best-scored merged piece first."""
    found = []
    for piece, i in vocab.items():
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in vocab and b in vocab:
                found.append((-scores[piece], i, vocab[a], vocab[b], a, b))
    found.sort()
    return [(x[4], x[5]) for x in found]


def words_stay_apart(m: PieceModel) -> bool:
    """Whether no piece has the marker after another character, so that no merge crosses a word's start."""
    return not any(SPACE in p.lstrip(SPACE) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))


def build_tokenizer(m: PieceModel):  # noqa: ANN201
    """The tokenizers.Tokenizer equal to the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    if m.kind == BPE:
        mergeable = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
        scores = {p: s for p, s, _ in m.pieces}
        model = models.BPE(vocab, _merges(mergeable, scores), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=20_000)
    elif m.kind == UNIGRAM:
        # a user-defined piece scores by its bytes and the best piece of a score over 0, as the format has it
        best = max((s for _, s, kind in m.pieces if kind == NORMAL and s > 0), default=0.0)
        model = models.Unigram([(p, len(p.encode()) * best - 0.1 if kind == USER_DEFINED else s) for p, s, kind in m.pieces], m.unk_id, m.byte_fallback)
    else:
        raise ValueError(f"no unigram or BPE model: kind {m.kind}")
    t = Tokenizer(model)
    steps: list[Any] = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.squeeze_spaces:
        # spaces alone: other white space stays, and at the end markers go as spaces do
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +"), ""), normalizers.Replace(Regex(f"[ {SPACE}]+$"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", SPACE))
    t.normalizer = normalizers.Sequence(steps)
    if words_stay_apart(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
    back = [decoders.Replace(SPACE, " ")]
    if m.byte_fallback:
        back.append(decoders.ByteFallback())
    back.append(decoders.Fuse())
    if m.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(back)
    return t


#: Distinct words whose ids a worker remembers; beyond them it starts anew.
REMEMBERED = 250_000
#: Stands between words while they are split; a text that holds it is encoded in one piece.
CUT = "\x00"


class Codec:
    """Encodes and decodes chunks of texts. Where words stay apart, each distinct word of a chunk is encoded once."""

    def __init__(self, data: bytes, threads: int) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.model = parse_model(data)
        self.whole = build_tokenizer(self.model)
        self.by_word = words_stay_apart(self.model) and self.model.escape_spaces
        self.word = Tokenizer(self.whole.model)
        self.word.decoder = self.whole.decoder
        self.own = {p: i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == USER_DEFINED and self.model.kind == BPE}
        #: Whether a piece is its text; words of such pieces alone decode to themselves.
        self.plain = np.array([kind in (NORMAL, USER_DEFINED) for _, _, kind in self.model.pieces], dtype=bool)
        self._forget()

    def _forget(self) -> None:
        """No word is known but user-defined pieces: known[word] is the word's place in (starts, same), whose ids are flat[starts[i]:starts[i + 1]]."""
        self.known: dict[str, int] = {p: i for i, p in enumerate(self.own)}
        self.starts, self.same, self.flat = np.arange(len(self.own) + 1), np.ones(len(self.own), bool), np.array(list(self.own.values()), np.int32)

    def _places(self, words: list[str]) -> np.ndarray:
        """The words' places, after the ids of those not yet known are found."""
        if len(self.known) > REMEMBERED:
            self._forget()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            ids = [e.ids for e in self.word.encode_batch_fast(new, add_special_tokens=False)]
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(n.sum()))
            # words of bytes or unknown pieces are decoded to see whether they come back
            odd = np.concatenate([[0], np.cumsum(~self.plain[flat])])
            ends = np.cumsum(n)
            same = odd[ends] == odd[ends - n]
            some = np.flatnonzero(~same)
            for i, y in zip(some, self.word.decode_batch([ids[i] for i in some], skip_special_tokens=False), strict=True):
                w = new[i].replace(SPACE, " ") if self.model.escape_spaces else new[i]
                same[i] = y == (w[1:] if w[:1] == " " and self.model.dummy_prefix else w)
            known.update(zip(new, range(len(self.same), len(self.same) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
            self.same, self.flat = np.concatenate([self.same, same]), np.concatenate([self.flat, flat])
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def normal(self, texts: pa.Array) -> pa.Array:
        """The texts as the model's normaliser leaves them."""
        m = self.model
        if m.charsmap:
            return pa.array([self.whole.normalizer.normalize_str(x) for x in texts.to_pylist()], pa.large_string())
        if m.squeeze_spaces:
            for pattern, by in ((" {2,}", " "), ("^ +", ""), (f"[ {SPACE}]+$", "")):
                texts = pc.replace_substring_regex(texts, pattern, by)
        if m.dummy_prefix:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        return pc.replace_substring(texts, " ", SPACE) if m.escape_spaces else texts

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids, exact): the texts' ids end to end, and whether decoding gives a text again."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        if pc.any(pc.match_substring(texts, CUT)).as_py():
            listed = texts.to_pylist()
            codes = [e.ids for e in self.whole.encode_batch_fast(listed, add_special_tokens=False)]
            exact = np.array([y == x for x, y in zip(listed, self.decode(codes), strict=True)], dtype=bool)
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
            return offsets, np.array([i for c in codes for i in c], dtype=np.int32), exact
        apart = normal = self.normal(texts)
        if self.own:
            longest = "|".join(re.escape(p) for p in sorted(self.own, key=lambda p: (-len(p), p)))
            apart = pc.replace_substring_regex(apart, f"({longest})", f"{CUT}\\1{CUT}")
        if self.by_word:
            apart = pc.replace_substring_regex(apart, f"([^{SPACE}]){SPACE}", f"\\1{CUT}{SPACE}")
        lists = pc.split_pattern(apart, CUT)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        d = lists.flatten().dictionary_encode()
        place = self._places(d.dictionary.to_pylist())[d.indices.to_numpy(zero_copy_only=False)]
        times = self.starts[place + 1] - self.starts[place]
        done = np.concatenate([[0], np.cumsum(times)])
        out = self.flat[np.repeat(self.starts[place] - done[:-1], times) + np.arange(done[-1])]
        odd = np.concatenate([[0], np.cumsum(~self.same[place])])
        # decoding gives the normalised text, without the marker put before it
        back = pc.replace_substring(normal, SPACE, " ") if self.model.escape_spaces else normal
        if self.model.dummy_prefix:
            back = pc.replace_substring_regex(back, "^ ", "")
        exact = (odd[bounds[1:]] == odd[bounds[:-1]]) & pc.equal(back, texts).to_numpy(zero_copy_only=False)
        if not self.by_word:
            self._forget()
        return done[bounds], out, exact

    def decode(self, codes: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(codes, skip_special_tokens=False)


_built: dict[tuple[int, int], Codec] = {}


def codec(data: bytes, threads: int) -> Codec:
    """One codec for each model and worker process."""
    key = (hash(data), threads)
    if key not in _built:
        _built[key] = Codec(data, threads)
    return _built[key]


def parity(data: bytes, texts: list[str]) -> list[int]:
    """Places of the texts whose ids differ from those of the sentencepiece library."""
    import sentencepiece

    offsets, ids, _ = Codec(data, 2).encode(texts)
    ours = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts)
    return [i for i, (a, b) in enumerate(zip(ours, theirs, strict=True)) if a != b]


def encode(docs: DataFrame, model_file: str, text: str = "text", threads: int = 2) -> DataFrame:
    """docs with ids array<int>, n_tokens long and exact boolean (decoding gives the text again) in place of the text."""
    with open(model_file, "rb") as f:  # the driver's file; the model travels with the tasks
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)  # the size of a vocabulary
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, threads)
        for b in chunks(batches, at):
            null = b.column(at).is_null().to_numpy(zero_copy_only=False)
            offsets, flat, same = c.encode(pc.fill_null(b.column(at), ""))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(null, False)), pa.array(flat))
            n = pa.array(np.diff(offsets), mask=null)
            exact = pa.array(same, mask=null)
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], ids, n, exact], names=[*[b.schema.names[i] for i in keep], "ids", "n_tokens", "exact"])

    return map_rows(docs, run, "ids array<int>, n_tokens long, exact boolean", text)


def decode(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """encoded with text string in place of ids; null ids give a null text."""
    with open(model_file, "rb") as f:
        data = f.read()
    shared = encoded.sparkSession.sparkContext.broadcast(data)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, 1)
        for b in batches:
            codes = b.column(at).to_pylist()
            back = c.decode([x or [] for x in codes])
            texts = pa.array([y if x is not None else None for y, x in zip(back, codes, strict=True)], pa.string())
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], texts], names=[*[b.schema.names[i] for i in keep], "text"])

    return map_rows(encoded, run, "text string", ids)
