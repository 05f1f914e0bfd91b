"""Personal data: fixed patterns, and terms whose co-occurrence with protected values discloses them.

The base finds emails, IP addresses, card and phone numbers. Every value found is a protected entity. The corpus then
tells how strongly a term reveals an entity in whose texts it stands: their pointwise mutual information, as a share of
the entity's information content. Whole texts count on both sides, without their base spans, and every occurrence of
such a term in the texts that print the entity is a span; texts that don't print it get none. Terms whose share reaches GENERALISE are to be generalised, those that reach REMOVE to be
removed (information-theoretic sanitisation, Sanchez and Batet 2013). There is no least number of texts: an entity of
one text is disclosed by the terms that stand in few other texts.

Terms are compared by 64 bits of a hash; only their places stay with the texts, and are fetched for terms that are spans.

Cases: a null text is as an empty one: no spans. Rows are kept one for one, repeated rows and null ids included; copies
of a text count as texts on both sides of the share. Whole texts are searched, in time linear in their length. Columns
beside id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, chunks, discard, letters_only, materialize, tokens

#: The kinds in the order in which spans of one start are listed; the last two are the method's.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
#: A term is a word of so many letters at least.
TERM_LETTERS = 4
#: Shares of the entity's information disclosed.
GENERALISE = 0.8
REMOVE = 0.95
#: Bits of the bitmaps that tell which terms are asked for.
TERM_BITS = 23

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only start where a run of digits starts, so a digit before rules a place out
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_not_digit = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    out, last, i = [], 0, text.find("@")
    while i >= 0:
        start = i
        while start > last and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, i + 1) if start < i else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        i = text.find("@", m.end() if m else i + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted; kind is a place in KINDS."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _not_digit.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 9 <= len(_not_digit.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def entity(text: str, span: tuple[int, int, int]) -> str:
    """The protected value: an address in lower case, a number's digits."""
    a, kind, b = span
    return f"{KINDS[kind]}:{text[a:b].lower() if kind < 2 else _not_digit.sub('', text[a:b])}"


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[int]]:
    """Where each term of the text starts outside the (sorted) spans; nowhere for a term that stands within them only."""
    places: dict[str, list[int]] = {}
    k, upto = 0, 0
    for m in LETTERS.finditer(text):
        a, b = m.span()
        if b - a < TERM_LETTERS:
            continue
        while k < len(spans) and spans[k][0] < b:
            upto = max(upto, spans[k][2])
            k += 1
        at = places.setdefault(m[0], [])
        if a >= upto:
            at.append(a)
    # lower case as in tokens(): code point by code point
    out: dict[str, list[int]] = {}
    for term, at in zip(pc.utf8_lower(pa.array(list(places), pa.string())).to_pylist(), places.values(), strict=True):
        out.setdefault(term, []).extend(at)
    return out


_FOUND = "array<struct<at:int,kind:int,upto:int>>"
#: Bytes of text whose terms are gathered at once.
TERM_CHARS = 200_000


def _lists(flat: pa.Array, counts: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)


def find_base(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Of each text a row (rid, id, base, entities) with its base spans and distinct entities, and, if it has any, a row
    (rid, h, n, at) for each of its terms: hash, length and places. rid is a number of the text; write the table before rid is used."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    id_type = own.limit(0).toArrow().schema.field(0).type
    names = ["rid", "id", "base", "entities", "h", "n", "at"]
    kinds = [pa.int64(), id_type, pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("upto", pa.int32())])), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for b in chunks(batches, 1, TERM_CHARS):
            spans, n_spans, values, n_values, of, terms, places, n_places = [], [], [], [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = base_spans(t) if t else []
                spans += found
                n_spans.append(len(found))
                own_values = sorted({entity(t, x) for x in found})
                values += own_values
                n_values.append(len(own_values))
                if found:
                    for term, at in terms_of(t, found).items():
                        of.append(rid + i)
                        terms.append(term)
                        places += at
                        n_places.append(len(at))
            flat = np.array(spans, np.int32).reshape(-1, 3)
            base = _lists(pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, j])) for j in range(3)], names=["at", "kind", "upto"]), n_spans)
            rows = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + rows)), b.column(0), base, _lists(pa.array(values, pa.string()), n_values), *[pa.nulls(rows, k) for k in kinds[4:]]], names=names)
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *[pa.nulls(len(of), k) for k in kinds[1:4]], pa.array(hashes(terms).view(np.int64)), pa.array([len(x) for x in terms], pa.int32()), _lists(pa.array(places, pa.int32()), n_places)], names=names)
            rid += rows

    return own.mapInArrow(run, f"rid long, id {dict(own.dtypes)['id']}, base {_FOUND}, entities array<string>, h long, n int, at array<int>")


def hashes(terms: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in terms), dtype=np.uint64, count=len(terms))


def _bitmap(h: DataFrame) -> np.ndarray:
    """Of a column h of hashes: 2**TERM_BITS bits, whatever the corpus, that tell which first bits occur."""
    at = F.shiftrightunsigned("h", 64 - TERM_BITS)
    words = h.groupBy(F.shiftright(at, 5).alias("w")).agg(F.bit_or(F.expr(f"1L << cast(shiftrightunsigned(h, {64 - TERM_BITS}) & 31 as int)")).alias("bits")).toArrow()
    out = np.zeros(1 << (TERM_BITS - 5), dtype=np.uint32)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    return (bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def term_frequency(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(h, df): in how many texts each of the given terms (h) stands, and some others."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 0):
            t = tokens(b.column(0))
            of, words = [], []
            for i, token in enumerate(t.unique):
                for w in letters_only(token).split("\x02"):
                    if len(w) >= TERM_LETTERS:
                        of.append(i)
                        words.append(w)
            h = hashes(words)
            wanted = _in_bitmap(shared.value, h)
            if not wanted.any():
                continue
            h, word = np.unique(h[wanted], return_inverse=True)
            of = np.array(of)[wanted]
            doc = np.repeat(np.arange(b.num_rows), np.diff(t.offsets))
            first = np.searchsorted(of, np.arange(len(t.unique) + 1))
            n = np.diff(first)[t.codes]
            kept = n > 0
            times = n[kept]
            at = np.repeat(first[t.codes[kept]] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            pair = np.unique(np.repeat(doc[kept], times) * len(h) + word[at])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(pair % len(h), minlength=len(h)))], names=["h", "df"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))


def disclosing(found: DataFrame, terms: DataFrame, docs: DataFrame, text: str, n_docs: int) -> DataFrame:
    """(rid, h, share): the terms that reach GENERALISE for an entity of their text, with the largest share of an entity's
    information disclosed."""
    n = F.lit(float(n_docs))
    entities = found.select("rid", F.explode("entities").alias("entity"))
    entities = materialize(entities.join(entities.groupBy("entity").agg(F.count("*").alias("n_entity")), "entity"), "pii-entities")
    df = term_frequency(docs, text, terms.select("h"))
    within = terms.where(F.size("at") == 0).groupBy("h").agg(F.count("*").alias("within"))
    df = df.join(within, "h", "left").select("h", (F.col("df") - F.coalesce("within", F.lit(0))).alias("df"))
    # joint is n_entity at most, so a term of more texts than this can't reach GENERALISE for any entity of the text
    most = entities.groupBy("rid").agg((F.max(n * F.pow(F.col("n_entity") / n, F.lit(GENERALISE))) * 1.000001).alias("most"))
    rare = terms.where(F.size("at") > 0).select("rid", "h").join(df, "h").join(most, "rid").where(F.col("df") <= F.col("most")).select("rid", "h", "df")
    pairs = materialize(rare.join(entities, "rid"), "pii-pairs")
    info = -F.log2(F.col("n_entity") / n)
    pmi = F.log2(F.col("joint") * n / (F.greatest("df", "joint") * F.col("n_entity")))
    joint = pairs.groupBy("entity", "h").agg(F.count("*").alias("joint"), F.first("df").alias("df"), F.first("n_entity").alias("n_entity"))
    told = joint.where(info > 0).withColumn("share", pmi / info).where(F.col("share") >= GENERALISE).select("entity", "h", "share")
    out = materialize(pairs.select("rid", "entity", "h").join(told, ["entity", "h"]).groupBy("rid", "h").agg(F.max("share").alias("share")), "pii-told")
    discard(entities, pairs)
    return out


def places(terms: DataFrame, told: DataFrame) -> DataFrame:
    """told with n and at of its terms; a filter of fixed size keeps other terms from being moved."""
    shared = terms.sparkSession.sparkContext.broadcast(_bitmap(told.select("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_in_bitmap(shared.value, b.column(1).to_numpy().view(np.uint64))))

    return terms.mapInArrow(run, "rid long, h long, n int, at array<int>").join(told, ["rid", "h"])


def count_of(spans: Column, kind: int) -> Column:
    """How many of the spans are of a kind, a place in KINDS."""
    # the lambda takes the span alone: to a second parameter, default or not, Spark gives the span's place in the array
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of sorted (at, kind, upto) spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["at"].cast("string"), s["upto"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, spans): base spans and all spans, sorted arrays of (at, kind, upto)."""
    every = materialize(find_base(docs, id_col, text), "pii-found")
    found, terms = every.where("base is not null").select("rid", "id", "base", "entities"), every.where("h is not null").select("rid", "h", "n", "at")
    told = places(terms, disclosing(found, terms, docs, text, found.count()))
    kind = F.when(F.col("share") >= REMOVE, F.lit(KINDS.index("remove"))).otherwise(F.lit(KINDS.index("generalise")))
    # a term that discloses two entities is one span, of the stronger kind
    own = told.select("rid", kind.alias("kind"), "n", F.explode("at").alias("at"))
    extra = own.groupBy("rid").agg(F.collect_list(F.struct("at", "kind", (F.col("at") + F.col("n")).alias("upto"))).alias("extra"))
    more = found.select("rid", "id", "base").join(extra, "rid", "left")
    return more.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(_FOUND)))).alias("spans"))


def sanitise(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with base spans and generalised terms replaced by their kind, and removed terms gone."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], "" if KINDS[kind] == "remove" else "[word]" if KINDS[kind] == "generalise" else f"[{KINDS[kind]}]"]
        at = b
    return "".join([*out, text[at:]])


