"""Jaccard join of documents on word n-grams, exact, and the groups its links make.

A document's set is its distinct shingles, as 48-bit hashes. One pass cuts documents into chunks and deals each chunk's
shingles out by ranges of the hash, packed; a range's task counts in how many sets of chunks each shingle stands and sends back
those of two or more, with that frequency. Only those can be in an overlap, so a document with fewer than `percent` of
its shingles among them is linked with nothing. For the others, prefix filtering with the rarest shingles first (Bayardo
et al. 2007, Chaudhuri et al. 2006) gives a few keys each; linked documents share one. Documents of one key are tied in
order of size, where sizes allow a link, so ties grow with the number of documents and not of pairs. A passage that many
documents share is frequent, so it stands last in that order and ties nothing but documents that are little else.

Search: tied documents are a block, and every document of it is a query of T-occurrence search (DivideSkip, Li et al.
2008): an inverted index maps shingles to documents; the long lists of the query's shingles are set aside, the short ones
are heap-merged, and documents that occur often enough are looked up in the long lists by binary search. First the index
holds one leader of each group found so far; then documents outside the largest group search all documents of the
block. What is left out are only pairs already known to be in one group, so groups are exact and no pair table is made.

A block with more than BLOCK_SHINGLES shingles is cut into parts, which are searched alone; the leaders of the parts'
largest groups are a smaller block of their own; then documents outside the block's main group search the other parts.

Cases: a document without words or with a null text has no shingles and is linked with nothing. One with fewer than k
words has its whole sequence as its one shingle. Null ids get n_shingles but a null component. Rows that repeat an id
count as one document, whose texts' links are all its own. Copies (equal sets) are one node. Ids may be of any type that
has an order. Columns beside id and text are ignored. Exact up to hash collisions.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import chunks, discard, give_back, materialize, mix64

#: Shingles of the texts that one task holds at once.
BLOCK_SHINGLES = 1_000_000
#: DivideSkip's constant for how many lists count as long (the authors' experiments: below 0.01).
MU = 0.0085
#: Bytes of text whose shingles are packed together, and bytes of all texts for each range of hashes.
PACK_CHARS = 4_000_000
RANGE_CHARS = 2_000_000
#: Bits of a shingle, and bits of a range's number at most.
TOKEN_BITS = 48
RANGE_BITS = 20


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (null: none). Words end at ASCII white space; A-Z are lower-cased."""
    # Arrow's own ASCII white space takes bytes within a code point for white space
    flat = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), "[\t-\r]", " ")
    lists = pc.split_pattern(flat, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    d = lists.flatten().dictionary_encode()
    words = d.dictionary.to_pylist()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass").lower()) for w in words), dtype=np.uint64, count=len(words))
    empty = next((i for i, w in enumerate(words) if w == ""), -1)
    codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    if empty >= 0:  # white space beside white space or at a text's ends
        full = codes != empty
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        codes = codes[full]
    h = own[codes] if len(codes) else np.zeros(0, np.uint64)
    roll = h.copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            roll = roll[: max(len(h) - j, 0)] * np.uint64(0x9E3779B97F4A7C15) + h[j:]
        roll = mix64(roll + np.uint64(k))
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(roll[a : b - k + 1]))
            elif b > a:
                x = np.uint64(0)
                for y in h[a:b]:
                    x = x * np.uint64(0x9E3779B97F4A7C15) + y
                out.append(mix64(np.array([x + np.uint64(b - a)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> int:
    """64 bits of a set, as a signed number."""
    with np.errstate(over="ignore"):
        a, b = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
        return int(mix64(np.array([a + mix64(np.array([b + np.uint64(len(s))]))[0]]))[0].astype(np.int64))


def pack(token: np.ndarray, *more: np.ndarray) -> bytes:
    """Ascending tokens and columns of small numbers, compressed byte by byte of each value."""
    gaps = np.diff(token, prepend=np.uint64(0)).astype("<u8")
    planes = [c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in (gaps, *more)]
    return pa.Codec("zstd", compression_level=1).compress(b"".join(planes), asbytes=True)


def unpack(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    kinds = ("<u8", *kinds)
    widths = [np.dtype(k).itemsize for k in kinds]
    data, at, out = np.frombuffer(pa.Codec("zstd").decompress(blob, n * sum(widths), asbytes=True), np.uint8), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(data[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


_PACKED = "chunk long, part int, n long, pack binary"


def _measure(k: int, bits: int, id_type: pa.DataType):  # noqa: ANN202
    """Of (id, text): a row (id, n, g) for each document, and the packed shingles of each chunk's distinct sets by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, names = TaskContext.get().partitionId(), ["id", "n", "g", "chunk", "place", "part", "pack"]
        for seq, b in enumerate(chunks(batches, 1, PACK_CHARS, 1 << 16)):
            sets = shingle_sets(b.column(1), k)
            mark, n = np.array([set_hash(s) for s in sets], np.int64), np.array([len(s) for s in sets], np.int64)
            chunk = (of << 32) + seq
            # one of each set goes on; null ids and empty sets don't
            first = np.unique(mark, return_index=True)[1]
            use = np.flatnonzero(~b.column(0).is_null().to_numpy(zero_copy_only=False) & (n > 0))
            first = use[np.unique(mark[use], return_index=True)[1]]
            place = np.full(len(sets), -1)
            place[first] = np.arange(len(first))
            none = [pa.nulls(len(sets), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(mark), pa.array(np.full(len(sets), chunk)), pa.array(place.astype(np.int32), mask=place < 0), *none], names=names)
            if not len(first):
                continue
            token = np.concatenate([sets[i] for i in first]) >> np.uint64(64 - TOKEN_BITS)
            doc = np.repeat(np.arange(len(first), dtype="<u2"), n[first])
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            of_part = (token >> np.uint64(TOKEN_BITS - bits)).astype(np.int64)
            lo = np.flatnonzero(np.diff(of_part, prepend=-1))
            part, hi = of_part[lo], np.append(lo[1:], len(token))
            blobs = [pack(token[x:y], doc[x:y]) for x, y in zip(lo, hi, strict=True)]
            m = len(part)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.array(hi - lo), pa.nulls(m, pa.int64()), pa.array(np.full(m, chunk)), pa.nulls(m, pa.int32()), pa.array(part.astype(np.int32)), pa.array(blobs, pa.binary())], names=names)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed shingles, sorted by range: those that two sets of chunks or more hold, with a byte for their frequency."""
    for (part,), held in _grouped(batches, 1):
        chunk, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2))
        token, doc = zip(*[unpack(x.as_buffer(), int(m), "<u2") for x, m in zip((x for b in held for x in b.column(3)), n, strict=True)], strict=True)
        ends = np.cumsum(n)
        token, doc = np.concatenate(token), np.concatenate(doc)
        order = np.argsort(token, kind="stable")
        new = np.ones(len(token), bool)
        new[1:] = token[order[1:]] != token[order[:-1]]
        df = np.diff(np.append(np.flatnonzero(new), len(token)))
        # a step of an eighth of a doubling; the order only has to be the same for all
        step = np.minimum(np.log2(df) * 8, 255).astype(np.uint8)
        often = np.empty(len(token), np.uint8)
        often[order] = np.repeat(step, df)
        del order, new
        out = []
        for c, a, e in zip(chunk, ends - n, ends, strict=True):
            kept = a + np.flatnonzero(often[a:e])
            if len(kept):
                out.append((c, len(kept), pack(token[kept], doc[kept], often[kept])))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["chunk", "part", "n", "pack"])
        give_back()


_CANDIDATES = "g long, chunk long, n long, s array<bigint>, key long, lo long, hi long, a long, b long"


def _lists(flat: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))


def _candidates(percent: int):  # noqa: ANN202
    """Of a chunk's documents and shared shingles: documents that can be linked with their shared shingles, ties of those of one key, and each
    key's runs of sizes with a document of each."""

    def rows(count: int, /, **columns) -> pa.RecordBatch:  # noqa: ANN003
        names = ["g", "chunk", "n", "s", "key", "lo", "hi", "a", "b"]
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(count, pa.list_(pa.int64()) if c == "s" else pa.int64())) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are (chunk, part, n, pack, place, g); part -1 holds the documents
        for (chunk,), held in _grouped(batches, 1):
            part, n, place, g = (np.concatenate([b.column(i).fill_null(0).to_numpy() for b in held]) for i in (1, 2, 4, 5))
            blobs = [x for b in held for x in b.column(3)]
            docs, packs = np.flatnonzero(part < 0), np.flatnonzero(part >= 0)
            if not len(packs):
                continue
            size, mark = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            size[place[docs]], mark[place[docs]] = n[docs], g[docs]
            token, doc, often = (np.concatenate(x) for x in zip(*[unpack(blobs[i].as_buffer(), int(n[i]), "<u2", "u1") for i in packs], strict=True))
            del blobs, held
            need = -(-percent * size // 100)
            shared = np.bincount(doc, minlength=len(size))
            kept = (shared >= need)[doc]
            token, doc, often = token[kept].astype(np.int64), doc[kept].astype(np.int64), often[kept]
            if not len(token):
                continue
            shared = np.bincount(doc, minlength=len(size))
            order = np.lexsort((token, doc))
            own = np.flatnonzero(shared)
            yield rows(len(own), g=pa.array(mark[own]), chunk=pa.array(np.full(len(own), chunk)), n=pa.array(size[own]), s=_lists(token[order], shared[own]))
            # of the prefix, shingles of this document alone need no key
            order = np.lexsort((token, often, doc))
            rank = np.arange(len(order)) - np.repeat(np.cumsum(shared[own]) - shared[own], shared[own])
            order = order[rank < (shared - need + 1)[doc[order]]]
            key, doc = token[order], doc[order]
            order = np.lexsort((mark[doc], size[doc], key))
            key, doc = key[order], doc[order]
            near = (key[1:] == key[:-1]) & (100 * size[doc[:-1]] >= percent * size[doc[1:]])
            tied = np.unique(np.stack([mark[doc[:-1]], mark[doc[1:]]], axis=1)[near], axis=0)
            yield rows(len(tied), a=pa.array(np.ascontiguousarray(tied[:, 0])), b=pa.array(np.ascontiguousarray(tied[:, 1])))
            start = np.flatnonzero(np.concatenate([[True], ~near]))
            end = np.append(start[1:], len(key)) - 1
            yield rows(len(start), g=pa.array(mark[doc[start]]), key=pa.array(key[start]), lo=pa.array(size[doc[start]]), hi=pa.array(size[doc[end]]))
            give_back()

    return run


def _ties(percent: int):  # noqa: ANN202
    """Of (key, lo, hi, g) sorted so: each run of sizes with the one before it, where the sizes up to there allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key, lo, hi, g = (b.column(i).to_numpy() for i in range(4))
            if last is not None:
                key, lo, hi, g = (np.concatenate([[x], y]) for x, y in zip(last, (key, lo, hi, g), strict=True))
            new = np.ones(len(key), np.int64)
            new[1:] = key[1:] != key[:-1]
            most = np.maximum.accumulate((np.cumsum(new) << 40) + hi) & ((1 << 40) - 1)
            near = (new[1:] == 0) & (100 * most[:-1] >= percent * lo[1:]) & (g[1:] != g[:-1])
            pair = np.unique(np.stack([g[:-1], g[1:]], axis=1)[near], axis=0)
            last = (key[-1], lo[-1], most[-1], g[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], names=["a", "b"])

    return run


class Index:
    """An inverted index from shingles to places; places are added in ascending order."""

    def __init__(self) -> None:
        self.lists: dict[int, list[int]] = {}

    def add(self, place: int, shingles: list[int]) -> None:
        for s in shingles:
            self.lists.setdefault(s, []).append(place)

    def search(self, shingles: list[int], least: int, needed, wanted) -> Iterator[int]:  # noqa: ANN001
        """Places that have needed(place) >= least of the shingles. DivideSkip; wanted(place) may rule places out."""
        lists = [x for x in map(self.lists.get, shingles) if x]
        if len(lists) < least:
            return
        lists.sort(key=len)
        long = min(least - 1, int(least / (MU * log2(max(len(lists[-1]), 2)) + 1)))
        short, long_lists = lists[: len(lists) - long], lists[len(lists) - long :]
        for place, run in groupby(heapq.merge(*short)):
            seen = sum(1 for _ in run)
            if seen < least - long or not wanted(place):
                continue
            need, left = needed(place), len(long_lists)
            for x in reversed(long_lists):
                if seen >= need or seen + left < need:
                    break
                i = bisect_left(x, place)
                seen += i < len(x) and x[i] == place
                left -= 1
            if seen >= need:
                yield place


class Union:
    def __init__(self, n: int) -> None:
        self.up, self.size = list(range(n)), [1] * n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.find(i), self.find(j)))
        if i != j:
            self.up[j] = i
            self.size[i] += self.size[j]


def _bounds(percent: int, sizes: list[int]):  # noqa: ANN202
    def least(i: int) -> int:
        """Overlap that the smallest possible partner of i needs."""
        return max(1, -(-percent * (sizes[i] + -(-percent * sizes[i] // 100)) // (100 + percent)))

    def needed(i: int, j: int) -> int:
        return -(-percent * (sizes[i] + sizes[j]) // (100 + percent))

    def near(i: int, j: int) -> bool:
        return 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j])

    return least, needed, near


def _common(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The shingles of each set that another of the sets holds too: only those make overlaps."""
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = n[code] > 1
    ends = np.cumsum([len(s) for s in sets])
    return [s[kept[e - len(s) : e]] for s, e in zip(sets, ends, strict=True)]


def link_block(ids: list[int], sizes: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """For each document the smallest id of its group, the groups being those of all links among the given ones. sets may
    leave out shingles that no other document has; sizes count them."""
    order = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i]))
    common = _common(sets)
    own = [common[i].tolist() for i in order]
    least, needed, near = _bounds(percent, [sizes[i] for i in order])
    groups, leaders, members = Union(len(ids)), Index(), 0
    same: dict[int, int] = {}
    for i, at in enumerate(order):
        groups.join(i, same.setdefault(ids[at], i))
        found = list(leaders.search(own[i], least(i), lambda j, i=i: needed(i, j), lambda j, i=i: near(i, j) and groups.find(i) != groups.find(j)))
        for j in found:
            groups.join(i, j)
        if found:
            members += 1
        else:
            leaders.add(i, own[i])
    main = max(range(len(ids)), key=lambda i: (groups.size[groups.find(i)], -i))
    main = groups.find(main)
    outside = [i for i in range(len(ids)) if groups.find(i) != main]
    if outside and members:
        del leaders
        everyone = Index()
        for i, x in enumerate(own):
            everyone.add(i, x)
        for i in outside:
            for j in everyone.search(own[i], least(i), lambda j, i=i: needed(i, j), lambda j, i=i: near(i, j) and groups.find(i) != groups.find(j)):
                groups.join(i, j)
    smallest: dict[int, int] = {}
    for i, at in enumerate(order):
        r = groups.find(i)
        smallest[r] = min(smallest.get(r, ids[at]), ids[at])
    out = [0] * len(ids)
    for i, at in enumerate(order):
        out[at] = smallest[groups.find(i)]
    return out


class Part:
    """The documents of one part of a block, to be searched by documents of others."""

    def __init__(self, sizes: list[int], sets: list[np.ndarray], roots: list[int], percent: int) -> None:
        order = sorted(range(len(sizes)), key=lambda i: sizes[i])
        self.sizes, self.roots, self.percent = [sizes[i] for i in order], [roots[i] for i in order], percent
        self.index, self.found = Index(), set()
        for place, i in enumerate(order):
            self.index.add(place, sets[i].tolist())

    def ask(self, size: int, shingles: list[int], root: int) -> None:
        """Adds (root, the other's root) to found for each group that the document is linked with."""
        p = self.percent
        least = max(1, -(-p * (size + -(-p * size // 100)) // (100 + p)))
        for j in self.index.search(shingles, least, lambda j: -(-p * (size + self.sizes[j]) // (100 + p)), lambda j: 100 * min(size, self.sizes[j]) >= p * max(size, self.sizes[j]) and root != self.roots[j] and (root, self.roots[j]) not in self.found):
            self.found.add((root, self.roots[j]))


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Groups of rows that agree in their first n_keys columns, of sorted rows."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy() for i in range(n_keys)], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        for a, e in zip(starts, [*starts[1:], len(keys)], strict=True):
            key = tuple(keys[a].tolist())
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(b.slice(a, e - a))
    if held:
        yield now, held


def _numbers(held: list[pa.RecordBatch], name: str) -> list[int]:
    return [x for b in held for x in b.column(b.schema.names.index(name)).to_pylist()]


def _sets(held: list[pa.RecordBatch]) -> list[np.ndarray]:
    out = []
    for b in held:
        x = b.column(b.schema.names.index("s"))
        at, flat = x.offsets.to_numpy(), x.values.to_numpy()
        out += [flat[a:e] for a, e in zip(at[:-1], at[1:], strict=True)]
    return out


def _in_parts(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, roots = [], []
        for _, held in _grouped(batches, 2):
            own, sets = _numbers(held, "doc"), _sets(held)
            docs += own
            roots += link_block(own, _numbers(held, "n"), sets, percent)
            if sum(map(len, sets)) > BLOCK_SHINGLES // 8:
                give_back()
            if len(docs) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(roots, pa.int64())], names=["doc", "root"])
                docs, roots = [], []
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(roots, pa.int64())], names=["doc", "root"])

    return run


def _across(percent: int):  # noqa: ANN202
    """Of rows sorted by block, part and asks: a part's documents, then those of others that search them, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, None
        for now, held in _grouped(batches, 3):
            if now[2] == 0:
                key, part = now[:2], Part(_numbers(held, "n"), _sets(held), _numbers(held, "root"), percent)
                continue
            if now[:2] != key:
                continue
            for b in held:
                part.found = set()
                for n, s, root in zip(_numbers([b], "n"), _sets([b]), _numbers([b], "root"), strict=True):
                    part.ask(n, s.tolist(), root)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part.found], pa.int64()), pa.array([y for _, y in part.found], pa.int64())], names=["a", "b"])

    return run


def _groups(known: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """(doc, root) of (block, doc, n, s): groups of all links within blocks. A block of many shingles is cut into parts of four documents or more."""
    weigh = known.groupBy("block").agg(F.least(F.floor(F.sum(F.size("s")) / block_shingles) + 1, F.ceil(F.count("*") / 4)).alias("parts"))
    cut = materialize(weigh.where("parts > 1"), "cut-blocks")
    parted = known.join(cut, "block", "left").select("block", F.coalesce(F.pmod(F.xxhash64("doc"), "parts"), F.lit(0)).alias("part"), "doc", "n", "s")
    found = parted.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(_in_parts(percent), "doc long, root long")
    found = materialize(found.groupBy("doc").agg(F.min("root").alias("root")), "groups")
    if not cut.limit(1).count():
        discard(cut)
        return found
    big = materialize(parted.join(cut, "block").join(found, "doc").select("block", "part", "doc", "n", "s", "root", "parts"), "parts")
    # the leader of each part's largest group; the leaders of a block are a block
    top = big.groupBy("block", "part", "root").agg(F.count("*").alias("size")).groupBy("block", "part").agg(F.max_by("root", F.struct("size", -F.col("root"))).alias("top"), F.max("size").alias("size"))
    top = materialize(top, "tops")
    lead = big.join(top.select("block", "part", F.col("top").alias("doc")), ["block", "part", "doc"], "left_semi").select("block", "doc", "n", "s")
    hubs = _groups(lead, percent, block_shingles)
    hub = top.join(hubs, F.col("top") == F.col("doc")).select("block", "top", "size", F.col("root").alias("hub"))
    main = hub.groupBy("block", "hub").agg(F.sum("size").alias("w")).groupBy("block").agg(F.max_by("hub", F.struct("w", -F.col("hub"))).alias("hub"))
    inside = hub.join(main, ["block", "hub"], "left_semi").select("block", F.col("top").alias("root"))
    outside = big.join(inside, ["block", "root"], "left_anti")
    asks = outside.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("to"), "part", "doc", "n", "s", "root").where("to <> part")
    rows = big.select("block", "part", F.lit(0).alias("asks"), "doc", "n", "s", "root").union(asks.select("block", F.col("to").alias("part"), F.lit(1).alias("asks"), "doc", "n", "s", "root"))
    across = rows.repartition("block", "part").sortWithinPartitions("block", "part", "asks").mapInArrow(_across(percent), "a long, b long")
    links = materialize(across.union(hubs.select(F.col("doc").alias("a"), F.col("root").alias("b"))), "across")
    discard(big, top, cut)
    more = components(links).withColumnsRenamed({"root": "top", "node": "root"})
    discard(links)
    return found.join(more, "root", "left").select("doc", F.coalesce("top", "root").alias("root"))


def join_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id) of every document; a component is what links of `percent` similarity reach."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, min(RANGE_BITS, (size // RANGE_CHARS).bit_length()))
    id_type = dict(own.dtypes)["id"]
    schema = f"id {id_type}, n long, g long, chunk long, place int, part int, pack binary"
    table = materialize(own.mapInArrow(_measure(k, bits, own.limit(0).toArrow().schema.field(0).type), schema), "shingles")
    every, packed = table.where("part is null"), table.where("part is not null")

    dealt = packed.select("part", "chunk", "n", "pack").repartition("part").sortWithinPartitions("part")
    shared = dealt.mapInArrow(_shared, _PACKED).select("chunk", "part", "n", "pack", F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("g"))
    placed = every.where("place is not null").select("chunk", F.lit(-1).alias("part"), "n", F.lit(None).cast("binary").alias("pack"), "place", "g")
    got = materialize(shared.union(placed).repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(_candidates(percent), _CANDIDATES), "candidates")
    sized = materialize(every.select("id", "n", "g"), "sizes")
    discard(table)

    # blocks: what ties reach
    runs = got.where("key is not null").select("key", "lo", "hi", "g").repartition("key").sortWithinPartitions("key", "lo", "hi", "g")
    blocks = components(got.where("a is not null").select("a", "b").union(runs.mapInArrow(_ties(percent), "a long, b long")))
    sets = got.where("s is not null")
    member = blocks.select(F.col("node").alias("g"), F.col("root").alias("block")).join(sets.groupBy("g").agg(F.min("chunk").alias("chunk")), "g")
    known = materialize(sets.select("g", "chunk", "n", "s").join(member, ["g", "chunk"]).select("block", F.col("g").alias("doc"), "n", "s"), "block-sets")
    discard(got)
    found = _groups(known, percent, block_shingles)
    discard(known)

    # texts of one id are one document
    filled = sized.where("n > 0 and id is not null")
    repeated = filled.groupBy("id").agg(F.min("g").alias("a"), F.max("g").alias("z")).where("a <> z")
    ties = filled.join(repeated, "id").select("a", F.col("g").alias("b")).where("a <> b")
    if ties.limit(1).count():
        both = components(ties.union(found.select(F.col("doc").alias("a"), F.col("root").alias("b"))))
        found = both.withColumnRenamed("node", "doc")
    rooted = filled.groupBy("g").agg(F.min("id").alias("least")).join(found.withColumnRenamed("doc", "g"), "g", "left").withColumn("root", F.coalesce("root", "g"))
    least = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("g", "component")
    out = sized.withColumn("key", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("g"))).join(least.withColumnRenamed("g", "key"), "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
