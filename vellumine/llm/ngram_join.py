"""N-gram Jaccard join by vertical partitioning, and the components of its links.

The global order of n-grams is cut into fragments, overlaps are counted fragment by fragment, and
the counts are summed per document and per pair:

1. Texts become sets of hashed word n-grams. A share of the fragments is dealt out first; tasks
   combine what they hold, then each fragment says which n-grams only one set has. Summed over fragments,
   a set with more such n-grams than a link allows can link with nothing and is let go. This is exact,
   and on ordinary corpora it leaves few sets.
2. What is left is ordered by how many sets hold an n-gram. Two sets that link share one of the first
   n - ceil(t * n) + 1 n-grams of each in that order, so components over those are clusters
   that no link leaves.
3. Within a cluster the order (here that of the hashes) is cut into fragments, and sets into their segments.
   A task holds one fragment of a cluster and counts the partial overlaps of all its pairs; a pair whose
   partial overlap, and the most that the other fragments could add, fall short is let go. Partial counts are packed,
   a row of bytes for a fragment and a block of sets, and summed per pair in the task of that block, where
   the threshold decides. No set is copied, whatever a cluster's size; clusters that fit in one task have one
   fragment, and many of them share a task.

A fragment's n-grams that more than half of a cluster's sets hold are counted by the sets that miss them, so a
group of like sets costs little more than its pairs. What leaves step 3 is a row a set and block, never a
row a pair: the number of its links, and a set of its component.

Copies (equal sets) are one class throughout; a document's number of links is that of the other
documents whose sets reach the threshold with its own, so a class counts by its copies, and its own
copies but one count too. Every sum is over whole texts. Keys that hold a large part of the rows
(n-grams, nodes, classes, components) are joined apart, by broadcast.

Edge cases: a null or empty text, or one without words, has no n-grams and is alone in its
component, with no link; fewer words than n give one n-gram; a null doc_id can link but is never a component's
id unless nothing else is there; repeated rows are copies of each other; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.columns import pieces, tidied, tidied_group
from vellumine.llm.components import components
from vellumine.llm.skew import join_hot, small
from vellumine.session import cut, sweep

#: Bytes of text, or of n-grams, that a task combines; classes in a chunk (numbered in 16 bits; SEVERAL isn't one).
COMBINED = 16 << 20
#: Bytes of text that are cut into n-grams at once.
TEXTS = 1 << 20
SEVERAL = 65_535
#: N-grams in a fragment of a cluster, and in the clusters that share a task.
BLOCK = 2_000_000
#: Sets times n-grams that a task compares, above which a cluster has more fragments, up to SPREAD for that reason.
WORK, SPREAD = 50_000_000, 6
#: Pairs in a block of sets and the others; blocks of a cluster at most. Partners that are gathered at once.
PAIRS, BLOCKS, GATHERED = 8_000_000, 64, 2_000_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x9E3779B97F4A7C15 | 1
_PLACES = tuple(int(x) | 1 for x in mixed(np.arange(1001, 1065, dtype=np.uint64)))


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def gram_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word k-grams."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes: A-Z only
    data = np.frombuffer(b" ".join([*raw, b" "]), np.uint8)
    if not len(data):
        return []
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    before = np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(blank & ~before)
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    base = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    first = np.searchsorted(starts, base)
    grams = np.zeros(0, np.uint64)
    if len(words) >= k:
        grams = words[:len(words) - k + 1] * np.uint64(_PLACES[0])
        for j in range(1, k):
            grams = grams + words[j:len(words) - k + 1 + j] * np.uint64(_PLACES[j])
        grams = mixed(grams)
    out = []
    for d in range(len(texts)):
        lo, hi = first[d], first[d + 1]
        if hi - lo >= k:
            out.append(np.unique(grams[lo:hi - k + 1]))
        elif hi > lo:
            whole = sum(int(w) * _PLACES[j] for j, w in enumerate(words[lo:hi])) + 0x5851F42D4C957F2D * int(hi - lo)
            out.append(mixed(np.array([whole & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def key_of(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def most_missing(n, percent: int):
    """N-grams of a set of n that may be missing from a set it links with."""
    return n - -(-percent * n // 100)


def probed(percent: int) -> float:
    """Share of the hash range whose fragments are counted first: half as much again as a link may miss."""
    return min(1.0, 1.5 * (100 - percent) / 100 + 0.02)


def linked(shared, n, m, percent: int):
    return 100 * shared >= percent * (n + m - shared)


ROWS = "chunk long, fragment int, id long, row long, tag binary, n long, key binary, grams binary, owners binary"


def row_of():
    """By what a set's text is found again: rows that agree in it have equal texts (or are hashed alike, which costs a set)."""
    return F.xxhash64("id", "text")


def fragment_rows(docs: DataFrame, k: int, fragments: int, share: float) -> DataFrame:
    """For each document its n-grams' number and set key (fragment -1); for each chunk of a task its classes'
    sizes and keys (-2); and its fragments: distinct n-grams, with the class that has them in the chunk, or SEVERAL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        classes: dict[bytes, tuple[int, np.ndarray, int]] = {}
        state = {"bytes": 0}
        limit = np.uint64(int(share * (1 << 24)))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["chunk", "fragment", "id", "row", "tag", "n", "key", "grams", "owners"])
            rows.clear()
            return out

        def close() -> None:
            if not classes:
                return
            keys = list(classes)
            chunk = xxhash.xxh3_64_intdigest(b"".join(keys)) - (1 << 63)
            sizes = np.array([len(classes[c][1]) for c in keys], np.int32)
            ids = np.array([classes[c][0] for c in keys], np.int64)
            rows.append((chunk, -2, None, None, None, None, b"".join(keys), sizes.tobytes(), ids.tobytes()))
            some = [g[: np.searchsorted(g, limit << np.uint64(40))] for _, g, _ in classes.values()]
            owners = np.repeat(np.arange(len(keys), dtype=np.int32), [len(s) for s in some])
            grams = np.concatenate(some)
            order = np.argsort(grams, kind="stable")
            grams, owners = grams[order], owners[order]
            new = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(grams)))
            grams, owners = grams[at], np.where(count == 1, owners[at], SEVERAL).astype(np.uint16)
            fragment = ((grams >> np.uint64(40)) * np.uint64(fragments) // limit).astype(np.int64)
            for f in np.unique(fragment):
                lo, hi = np.searchsorted(fragment, [f, f + 1])
                rows.append((chunk, int(f), None, None, None, None, None, grams[lo:hi].astype(np.uint32).tobytes(), owners[lo:hi].tobytes()))
            classes.clear()
            state["bytes"] = 0

        for b in batches:
            for piece in pieces(b, "text", TEXTS):
                texts = piece.column("text").to_pylist()
                for own, row, tag, grams, text in zip(piece.column("id").to_pylist(), piece.column("row").to_pylist(), piece.column("tag").to_pylist(), gram_sets(texts, k), texts, strict=True):
                    key = key_of(grams)
                    if len(classes) >= SEVERAL:
                        close()
                    rows.append((0, -1, own, row, tag, len(grams), key, None, None))
                    if key is not None and key not in classes:
                        classes[key] = (row, grams, len(grams))
                    state["bytes"] += len(text or "")
                if state["bytes"] >= COMBINED:
                    close()
                if len(rows) >= 2000:
                    yield batch()
        close()
        powers.cache_clear()
        yield batch()

    return docs.select("id", row_of().alias("row"), "tag", "text").mapInArrow(tidied(run), ROWS)


def lone_grams(rows: DataFrame) -> DataFrame:
    """For each chunk the classes (repeated) of n-grams that no other class of any chunk has, by fragment."""

    def count(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        grams = [np.frombuffer(g, np.uint32) for g in table.column("grams").to_pylist()]
        owners = [np.frombuffer(g, np.uint16) for g in table.column("owners").to_pylist()]
        sizes = np.array([len(g) for g in grams])
        whole = np.concatenate(grams)
        order = np.argsort(whole, kind="stable")
        ordered = whole[order]
        lone = np.ones(len(ordered), bool)
        same = ordered[1:] == ordered[:-1]
        lone[1:] &= ~same
        lone[:-1] &= ~same
        flags = np.zeros(len(whole), bool)
        flags[order[lone]] = True
        ends = np.cumsum(sizes)
        out = []
        for c, own, e, n in zip(chunks, owners, ends, sizes, strict=True):
            mine = own[flags[e - n:e]]
            out.append((c, mine[mine < SEVERAL].tobytes()))
        return pa.table({"chunk": pa.array([o[0] for o in out], pa.int64()), "owners": pa.array([o[1] for o in out], pa.binary())})

    return rows.where("fragment >= 0").select("fragment", "chunk", "grams", "owners").groupBy("fragment").applyInArrow(tidied_group(count), "chunk long, owners binary")


def survivors(rows: DataFrame, percent: int) -> DataFrame:
    """(key, row): classes whose lone n-grams, summed over the fragments counted, still allow a link; one row of each."""

    def pick(table: pa.Table) -> pa.Table:
        keys, sizes, ids, lone = b"", None, None, None
        for key, grams, owners in zip(*(table.column(c).to_pylist() for c in ("key", "grams", "owners")), strict=True):
            if key is not None:
                keys, sizes, ids = key, np.frombuffer(grams, np.int32).astype(np.int64), np.frombuffer(owners, np.int64)
        if sizes is None:
            return pa.table({"key": pa.array([], pa.binary()), "row": pa.array([], pa.int64())})
        lone = np.zeros(len(sizes), np.int64)
        for key, owners in zip(table.column("key").to_pylist(), table.column("owners").to_pylist(), strict=True):
            if key is None:
                lone += np.bincount(np.frombuffer(owners, np.uint16), minlength=len(sizes))
        kept = np.flatnonzero(lone <= most_missing(sizes, percent))
        return pa.table({"key": pa.array([keys[16 * i:16 * i + 16] for i in kept], pa.binary()), "row": pa.array(ids[kept], pa.int64())})

    heads = rows.where("fragment = -2").select("chunk", "key", "grams", "owners").distinct()
    lone = lone_grams(rows).select("chunk", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("grams"), "owners")
    return heads.unionByName(lone).groupBy("chunk").applyInArrow(tidied_group(pick), "key binary, row long").groupBy("key").agg(F.min("row").alias("row"))


def sets_of(docs: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """(key, n, grams), cut, of the classes kept, once each: their texts are joined back and cut again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for piece in pieces(b, "text", TEXTS):
                sets = [(key_of(s), s) for s in gram_sets(piece.column("text").to_pylist(), k) if len(s)]
                new = [(key, s) for key, s in dict(sets).items() if key not in seen]
                seen.update(key for key, _ in new)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in new], pa.binary()), pa.array([len(x[1]) for x in new], pa.int64()), pa.array([x[1].tobytes() for x in new], pa.binary())], names=["key", "n", "grams"])
        powers.cache_clear()

    texts = docs.select(row_of().alias("row"), "text").join(small(kept.select("row")), "row", "left_semi")
    sets = cut(texts.select("text").mapInArrow(tidied(run), "key binary, n long, grams binary"))
    # rows that repeat id and text in several tasks give a set again
    n = sets.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys")).first()
    return sets if n["n"] == n["keys"] else cut(sets.dropDuplicates(["key"]))


def prefix_postings(sets: DataFrame, percent: int, fragments: int) -> DataFrame:
    """(gram, key): for each set that can still link, its first n-grams in the global order (sets that hold one, hash).

    Tasks count what they hold, fragments add the counts up, and chunks of sets get the sums back.
    """
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["chunk", "fragment", "first", "key", "grams", "counts"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []

        def chunk() -> pa.RecordBatch:
            keys = b"".join(k for k, _ in held)
            whole = np.frombuffer(b"".join(g for _, g in held), np.uint64)
            number = xxhash.xxh3_64_intdigest(keys) - (1 << 63)
            rows = [(number, -2, 0, keys, whole.tobytes(), np.array([len(g) // 8 for _, g in held], np.int32).tobytes())]
            grams, counts = np.unique(whole, return_counts=True)
            fragment = ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            for f in np.unique(fragment):
                lo, hi = np.searchsorted(fragment, [f, f + 1])
                rows.append((number, int(f), int(lo), None, grams[lo:hi].tobytes(), counts[lo:hi].astype(np.int32).tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        size = 0
        for b in batches:
            for key, grams in zip(b.column("key").to_pylist(), b.column("grams").to_pylist(), strict=True):
                held.append((key, grams))
                size += len(grams)
                if size >= COMBINED:
                    yield chunk()
                    size = 0
        if held:
            yield chunk()

    def count(table: pa.Table) -> pa.Table:
        grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.int32) for c in table.column("counts").to_pylist()])
        _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.minimum(np.bincount(inverse, weights=counts), (1 << 31) - 1).astype(np.int32)[inverse]
        ends = np.cumsum([len(g) for g in grams])
        return pa.table({"chunk": table.column("chunk"), "first": table.column("first"), "counts": pa.array([sums[e - len(g):e].tobytes() for g, e in zip(grams, ends, strict=True)], pa.binary())})

    def prefix(table: pa.Table) -> pa.Table:
        head = next(i for i, k in enumerate(table.column("key").to_pylist()) if k is not None)
        keys = table.column("key")[head].as_py()
        sizes = np.frombuffer(table.column("counts")[head].as_py(), np.int32).astype(np.int64)
        whole = np.frombuffer(table.column("grams")[head].as_py(), np.uint64)
        _, inverse = np.unique(whole, return_inverse=True)
        sums = np.zeros(int(inverse.max()) + 1, np.int32)
        for key, first, counts in zip(*(table.column(c).to_pylist() for c in ("key", "first", "counts")), strict=True):
            if key is None:
                sums[first:first + len(counts) // 4] = np.frombuffer(counts, np.int32)
        held = sums[inverse]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        use = held > 1
        many = np.bincount(owner[use], minlength=len(sizes))
        left = most_missing(sizes, percent) + 1 - (sizes - many)  # n-grams that no other set has come first
        order = np.lexsort((whole[use], held[use], owner[use]))
        who = owner[use][order]
        rank = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        first = rank < left[who]
        return pa.table({"gram": pa.array(whole[use][order][first].view(np.int64), pa.int64()), "key": pa.array([keys[16 * i:16 * i + 16] for i in who[first]], pa.binary())})

    parts = cut(sets.select("key", "grams").mapInArrow(tidied(cut_up), "chunk long, fragment int, first long, key binary, grams binary, counts binary"))
    counted = parts.where("fragment >= 0").select("fragment", "chunk", "first", "grams", "counts").groupBy("fragment").applyInArrow(tidied_group(count), "chunk long, first long, counts binary")
    none = F.lit(None).cast("binary")
    heads = parts.where("fragment = -2").select("chunk", "first", "key", "grams", "counts")
    return heads.unionByName(counted.select("chunk", "first", none.alias("key"), none.alias("grams"), "counts")).groupBy("chunk").applyInArrow(tidied_group(prefix), "gram long, key binary")


class Lists:
    """Of numbered things the sets that hold (or miss) them: partners of a set, counted."""

    def __init__(self, things: np.ndarray, owners: np.ndarray, m: int) -> None:
        """Pairs of thing and set, by set in ascending order."""
        self.m, self.things = m, things
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=m))])
        order = np.argsort(things, kind="stable")
        self.lists = owners[order]
        self.ends = np.cumsum(np.bincount(things)) if len(things) else np.zeros(0, np.int64)
        self.place = np.empty(len(things), np.int64)
        self.place[order] = np.arange(len(things))

    def after(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets behind ``i`` that share things with it, and how many."""
        at = slice(self.bounds[i], self.bounds[i + 1])
        lo = self.place[at] + 1
        n = self.ends[self.things[at]] - lo
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if total <= min(GATHERED, self.m // 8):
            return np.unique(self.lists[np.repeat(lo - upto + n, n) + np.arange(total)], return_counts=True)
        counts = np.zeros(self.m, np.int64)
        cuts = np.append(np.unique(np.searchsorted(upto, np.arange(0, total, GATHERED), "left")), len(n))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = n[a:b]
            some = int(own.sum())
            counts += np.bincount(self.lists[np.repeat(lo[a:b] - np.cumsum(own) + own, own) + np.arange(some)], minlength=self.m)
        met = np.flatnonzero(counts)
        return met, counts[met]


def needed(n, m, percent: int):
    """Overlap from which sets of n and m n-grams link."""
    return -(-percent * (n + m) // (100 + percent))


class Fragment:
    """One fragment's segments of a cluster's sets, whose whole sizes are known."""

    def __init__(self, segments: list[np.ndarray], sizes: np.ndarray, percent: int) -> None:
        m = len(segments)
        lengths = np.array([len(s) for s in segments], np.int64)
        self.sizes, self.rest, self.percent, self.m = sizes, sizes - lengths, percent, m
        _, number, held = np.unique(np.concatenate(segments), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), lengths)
        common = held * 2 > m if m > 16 else np.zeros(len(held), bool)
        use = (held[number] > 1) & ~common[number]
        self.shared = Lists(number[use], owner[use], m)
        # n-grams of more than half of the sets: at most twice as many cells as n-grams
        self.commons = int(common.sum())
        if self.commons:
            lacks = np.ones((m, self.commons), bool)
            use = common[number]
            lacks[owner[use], (np.cumsum(common) - 1)[number[use]]] = False
            self.common_held = self.commons - lacks.sum(axis=1)
            who, what = np.nonzero(lacks)
            self.missed = Lists(what, who, m)

    def after(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets behind ``i`` that may link with it, as far as this fragment tells, and their partial overlaps (not 0)."""
        who, counts = self.shared.after(i)
        if self.commons:
            # of c common n-grams, sets that hold a and b of them and both miss x share a + b - c + x
            whole = self.common_held + (self.common_held[i] - self.commons)
            lacking, x = self.missed.after(i)
            whole[lacking] += x
            whole[who] += counts
            whole[:i + 1] = 0
            who = np.flatnonzero(whole)
            counts = whole[who]
        n, m = self.sizes[i], self.sizes[who]
        fits = (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (counts + np.minimum(self.rest[i], self.rest[who]) >= needed(n, m, self.percent))
        return who[fits], counts[fits]


class Links:
    """What a set's links add up to, and a spanning label, over some of a cluster's pairs."""

    def __init__(self, sizes: np.ndarray, copies: np.ndarray, percent: int) -> None:
        self.sizes, self.copies, self.percent = sizes, copies, percent
        self.links, self.label = np.zeros(len(sizes), np.int64), np.arange(len(sizes))

    def add(self, i: int, who: np.ndarray, overlap: np.ndarray) -> None:
        near = who[linked(overlap, self.sizes[i], self.sizes[who], self.percent)]
        if not len(near):
            return
        self.links[i] += self.copies[near].sum()
        self.links[near] += self.copies[i]
        if (self.label[near] != self.label[i]).any():
            joined = np.union1d(self.label[near], self.label[i])
            self.label[np.isin(self.label, joined)] = joined[0]

    def rows(self, keys: list[bytes]) -> list[tuple[bytes, bytes, int]]:
        """(a set, one of its component, documents it links with) of the sets that link."""
        return [(keys[i], keys[self.label[i]], int(self.links[i])) for i in np.flatnonzero(self.links)]


def packed(counts: list[tuple[np.ndarray, np.ndarray]], firsts: list[int], m: int) -> bytes:
    """Partial counts of sets with those behind each: for each set a dense row of counts or pairs of place and count."""
    parts = []
    for i, (who, n) in zip(firsts, counts, strict=True):
        most = int(n.max()) if len(n) else 0
        kind = np.dtype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)
        dense = len(who) * (4 + kind.itemsize) > (m - i - 1) * kind.itemsize
        parts.append(np.array([kind.itemsize, dense, len(who)], np.uint32).tobytes())
        if dense:
            row = np.zeros(m - i - 1, kind)
            row[who - i - 1] = n
            parts.append(row.tobytes())
        else:
            parts += [who.astype(np.uint32).tobytes(), n.astype(kind).tobytes()]
    return zlib.compress(b"".join(parts), 1)


def unpacked(data: bytes, firsts: list[int], m: int) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
    """For each set the places and counts that ``packed`` was given."""
    raw, at = zlib.decompress(data), 0
    for i in firsts:
        size, dense, n = (int(x) for x in np.frombuffer(raw, np.uint32, 3, at))
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[size]
        at += 12
        if dense:
            yield slice(i + 1, m), np.frombuffer(raw, kind, m - i - 1, at)
            at += size * (m - i - 1)
        else:
            yield np.frombuffer(raw, np.uint32, n, at), np.frombuffer(raw, kind, n, at + 4 * n)
            at += (4 + size) * n


def block_count(m: int) -> int:
    return min(BLOCKS, max(1, -(-m * m // (2 * PAIRS))))


FOUND = "a binary, b binary, links long"


def found_table(rows: list[tuple[bytes, bytes, int]]) -> pa.Table:
    return pa.table({"a": pa.array([r[0] for r in rows], pa.binary()), "b": pa.array([r[1] for r in rows], pa.binary()), "links": pa.array([r[2] for r in rows], pa.int64())})


def whole_clusters(placed: DataFrame, percent: int, bins: int) -> DataFrame:
    """(a, b, links) of clusters that have one fragment; ``bins`` tasks share them."""

    def solve(table: pa.Table) -> pa.Table:
        clusters, keys, grams, copies = (table.column(c).to_pylist() for c in ("cluster", "key", "grams", "copies"))
        order = sorted(range(len(keys)), key=lambda i: (clusters[i], keys[i]))
        rows, at = [], 0
        while at < len(order):
            end = at
            while end < len(order) and clusters[order[end]] == clusters[order[at]]:
                end += 1
            own = order[at:end]
            at = end
            sets = [np.frombuffer(grams[i], np.uint64) for i in own]
            sizes = np.array([len(x) for x in sets], np.int64)
            fragment, links = Fragment(sets, sizes, percent), Links(sizes, np.array([copies[i] for i in own], np.int64), percent)
            for i in range(len(own) - 1):
                links.add(i, *fragment.after(i))
            rows += links.rows([keys[i] for i in own])
        return found_table(rows)

    return placed.withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins))).groupBy("bin").applyInArrow(tidied_group(solve), FOUND)


PARTIAL = "cluster binary, block int, fragment int, counts binary, keys binary, sizes binary, copies binary"


def cut_clusters(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b, links) of clusters of several fragments (column ``fragments``): partial overlaps a fragment, summed per pair."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fragments, grams = b.column("fragments").to_pylist(), b.column("grams").to_pylist()
            at, number, own = [], [], []
            for k, (n, g) in enumerate(zip(fragments, grams, strict=True)):
                x = np.frombuffer(g, np.uint64)
                cuts = [0, *np.searchsorted(x, np.array([(j << 64) // n for j in range(1, n)], np.uint64)).tolist(), len(x)]
                at += [k] * n
                number += range(n)
                own += [x[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("cluster").take(take), pa.array(number, pa.int32()), b.column("key").take(take), b.column("n").take(take), b.column("copies").take(take), pa.array(own, pa.binary())], names=["cluster", "fragment", "key", "n", "copies", "grams"])

    def count(table: pa.Table) -> pa.Table:
        cluster, number = table.column("cluster")[0].as_py(), table.column("fragment")[0].as_py()
        table = table.sort_by("key")
        sizes = table.column("n").to_numpy().astype(np.int64)
        fragment = Fragment([np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()], sizes, percent)
        m, blocks = len(sizes), block_count(len(sizes))
        rows: list = []
        for b in range(blocks):
            firsts = list(range(b, m, blocks))
            rows.append((cluster, b, number, packed([fragment.after(i) for i in firsts], firsts, m), None, None, None))
            if number == 0:
                rows.append((cluster, b, -1, None, b"".join(table.column("key").to_pylist()), sizes.tobytes(), table.column("copies").to_numpy().astype(np.int64).tobytes()))
        kinds = [pa.binary(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        names = ["cluster", "block", "fragment", "counts", "keys", "sizes", "copies"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def total(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["fragment"])
        head, rest = rows[0], rows[1:]
        sizes, copies = np.frombuffer(head["sizes"], np.int64), np.frombuffer(head["copies"], np.int64)
        m = len(sizes)
        firsts = list(range(head["block"], m, block_count(m)))
        links = Links(sizes, copies, percent)
        for i, *parts in zip(firsts, *[unpacked(r["counts"], firsts, m) for r in rest], strict=True):
            overlap = np.zeros(m, np.int64)
            for where, n in parts:
                overlap[where] += n
            who = np.flatnonzero(overlap)
            links.add(i, who, overlap[who])
        return found_table(links.rows([head["keys"][16 * i:16 * i + 16] for i in range(m)]))

    parts = placed.select("cluster", "key", "n", "copies", "grams", "fragments").mapInArrow(tidied(segments), "cluster binary, fragment int, key binary, n long, copies long, grams binary")
    counted = parts.groupBy("cluster", "fragment").applyInArrow(tidied_group(count), PARTIAL)
    return counted.groupBy("cluster", "block").applyInArrow(tidied_group(total), FOUND)


def links_of(sets: DataFrame, clusters: DataFrame, copies: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b, links): for each set and block that gives it links one set of its component and the documents it links with."""
    spark = sets.sparkSession
    placed = cut(sets.join(clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster")), "key").join(copies.select("key", "copies"), "key"))
    work = F.least(F.sqrt(F.count(F.lit(1)) * F.sum("n") / F.lit(WORK)), F.lit(float(SPREAD)))
    sizes = cut(placed.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / F.lit(block), work)).cast("int").alias("fragments"), F.sum("n").alias("n")))
    # one row a cluster of over a block of n-grams, or of much work: few beside the sets
    large = sizes.where("fragments > 1").select("cluster", "fragments")
    some = large.count()
    whole = sizes.where("fragments = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bins = max(2 * spark.sparkContext.defaultParallelism, 4 * whole // block)
    if not some:
        return whole_clusters(placed, percent, bins)
    held = small(large)
    return whole_clusters(placed.join(held, "cluster", "left_anti"), percent, bins).unionByName(cut_clusters(placed.join(held, "cluster"), percent))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, tag: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_grams, component (its class's least doc_id), n_links (other documents that it links
    with), key (of its class, null without n-grams), root (a class of its component), and a binary column ``tag`` of the input."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), (F.col(tag) if tag else F.lit(None)).cast("binary").alias("tag"))
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * narrow.rdd.getNumPartitions())
    rows = cut(fragment_rows(narrow, k, fragments, probed(percent)))
    sets = sets_of(narrow, cut(survivors(rows, percent)), k)
    postings = cut(prefix_postings(sets, percent, fragments))
    sweep(spark)
    least = postings.groupBy("gram").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    clusters = components(join_hot(postings, least, "gram", "n").select(F.col("key").alias("a"), "b"))
    own = rows.where("fragment = -1").select("id", "tag", "n", "key")
    classes = cut(own.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    pairs = cut(links_of(sets, clusters, classes, percent))
    sweep(spark)
    found = components(pairs.select("a", "b"))
    links = pairs.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    rooted = cut(classes.join(found.select(F.col("node").alias("key"), "root"), "key", "left").join(links, "key", "left").select("key", "least", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    named = join_hot(rooted, rooted.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members")), "root", "members")
    out = join_hot(own, named.select("key", "root", "component", "copies", "links"), "key", "copies", "left")
    columns = [F.col("id").alias("doc_id"), F.col("n").alias("n_grams"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"), F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"), "key", "root"]
    return out.select(*columns, *([F.col("tag").alias(tag)] if tag else []))


def op3(spark, sf_dir: str) -> DataFrame:
    """Links of documents whose sets of word 4-grams have a Jaccard similarity of at least 0.85: their components, and how many each has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return join(docs, k=4, percent=85).select("doc_id", F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


def sql(table: str = "documents", k: int = 4, percent: int = 85) -> str:
    """DuckDB SQL for op3: every pair that shares an n-gram is counted, and links are followed."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM {table}
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) END AS grams FROM words
), sizes AS (
  SELECT doc_id, len(grams)::BIGINT AS n FROM sets
), grams AS MATERIALIZED (
  SELECT doc_id, unnest(grams) AS g FROM sets
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= {percent} * (s.n + t.n - c)
), reached AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, any_value(s.n) AS n_shingles, min(r.other) AS component_id, any_value(coalesce(m.n, 0))::BIGINT AS n_links
FROM sizes s JOIN reached r ON r.doc_id = s.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) m ON m.a = s.doc_id GROUP BY s.doc_id
"""
