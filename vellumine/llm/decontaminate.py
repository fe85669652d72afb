"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are lower-cased, and what isn't a letter or digit becomes one blank. A random walk (CGK)
embeds a window: each step copies the byte under a pointer, and a random bit of step and byte says
whether the pointer moves, so strings within a small edit distance meet again after an edit and
agree in most coordinates. Windows start at words, and in runs of ``RUN`` bytes or more without a
blank at every character. An item has windows at all of its starts, of the largest size class that
leaves it room for ``2 * STRIDE`` starts and for as many words of usual length: documents have such windows at every ``STRIDE``-th start,
so whichever way a passage lies, two windows start at the same place. Items too short for that
have windows of the least class, which documents then have at every start. Each repetition samples ``SAMPLED`` coordinates
as a key. Repetitions are as many as give the target recall of windows that agree in ``AGREE`` of
coordinates. A document window whose key an item window has, and whose whole embedding agrees in
``HAMMING`` of its coordinates, is verified: the least edit
distance of the whole item to any part of the text about it (Myers's bit vectors) must be at most 15 % of the
item's bytes.

Items that a document holds as they are need no luck: the first ``SHORTEST`` bytes of each are looked
up at every byte.

Documents are read whole, in one pass with no shuffle. Items never come to the driver: they are stored in the shared
folder in blocks of about ``BLOCK_BYTES``, and a task holds the index of one block at a time (kept
for the next task where there is one block only). Where there are more, a task gathers ``GATHER`` bytes of texts
and holds them against one block after another: time grows with blocks, memory doesn't, and no item is left out.

Edge cases: null and empty texts leak nothing; items without a letter or digit, and null items,
are in no document; items under ``SHORTEST`` bytes allow no edits and are found as whole words;
repeated items are reported each; an empty benchmark or table gives no leaks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellumine.llm.columns import pieces, tidied
from vellumine.llm.media import open_fs
from vellumine.session import scratch

STRIDE = 4
CLASSES = (16, 24, 32, 48)
SHORTEST = 24
#: Bytes of a run without blanks from which windows start at each of its characters.
RUN = 24
EDITS = 0.15
WALKS = 2
SAMPLED, AGREE, RECALL = 8, 0.72, 0.97
#: Share of all coordinates in which windows agree that are verified.
HAMMING = 0.6
GRAM = 4
#: Bytes of items in a block (their index takes some 60 times as much), and of texts that are held against block after block.
BLOCK_BYTES, GATHER = 2 << 20, 32 << 20
SEED = 20240607
#: Windows that are walked at once (their copies stay in a core's cache).
CHUNK = 16_384
#: Windows whose keys are held at once.
HELD = 8 * CHUNK

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if (48 <= i <= 57 or 97 <= i <= 122 or i >= 128) else 32 for i in range(256))


def repetitions(windows: int = 2) -> int:
    """Keys a walk so that an item of which so many windows start at a word that a document's do is met with RECALL."""
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLED) / windows / WALKS))


def normal(text: str | None) -> bytes:
    """Folded words, one blank between."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def distance_within(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and where that part ends."""
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    m, high = len(pattern), 1 << (len(pattern) - 1)
    every = (1 << m) - 1
    pv, mv, score, best, at = every, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & every)
        mh = pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & every, mh << 1 & every
        pv, mv = mh | (~(xv | ph) & every), ph & xv
        if score < best:
            best, at = score, j
    return best, at


def window_starts(data: np.ndarray) -> np.ndarray:
    """Where windows start: at words, and at each character of long runs; ``data`` ends in a blank or zero."""
    ends = np.flatnonzero((data == 32) | (data == 0))
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = ends - begins
    flags = np.zeros(len(data), bool)
    flags[begins[n > 0]] = True
    for lo, hi in zip(begins[n >= RUN], ends[n >= RUN], strict=True):
        flags[lo:hi] |= (data[lo:hi] & 0xC0) != 0x80
    return np.flatnonzero(flags)


_HEAD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def heads(data: np.ndarray) -> np.ndarray:
    """A hash of the SHORTEST (three times 8) bytes from each byte on."""
    v = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
    return v[:-16] * _HEAD[0] + v[8:-8] * _HEAD[1] + v[16:] * _HEAD[2]


class Plan:
    """The walks' random bits and the coordinates that keys sample: the same for all, from a seed."""

    def __init__(self, seed: int = SEED) -> None:
        random = np.random.default_rng(seed)
        self.steps = {c: c + c // 2 for c in CLASSES}
        most = max(self.steps.values())
        self.bits = random.integers(0, 2, (WALKS, most, 256)).astype(np.intp)
        n = repetitions()
        self.samples = {(w, c, r): np.sort(random.choice(self.steps[c], SAMPLED, replace=False)) for w in range(WALKS) for c in CLASSES for r in range(n)}
        # short items have one window at least, not two
        self.samples |= {(w, CLASSES[0], r): np.sort(random.choice(self.steps[CLASSES[0]], SAMPLED, replace=False)) for w in range(WALKS) for r in range(n, repetitions(1))}

    def walk(self, data: np.ndarray, starts: np.ndarray, w: int, steps: int) -> np.ndarray:
        """The embedding: bytes copied at each step (steps by windows)."""
        at = starts.astype(np.intp)
        copied = np.empty((steps, len(at)), np.uint8)
        move = np.empty(len(at), np.intp)
        for j in range(steps):
            np.take(data, at, out=copied[j], mode="clip")
            np.take(self.bits[w, j], copied[j], out=move, mode="clip")
            at += move
        return copied

    def keys(self, data: np.ndarray, starts: np.ndarray, classes: tuple[int, ...], n: int) -> dict[tuple[int, int, int], np.ndarray]:
        """64-bit keys by (walk, class, repetition under n) of the windows at ``starts``; data ends in enough padding."""
        out = {k: np.empty(len(starts), np.uint64) for k in self.samples if k[1] in classes and k[2] < n}
        most = max(self.steps[c] for c in classes)
        for lo in range(0, len(starts), CHUNK):
            for w in range(WALKS):
                copied = self.walk(data, starts[lo:lo + CHUNK], w, most)
                for (v, c, r), own in out.items():
                    if v == w:
                        own[lo:lo + CHUNK] = np.ascontiguousarray(copied[self.samples[v, c, r]].T).view(np.uint64)[:, 0]
        return out


def item_windows(text: bytes) -> tuple[int, int, list[int]]:
    """Stride of the document windows that an item is met by, their length, and where its own windows start.

    A document has the item's starts and no others, save in the first and last run, which it may
    continue: there the item has a window at each character.
    """
    data = np.frombuffer(text + b"\0", np.uint8)
    sure = window_starts(data)
    first, last = (text + b" ").index(b" "), text.rfind(b" ") + 1
    at = np.arange(len(text))
    starts = np.union1d(sure, at[((at < first) | (at >= last)) & ((data[:-1] & 0xC0) != 0x80)])
    sure = sure[sure > 0]
    roomy = [c for c in CLASSES[1:] if c <= len(text) - 2 * STRIDE * 6 and (sure + c <= len(text)).sum() >= 2 * STRIDE]
    stride, c = (STRIDE, max(roomy)) if roomy else (1, CLASSES[0])
    return stride, c, starts[starts + c <= len(text)].tolist()


class Index:
    """Windows of items by key."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.items = items
        self.plan = Plan()
        self.grams = [[text[i:i + GRAM] for i in range(len(text) - GRAM + 1)] for _, text in items]
        self.short: dict[bytes, list[int]] = defaultdict(list)
        windows: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        self.heads: dict[bytes, list[int]] = defaultdict(list)
        data, base = bytearray(), []
        for k, (_, text) in enumerate(items):
            base.append(len(data))
            if len(text) < SHORTEST:
                self.short[text].append(k)
            else:
                stride, c, starts = item_windows(text)
                windows[stride, c] += [(k, s) for s in starts]
                self.heads[text[:SHORTEST]].append(k)
            data += text + b"\0"
        data += bytes(2 * max(CLASSES))
        self.classes: dict[int, tuple[int, ...]] = {x: tuple(sorted(c for y, c in windows if y == x)) for x in sorted({x for x, _ in windows})}
        self.tables: dict = {}
        self.own: dict[tuple[int, int], np.ndarray] = {}
        self.copies: dict[tuple[int, int, int], np.ndarray] = {}
        whole = np.frombuffer(bytes(data), np.uint8)
        for (stride, c), own in windows.items():
            starts = np.array([base[k] + s for k, s in own])
            self.own[stride, c] = np.array(own)
            for w in range(WALKS):
                self.copies[stride, w, c] = self.plan.walk(whole, starts, w, self.plan.steps[c])
            for where, keys in self.plan.keys(whole, starts, (c,), self.repeated(stride)).items():
                order = np.argsort(keys, kind="stable")
                bits = np.zeros(1 << 18, bool)
                bits[self.bucket(keys)] = True
                self.tables[stride, *where] = (keys[order], order, bits)
        self.head_shift = np.uint64(64 - max(18, (8 * len(self.heads)).bit_length()))
        self.head_bits = np.zeros(1 << (64 - int(self.head_shift)), bool)
        for h in self.heads:
            self.head_bits[heads(np.frombuffer(h, np.uint8)) >> self.head_shift] = True

    @staticmethod
    def repeated(stride: int) -> int:
        return repetitions(1 if stride == 1 else 2)

    @staticmethod
    def bucket(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items found in it: item_id, edits, and the byte of the folded text where each ends."""
        folded = [normal(t) for t in texts]
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for k, text in enumerate(folded if self.short else ()):
            for s, own in self.short.items():
                if s and (i := (b" " + text + b" ").find(b" " + s + b" ")) >= 0:
                    found[k] |= dict.fromkeys(own, (0, i + len(s)))
        if self.classes:
            data = np.frombuffer(b"\0".join(folded) + bytes(2 * max(CLASSES)), np.uint8)
            base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in folded])])
            self.exact(found, folded, data, base)
            words = window_starts(data)
            first = np.searchsorted(words, base[:-1])
            number = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
            tried: set = set()
            for stride, classes in self.classes.items():
                starts = words[number % stride == 0]
                for lo in range(0, len(starts), HELD):
                    self.near(found, folded, data, base, starts[lo:lo + HELD], stride, classes, tried)
        return [[{"item_id": self.items[k][0], "edits": e, "ends_at": at} for k, (e, at) in sorted(f.items())] for f in found]

    def exact(self, found: list[dict], folded: list[bytes], data: np.ndarray, base: np.ndarray) -> None:
        """Adds the items that the texts hold without an edit, at whatever byte."""
        for lo in range(0, int(base[-1]), HELD):
            part = data[lo:lo + HELD + SHORTEST - 1]
            for i in (np.flatnonzero(self.head_bits[heads(part) >> self.head_shift]) + lo).tolist():
                own = self.heads.get(data[i:i + SHORTEST].tobytes())
                if own:
                    d = int(np.searchsorted(base, i, "right")) - 1
                    at = i - int(base[d])
                    for k in own:
                        if k not in found[d] and folded[d].startswith(self.items[k][1], at):
                            found[d][k] = (0, at + len(self.items[k][1]))

    def near(self, found: list[dict], folded: list[bytes], data: np.ndarray, base: np.ndarray, starts: np.ndarray, stride: int, classes: tuple[int, ...], tried: set) -> None:
        """Adds the items that windows at ``starts`` meet by a key and that are within reach."""
        met: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for (w, c, r), keys in self.plan.keys(data, starts, classes, self.repeated(stride)).items():
            table, order, bits = self.tables[stride, w, c, r]
            some = np.flatnonzero(bits[self.bucket(keys)])
            lo, hi = np.searchsorted(table, keys[some], "left"), np.searchsorted(table, keys[some], "right")
            n = hi - lo
            if n.sum():
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                met[w, c].append(np.column_stack([np.repeat(some, n), order[np.repeat(lo, n) + inner]]))
        for (w, c), pairs in met.items():
            both = np.unique(np.concatenate(pairs), axis=0)
            for part in np.array_split(both, -(-len(both) // CHUNK)):
                # windows that don't agree in the rest of their embeddings either are let go
                here = self.plan.walk(data, starts[part[:, 0]], w, self.plan.steps[c])
                near = (here == self.copies[stride, w, c][:, part[:, 1]]).mean(axis=0) >= HAMMING
                for i, k in part[near]:
                    item, s = map(int, self.own[stride, c][k])
                    at = int(starts[i])
                    d = int(np.searchsorted(base, at, "right")) - 1
                    begin = at - int(base[d]) - s
                    if (d, item, begin) not in tried:
                        tried.add((d, item, begin))
                        if found[d].get(item, (1,))[0]:  # nothing is nearer than an exact copy
                            self.verify(found[d], folded[d], item, begin)

    def verify(self, found: dict, text: bytes, k: int, begin: int) -> None:
        item = self.items[k][1]
        most = int(len(item) * EDITS)
        lo = max(0, begin - most)
        part = text[lo:max(0, begin) + len(item) + 2 * most]
        if item in part:
            edits, at = 0, part.index(item) + len(item)
        else:
            # an edit changes GRAM of an item's grams at most: with fewer left it can't be within reach
            held = {part[i:i + GRAM] for i in range(len(part) - GRAM + 1)}
            if sum(g in held for g in self.grams[k]) < len(self.grams[k]) - GRAM * most:
                return
            edits, at = distance_within(item, part)
        if edits <= most and (k not in found or edits < found[k][0]):
            found[k] = (edits, lo + at)


LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("ends_at", T.LongType())]))


def stored(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> tuple[str, int]:
    """Where items lie in the shared folder, and how many blocks there are: each is a folder of its number."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text"))
    whole = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-whole // most)
    where = scratch(benchmark.sparkSession, "items")
    if n:
        rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n))).write.partitionBy("block").parquet(where)
    return where, n


def items_of(where: str, block: int) -> list[tuple[int, bytes]]:
    """One block's items, folded, in order."""
    fs, base = open_fs(f"{where}/block={block}")
    files = [i.path for i in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if i.path.endswith(".parquet")]
    rows = [r for f in sorted(files) for r in pq.read_table(f, filesystem=fs, columns=["id", "text"], partitioning=None).to_pylist()]
    items = [(r["id"], normal(r["text"])) for r in rows]
    return sorted((i for i in items if i[1]), key=lambda i: (i[0] is None, i[0] or 0, i[1]))


@lru_cache(maxsize=1)
def index_of(where: str, block: int) -> Index:
    """A block's index; the worker that built it keeps it for its next task."""
    return Index(items_of(where, block))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, into: str = "leaks", most: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column (``leaks``): an array of (item_id, edits, ends_at); empty for clean documents."""
    where, blocks = stored(benchmark, most=most)
    columns = [c for c in (docs.columns if keep is None else keep) if c != into]
    narrow = docs.select(*dict.fromkeys([*columns, text]))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(into, LEAKS)])
    kind = to_arrow_schema(schema).field(into).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            texts = [p.column(text).to_pylist() for p in held]
            found: list[list[list]] = [[[] for _ in own] for own in texts]
            for b in range(blocks):
                index = index_of(where, b)
                for leaks, own in zip(found, texts, strict=True):
                    for k, more in enumerate(index.leaks(own)):
                        leaks[k] += more
            for p, leaks in zip(held, found, strict=True):
                yield pa.RecordBatch.from_arrays([*(p.column(c) for c in columns), pa.array(leaks, kind)], names=[*columns, into])
            held.clear()

        size = 0
        for batch in batches:
            for piece in pieces(batch, text):
                held.append(piece)
                size += piece.column(text).nbytes
                if blocks < 2 or size >= GATHER:
                    yield from close()
                    size = 0
        if held:
            yield from close()

    return narrow.mapInArrow(tidied(run), schema)


def op4(spark, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.edits", "leak.ends_at")
