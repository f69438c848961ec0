"""N-gram Jaccard join: every pair of documents whose sets of word n-grams have Jaccard
similarity of at least `threshold`, found exactly by metric partitioning.

Jaccard distance 1 - J is a metric. The join is a recursion over pivots:

* Level 0. The pivots are single n-grams: the distance of a document x to pivot {g} is
  1 - 1/|x| if x holds g and 1 if not, so x lies in the Voronoi regions of its own n-grams, and a
  total order of the n-grams breaks the ties. A partner within eps = 1 - threshold shares at least
  c = ceil(threshold * |x|) n-grams with x, so the first m n-grams that both share are among the
  |x| - c + m first ones of x: this is the window of regions to which x is replicated (m is 1 plus a
  share of |x|). Documents as pivots would do nothing here: nearly all pairs of documents in a
  corpus are at distance 1 exactly, so every window would hold every region.
* The order is by expected document frequency (from counts of words and repeated n-grams over all
  documents), rarest first. Any order gives the same pairs; this one leaves regions small.
* Level 1. A document keeps the regions in which another one of a compatible size lies. A partner
  shares at least m' of them with it (m of the smallest possible partner). Regions of few documents
  name these by prints, so that whoever is met less than m' times, all larger regions of the document
  added, is no partner, and regions without a possible partner go. If s are left, the first common
  one is among the s - m' + 1 first in any order: now by the number of documents that really are in
  a region, fewest first. Documents with fewer than m' have no partner.
* Documents that are alike share most of their regions. They meet once: a sketch of a document's
  shared n-grams (its smallest prints) makes regions of its own (kind 1), a pair meets in the region
  of its smallest common print, and only pairs without common prints meet in a region of level 1
  (kind 0).
* Before whole sets are sent to a region, bitmaps of them are, two bits or so for an n-gram: as many
  bits differ at most as n-grams do, so documents whose bitmaps differ more than a pair at the
  threshold can are no pair. Only documents with somebody left in a region send their set to it.
* Level 2 and deeper. Inside a region documents are pivots: each document goes to the Voronoi
  cell of its nearest pivot and, for every other pivot p, to the window d(x, p) <= d(x, home) +
  2 eps; cells are split again until small or no longer shrinking, then compared in full.
* A region of many documents is cut into blocks, and a task compares two blocks.

Documents are known by their sets (64 bits of a hash), so copies are one from the first shuffle on
and what a task sends for a large group of copies doesn't grow with it. Shuffled entries are packed
in byte planes of differences.

Defined results: words are runs of characters above U+0020 of the lower-cased text. A text of 1 to
n-1 words has one n-gram, of all its words. doc_id must be a whole number (or castable to long; else
it is null). Rows with a null doc_id take no part. Texts that are null or without words are linked to
nothing. Repeated rows (same doc_id and same set) count once; a doc_id with several different texts
has a set, and a row of its result, for each. Other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ensure_checkpoint_dir, mix, process_cache, segments, shuffle_partitions, shuffles_freed, slices, word_hashes

THRESHOLD = 0.6
NGRAM = 2
#: Windows are longer by this share of a document's size, and a document needs that many n-grams
#: shared with others, not only one, to be looked at any further.
EVIDENCE = 0.12
#: Prints in a document's sketch.
SKETCH = 8
#: Entries of a region up to which it is tested together with others of its size.
FEW = 64
#: Bounds of what steers the order of n-grams, never the result.
MAX_WORDS = 200_000
MAX_REPEATED = 500_000
#: Documents of a region up to which they are named to each other.
NAMED = 16
#: Documents of an n-gram from which its region is taken as shared without being brought together.
HOT = 200_000
#: Bytes up to which a side is broadcast; beyond, the same join is done by shuffle.
MAX_BROADCAST_BYTES = 8_000_000
#: Ids up to which the documents that go are broadcast.
MAX_BROADCAST_ROWS = 500_000
#: Documents, and n-grams, of a block of a region when sets are sent, and when bitmaps are: a document is
#: sent once for each block of its region, so blocks are as large as a task can hold.
BLOCK, BLOCK_GRAMS = 4096, 3_000_000
MAP_BLOCK, MAP_BLOCK_GRAMS = 16_384, 16_000_000
#: Documents, and n-grams, that are compared at once inside a task.
TILE, TILE_GRAMS = 2048, 1_500_000
#: Entries of level 0 that a task gets.
TASK_ENTRIES = 1_500_000
#: Cells of a dense matrix.
CELLS = 4_000_000
LOW58 = np.uint64((1 << 58) - 1)


def prefix_length(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """N-grams of each window: a partner shares with it the first 1 + EVIDENCE * size common ones."""
    common = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
    return sizes - common + np.minimum(least_shared(sizes), common)


def least_shared(sizes: np.ndarray) -> np.ndarray:
    return 1 + np.floor(EVIDENCE * sizes).astype(np.int64)


class _Order:
    """Slot tables of the classes of words and of the repeated n-grams, for one-step look-ups.

    Of several entries of a slot the most frequent one stays: the others count as rare, in all
    documents alike.
    """

    BITS = 21

    def __init__(self, words, weights, repeated, hot):
        shift = np.uint64(64 - self.BITS)
        self.shift = shift
        self.word = np.zeros(1 << self.BITS, np.uint64)
        self.weight = np.zeros(1 << self.BITS, np.int8)
        by = np.argsort(weights, kind="stable")
        self.word[words[by] >> shift] = words[by]
        self.weight[words[by] >> shift] = weights[by]
        self.repeated = np.zeros(1 << self.BITS, np.uint64)
        self.repeated[self.slot(repeated)] = repeated
        self.hot = np.sort(hot)

    def slot(self, key):
        return (key << np.uint64(6)) >> self.shift

    def weights(self, h):
        s = h >> self.shift
        return np.where(self.word[s] == h, self.weight[s], 0)

    def is_hot(self, gram):
        if not len(self.hot):
            return np.zeros(len(gram), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, gram), len(self.hot) - 1)] == gram


def _tables(order):
    version, *arrays = order.value
    return process_cache("jaccard-order", lambda: _Order(*arrays), version)


def _ngrams(batch, n, order=None):
    """Distinct n-gram keys of each row, in the order of the join, and where rows begin.

    A key holds the class of the n-gram (6 bits: log2 of its expected frequency, 63 for repeated
    ones) above 58 bits of its hash.
    """
    h, starts = word_hashes(batch.column("text"))
    counts = np.diff(starts)
    size = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(size)))
    if not len(h):
        return np.zeros(0, np.uint64), begin
    at = segments(starts[:-1], size)
    weight = order.weights(h) if order else None
    short = np.flatnonzero((counts > 0) & (counts < n))
    key = np.zeros(len(at), np.uint64)
    cls = np.zeros(len(at), np.int16)
    for k in range(n):
        p = np.minimum(at + k, len(h) - 1)
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h[p] + np.uint64(k + 1))
        if order:
            cls += weight[p]
    for i in short:
        x, c = np.zeros(1, np.uint64), 0
        for k in range(counts[i]):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[starts[i] + k : starts[i] + k + 1] + np.uint64(k + 1))
            c += int(weight[starts[i] + k]) if order else 0
        key[begin[i]], cls[begin[i]] = x[0], c
    key >>= np.uint64(6)
    if order:
        cls = np.minimum(cls, 62)
        cls[order.repeated[order.slot(key)] == key] = 63
        key |= cls.astype(np.uint64) << np.uint64(58)
    for i in range(len(size)):
        key[begin[i] : begin[i + 1]].sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    keep[begin[:-1][size > 0]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return key[keep], total[begin]


def set_ids(key: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row's set, whatever the order of its n-grams."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(key & LOW58))))
    return mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64)).view(np.int64)


def _clean(batch):
    return batch.filter(pc.and_(batch.column("doc_id").is_valid(), batch.column("text").is_valid()))


FOUND = "kind int, h long, c long"
WORD, GRAM, DOCUMENT, ENTRIES = range(4)


def _statistics(n, threshold):
    def run(batches):
        """Words and n-grams that recur within this task, with their counts; the set of each document."""
        hs, ks, held, entries = [], [], 0, 0

        def row(kind, h, c):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), h if isinstance(h, pa.Array) else pa.array(h), pa.array(c)], ["kind", "h", "c"])

        def out():
            for kind, parts, least in ((WORD, hs, 8), (GRAM, ks, 4)):
                if parts:
                    v, c = np.unique(np.concatenate(parts), return_counts=True)
                    v, c = v[c >= least], c[c >= least]
                    yield row(kind, v.view(np.int64), c.astype(np.int64))

        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            batch = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text").fill_null("")], ["doc_id", "text"])
            for part in slices(batch):
                key, starts = _ngrams(part, n)
                sizes, ids = np.diff(starts), set_ids(key, starts)
                yield row(DOCUMENT, pa.array(ids, mask=sizes == 0), np.asarray(part.column("doc_id").cast(pa.int64())))
                entries += int(prefix_length(sizes, threshold).sum())
                # equal documents of a slice count once
                rows = np.unique(ids, return_index=True)[1]
                ks.append(key[segments(starts[rows], sizes[rows])])
                hs.append(word_hashes(part.column("text"))[0])
                held += len(hs[-1])
                if held > 2_000_000:
                    yield from out()
                    hs, ks, held = [], [], 0
        yield from out()
        yield row(ENTRIES, np.zeros(1, np.int64), np.array([entries], np.int64))

    return run


def _order(found: DataFrame):
    """(order, entries): hashes and log2 counts of common words, hashes of repeated and of hot
    n-grams; how many entries level 0 has."""
    total = found.where(F.col("kind") != DOCUMENT).groupBy("kind", "h").agg(F.sum("c").alias("c"))
    tops = [total.where(F.col("kind") == ENTRIES)]
    for kind, most in ((WORD, MAX_WORDS), (GRAM, MAX_REPEATED)):
        tops.append(total.where(F.col("kind") == kind).orderBy(F.desc("c"), "h").limit(most))
    got = tops[0].unionByName(tops[1]).unionByName(tops[2]).toArrow()
    kind, h, c = (np.asarray(got.column(x)) for x in ("kind", "h", "c"))
    h = h.astype(np.int64).view(np.uint64)
    w, g = kind == WORD, kind == GRAM
    weight = np.floor(np.log2(np.maximum(c[w], 1)) * 1.5).astype(np.int8)
    return (str(uuid.uuid4()), h[w], weight, h[g], h[g & (c >= HOT)]), int(c[kind == ENTRIES].sum())


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all first ones, then all second ones...: high ones compress to nothing."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(b, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


REPLICA = "bucket int, hot boolean, gram binary, at binary, id binary, size binary"


def _replicas(n, threshold, buckets, bits, order):
    schema = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), *((k, pa.binary()) for k in ("gram", "at", "id", "size"))])

    def run(batches):
        """The windows of level 0: an entry (n-gram, set, size) for each region, packed by bucket.

        Entries of hot n-grams are spread over all buckets by their sets.
        """
        tables = _tables(order)
        held, documents, size = [], 0, 0

        def flush():
            gram, at = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            ids, sizes = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            hot = tables.is_hot(gram)
            gram >>= np.uint64(58 - bits)
            bucket = ((gram * np.uint64(buckets)) >> np.uint64(bits)).astype(np.int64)
            if hot.any():
                bucket[hot] = (mix(ids[at[hot]].view(np.uint64) ^ gram[hot]) % np.uint64(buckets)).astype(np.int64) + buckets
            by = np.lexsort((gram, bucket)) if hot.any() else np.argsort(gram)
            gram, at, bucket = gram[by], at[by], bucket[by]
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << 40))
            out = {k: [] for k in schema.names}
            for a, b in zip(edge[:-1], edge[1:]):
                own, place = np.unique(at[a:b], return_inverse=True)
                place = place.astype(np.uint16 if len(own) < 65536 else np.uint32)
                step = np.diff(gram[a:b], prepend=np.uint64(0))
                row = (bucket[a] % buckets, bucket[a] >= buckets, planes(step), planes(place), planes(ids[own]), planes(sizes[own]))
                for k, v in zip(out, row):
                    out[k].append(v)
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for batch in batches:
            for part in slices(_clean(batch)):
                key, starts = _ngrams(part, n, tables)
                ids, first = np.unique(set_ids(key, starts), return_index=True)
                sizes = np.diff(starts)[first]
                ids, first, sizes = ids[sizes > 0], first[sizes > 0], sizes[sizes > 0]
                length = prefix_length(sizes, threshold)
                held.append((key[segments(starts[first], length)] & LOW58, np.repeat(np.arange(len(ids)) + documents, length), ids, sizes.astype(np.uint32)))
                documents += len(ids)
                size += int(length.sum())
                if size > 800_000:
                    yield flush()
                    held, documents, size = [], 0, 0
        if size:
            yield flush()

    return run


SHARED = "bucket int, gram binary, f binary, others binary, id binary, n binary, size binary"


def _shared(threshold, buckets):
    schema = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("gram", "f", "others", "id", "n", "size"))])

    def packed(gram, f, ids, sizes, first):
        """first: where the entries of each one's region begin."""
        names = (mix(ids.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        for i in range(0, len(gram), 1_000_000):
            bucket = (mix(ids[i : i + 1_000_000].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            by = np.lexsort((gram[i : i + 1_000_000], ids[i : i + 1_000_000], bucket)) + i
            bucket = bucket[by - i]
            edge = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1, append=1 << 40))
            out = {k: [] for k in schema.names}
            for a, b in zip(edge[:-1], edge[1:]):
                own = by[a:b]
                d = ids[own]
                new = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                many = np.diff(np.append(new, b - a)).astype(np.uint32)
                some = own[f[own] <= NAMED]
                size = f[some].astype(np.int64)
                others = segments(first[some], size)
                others = others[others != np.repeat(some, size)]
                for k, v in zip(out, (bucket[a], planes(gram[own]), f[own].tobytes(), names[others].tobytes(), planes(d[new]), planes(many), planes(sizes[own][new]))):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches):
        """Entries of regions in which another document of a compatible size lies; f documents are there."""
        parts: dict = {False: [], True: []}
        for batch in batches:
            for hot, g, at, d, s in zip(*(batch.column(k).to_pylist() for k in ("hot", "gram", "at", "id", "size"))):
                d, s = unplanes(d, np.int64), unplanes(s, np.uint32)
                at = unplanes(at, np.uint16 if len(d) < 65536 else np.uint32)
                parts[hot].append((np.cumsum(unplanes(g, np.uint64)), d[at], s[at]))
        for hot, some in parts.items():
            if not some:
                continue
            gram, ids, sizes = (np.concatenate(x) for x in zip(*some))
            some.clear()
            by = np.argsort(gram, kind="stable")
            if not hot:
                g = gram[by]
                same = g[1:] == g[:-1]
                keep = np.zeros(len(g), bool)
                keep[1:] |= same
                keep[:-1] |= same
                by = by[keep]
            gram, ids, sizes = gram[by], ids[by], sizes[by]
            by = np.lexsort((ids, sizes, gram))
            gram, ids, sizes = gram[by], ids[by], sizes[by]
            keep = np.ones(len(gram), bool)
            keep[1:] = (gram[1:] != gram[:-1]) | (ids[1:] != ids[:-1])
            gram, ids, sizes = gram[keep], ids[keep], sizes[keep]
            if hot:
                yield from packed(gram, np.full(len(gram), 255, np.uint8), ids, sizes, np.zeros(len(gram), np.int64))
                continue
            if not len(gram):
                continue
            near = (gram[1:] == gram[:-1]) & (sizes[1:] * threshold <= sizes[:-1] + 1e-6)
            keep = np.zeros(len(gram), bool)
            keep[1:] |= near
            keep[:-1] |= near
            gram, ids, sizes = gram[keep], ids[keep], sizes[keep]
            if len(gram):
                edge = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1], [True])))
                many = np.diff(edge)
                yield from packed(gram, np.repeat(np.minimum(many, 254).astype(np.uint8), many), ids, sizes, np.repeat(edge[:-1], many))

    return run


SKETCHED = "bucket int, hot boolean, kind int, key binary, at binary, info binary"
INFO = np.dtype([("id", "<i8"), ("size", "<u4"), ("sketch", "<u4", SKETCH)])


def _sketched(threshold, buckets):
    schema = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("kind", pa.int32()), *((k, pa.binary()) for k in ("key", "at", "info"))])

    def run(batches):
        """The regions of level 1 (kind 0) and of prints (kind 1) of each document, with its sketch."""
        parts = []
        for batch in batches:
            for g, f, o, d, n, s in zip(*(batch.column(k).to_pylist() for k in ("gram", "f", "others", "id", "n", "size"))):
                n = unplanes(n, np.uint32)
                parts.append((unplanes(g, np.uint64), np.frombuffer(f, np.uint8), np.frombuffer(o, np.uint16), np.repeat(unplanes(d, np.int64), n), np.repeat(unplanes(s, np.uint32), n)))
        if not parts:
            return
        gram, f, others, ids, sizes = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        by = np.argsort(ids, kind="stable")
        new = np.concatenate(([True], ids[by][1:] != ids[by][:-1]))
        doc = np.empty(len(ids), np.int64)
        doc[by] = np.cumsum(new) - 1
        least = least_shared(np.floor(sizes[by[new]] * threshold))
        # who is met often enough, the regions that don't name their documents added
        named = f <= NAMED
        large = np.bincount(doc, ~named, minlength=len(least)).astype(np.int64)
        size = np.where(named, f.astype(np.int64) - 1, 0)
        entry = np.repeat(np.arange(len(f)), size)
        met = (doc[entry] << 16) | others
        order = np.argsort(met)
        edge = np.flatnonzero(np.diff(met[order], prepend=-1, append=-1))
        often = np.repeat(np.diff(edge), np.diff(edge)) + large[doc[entry[order]]] >= least[doc[entry[order]]]
        keep = ~named
        keep[entry[order[often]]] = True
        by = by[keep[by] & (np.bincount(doc, keep, minlength=len(least)) >= least)[doc[by]]]
        if not len(by):
            return
        gram, f, ids, sizes = gram[by], f[by], ids[by], sizes[by]
        edge = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        many = np.diff(np.append(edge, len(ids)))
        doc = np.repeat(np.arange(len(edge)), many)
        least = least_shared(np.floor(sizes[edge] * threshold))
        by = np.lexsort((gram, f, doc))
        first = by[np.arange(len(by)) - edge[doc] < (many - least + 1)[doc]]
        prints = (mix(gram) >> np.uint64(32)).astype(np.uint32)
        by = np.lexsort((prints, doc))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (prints[by][1:] != prints[by][:-1]) | (doc[1:] != doc[:-1])
        count = np.cumsum(fresh)
        nth = count - count[edge][doc]
        top = fresh & (nth < SKETCH)
        sketch = np.zeros((len(edge), SKETCH), np.uint32)
        sketch[doc[top], nth[top]] = prints[by][top]
        top = by[top]
        info = np.zeros(len(edge), INFO)
        info["id"], info["size"], info["sketch"] = ids[edge], sizes[edge], sketch
        for kind, key, sel in ((0, gram, first), (1, prints.astype(np.uint64), top)):
            for i in range(0, len(sel), 500_000):
                at = sel[i : i + 500_000]
                bucket = (mix(key[at] + np.uint64(kind)) % np.uint64(buckets)).astype(np.int64)
                hot = f[at] == 255
                bucket[hot] = (mix(ids[at[hot]].view(np.uint64)) % np.uint64(buckets)).astype(np.int64) + buckets
                order = np.lexsort((key[at], bucket))
                at, bucket = at[order], bucket[order]
                cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << 40))
                out = {k: [] for k in schema.names}
                for a, b in zip(cut[:-1], cut[1:]):
                    own, place = np.unique(doc[at[a:b]], return_inverse=True)
                    step = np.diff(key[at[a:b]], prepend=np.uint64(0))
                    for k, v in zip(out, (bucket[a] % buckets, bucket[a] >= buckets, kind, planes(step), planes(place.astype(np.uint32)), info[own].tobytes())):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


#: An entry of level 1, unpacked.
ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("size", "<u4"), ("kind", "u1"), ("sketch", "<u4", SKETCH)])


def _entries(kind, key, at, info):
    key, info = np.cumsum(unplanes(key, np.uint64)), np.frombuffer(info, INFO)[unplanes(at, np.uint32)]
    e = np.zeros(len(key), ENTRY)
    e["key"], e["kind"] = key, kind
    for name in ("id", "size", "sketch"):
        e[name] = info[name]
    return e


LIVE = "id long, kind int, key long, size long, sketch binary"


def _live(threshold):
    def close(a, b):
        """Whether sizes fit a pair at the threshold."""
        return (a <= b / threshold + 1e-6) & (b <= a / threshold + 1e-6)

    def among(e):
        """Which entries of a region have someone to meet there."""
        size = e["size"].astype(np.float64)
        limit = int(e["key"][0]) if e["kind"][0] else 1 << 32
        prints = e["sketch"].astype(np.int64)
        prints[prints >= limit] = 0
        flat = prints.ravel()
        by = np.argsort(flat, kind="stable")
        holders = by // SKETCH
        lo, hi = np.searchsorted(flat[by], flat), np.searchsorted(flat[by], flat, side="right")
        ok = np.zeros(len(e), bool)
        for i in range(len(e)):
            if ok[i]:
                continue
            free = close(size, size[i])
            free[i] = False
            for k in range(i * SKETCH, (i + 1) * SKETCH):
                if flat[k]:
                    free[holders[lo[k] : hi[k]]] = False
            ok |= free
            ok[i] = free.any()
        return ok

    def among_few(e, first, c):
        """The same for many regions of c entries each, which begin at `first`, at once."""
        at = first[:, None] + np.arange(c)
        size = e["size"][at].astype(np.float64)
        ok = close(size[:, None], size[:, :, None])
        ok[:, np.arange(c), np.arange(c)] = False
        limit = np.where(e["kind"][first] == 1, e["key"][first], np.uint64(1 << 32)).astype(np.int64)
        prints = e["sketch"][at].astype(np.int64)
        prints[prints >= limit[:, None, None]] = 0
        for k in range(SKETCH):
            p = prints[:, :, k]
            if p.any():
                ok &= ~((np.where(p > 0, p, -1)[:, :, None, None] == prints[:, None]).any(3))
        return at[ok.any(2)]

    def rows(e):
        return pa.RecordBatch.from_arrays([pa.array(e["id"]), pa.array(e["kind"].astype(np.int32)), pa.array(e["key"].view(np.int64)), pa.array(e["size"].astype(np.int64)), pa.array([x.tobytes() for x in e["sketch"]], pa.binary())], ["id", "kind", "key", "size", "sketch"])

    def run(batches):
        """Entries of regions where somebody is to be met; hot regions are passed on as they are."""
        parts = []
        for batch in batches:
            for hot, *packed in zip(*(batch.column(k).to_pylist() for k in ("hot", "kind", "key", "at", "info"))):
                e = _entries(*packed)
                if hot:
                    yield rows(e)
                else:
                    parts.append(e)
        if not parts:
            return
        e = np.concatenate(parts)
        parts.clear()
        e = e[np.lexsort((e["key"], e["kind"]))]
        edge = np.flatnonzero(np.concatenate(([True], (e["key"][1:] != e["key"][:-1]) | (e["kind"][1:] != e["kind"][:-1]), [True])))
        count = np.diff(edge)
        live = np.zeros(len(e), bool)
        for c in np.unique(count[(count > 1) & (count <= FEW)]).tolist():
            first = edge[:-1][count == c]
            step = max(1, 300_000 // (c * c))
            for i in range(0, len(first), step):
                live[among_few(e, first[i : i + step], c)] = True
        for i in np.flatnonzero(count > FEW):
            live[edge[i] : edge[i + 1]] = among(e[edge[i] : edge[i + 1]])
        e = e[live]
        for i in range(0, len(e), 20_000):
            yield rows(e[i : i + 20_000])

    return run


def _wanted(bits):
    def run(batches):
        """A slice of the bitmap of hashed ids; each slice is made by one task."""
        for batch in batches:
            for s, h in zip(batch.column("slice").to_pylist(), batch.column("places")):
                flags = np.zeros(bits, bool)
                flags[np.asarray(h.values)] = True
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["slice", "bits"])

    return run


#: Slices of the bitmap of wanted ids, and the most bits of one: 8 MB in all, whatever the corpus.
WANTED_SLICES, WANTED_BITS = 16, 1 << 22


def wanted_bitmap(ids: DataFrame, rows: int):
    """A bitmap of hashed doc_ids, of at most 8 MB: what isn't in it isn't wanted."""
    bits = min(WANTED_BITS, max(1 << 10, 1 << int(2 * rows).bit_length()))
    h = F.xxhash64("doc_id")
    placed = ids.select(F.pmod(h, F.lit(WANTED_SLICES)).cast("int").alias("slice"), F.pmod(F.shiftright(h, 8), F.lit(bits)).cast("int").alias("place"))
    got = placed.groupBy("slice").agg(F.collect_set("place").alias("places")).mapInArrow(_wanted(bits), "slice int, bits binary").toArrow()
    flags = np.zeros((WANTED_SLICES, bits // 8), np.uint8)
    for s, b in zip(*(got.column(k).to_pylist() for k in ("slice", "bits"))):
        flags[s] = np.frombuffer(b, np.uint8)
    return flags


def bitmap(grams: np.ndarray) -> bytes:
    """A bit for each residue of the n-grams; 1.5 to 3 bits an n-gram, a power of two and 64 at least."""
    bits = np.zeros(max(64, 1 << int(1.5 * len(grams) - 1).bit_length()), bool)
    bits[grams & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _payload(n, order, flags, whole):
    def run(batches):
        """(id, blob) of the documents wanted: their whole sets or bitmaps of them."""
        tables = _tables(order)
        bits = flags.value
        for batch in batches:
            place, s = (np.asarray(batch.column(k)) for k in ("place", "slice"))
            some = (bits[s, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
            for part in slices(batch.filter(pa.array(some.astype(bool))).select(["doc_id", "text"])):
                key, starts = _ngrams(part, n, tables)
                ids = set_ids(key, starts)
                blobs = [key[a:b].tobytes() if whole else bitmap(key[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                out = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blobs, pa.binary())], ["id", "blob"])
                yield out.filter(pa.array(np.diff(starts) > 0))

    return run


def meeting(kind: int, key: int, cross: bool, rows: dict, threshold: float) -> list:
    """The documents of a region with a possible partner that they are to meet there.

    rows: {id: (mark, size, sketch, bits)}; with cross, partners have another mark. Larger bitmaps are
    folded to the size of smaller ones.
    """
    order = sorted(rows, key=lambda d: rows[d][1])
    mark, sizes = (np.array([rows[d][i] for d in order]) for i in (0, 1))
    sketches = np.frombuffer(b"".join(rows[d][2] for d in order), np.uint32).reshape(len(order), SKETCH)
    live = np.zeros(len(order), bool)
    widths = np.array([len(rows[d][3]) for d in order])
    share = (1 - threshold) / (1 + threshold)
    for width in np.unique(widths).tolist():
        a, b = np.searchsorted(widths, [width, width + 1])
        c = int(np.searchsorted(sizes, sizes[b - 1] / threshold + 1e-9, side="right"))
        if c - a < 2:
            continue
        maps = []
        for d in order[a:c]:
            m = np.frombuffer(rows[d][3], np.uint64)
            while len(m) * 8 > width:
                m = m[: len(m) // 2] | m[len(m) // 2 :]
            maps.append(m)
        maps = np.stack(maps)
        for i in range(a, b):
            stop = int(np.searchsorted(sizes, sizes[i] / threshold + 1e-9, side="right"))
            look = np.arange(i + 1, stop)
            if live[i]:
                look = look[~live[i + 1 : stop]]
            if cross:
                look = look[mark[look] != mark[i]]
            if not len(look):
                continue
            differ = np.bitwise_count(maps[i - a] ^ maps[look - a]).sum(1, dtype=np.int64)
            near = look[differ <= share * (sizes[i] + sizes[look]) + 1e-6]
            if not len(near):
                continue
            same = ((sketches[near][:, :, None] == sketches[i]) & (sketches[i] > 0)).any(2)
            common = np.where(same, sketches[near], np.uint32(0xFFFFFFFF)).min(1)
            here = same.any(1) & (common == key) if kind else ~same.any(1)
            live[i] |= here.any()
            live[near[here]] = True
    return [order[i] for i in np.flatnonzero(live)]


def _by_region(columns, close):
    """A function over rows sorted by region that calls close(region, rows) at each region's end."""

    def run(batches):
        now, rows = None, {}
        for batch in batches:
            for kind, key, lo, hi, d, *row in zip(*(batch.column(k).to_pylist() for k in ("kind", "key", "lo", "hi", "id", *columns))):
                if (kind, key, lo, hi) != now:
                    if len(rows) > 1:
                        yield from close(now, rows)
                    now, rows = (kind, key, lo, hi), {}
                rows[d] = row
        if len(rows) > 1:
            yield from close(now, rows)

    return run


def _meetings(threshold):
    def close(region, rows):
        kind, key, lo, hi = region
        got = meeting(kind, key, lo != hi, rows, threshold)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array([kind] * len(got), pa.int32()), pa.array([key] * len(got), pa.int64()), pa.array([rows[d][1] for d in got], pa.int64()), pa.array([rows[d][2] for d in got], pa.binary())], ["id", "kind", "key", "size", "sketch"])

    return _gathered(_by_region(("mark", "size", "sketch", "blob"), close))


def _gathered(run):
    """Small batches of run as fewer larger ones."""

    def out(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n > 10_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    p = np.searchsorted(b, a)
    p[p == len(b)] = 0
    return int(np.count_nonzero(b[p] == a))


def _distances(pivot: np.ndarray, sets: list, members: np.ndarray) -> np.ndarray:
    out = np.empty(len(members))
    for k, m in enumerate(members):
        c = _common(pivot, sets[m])
        out[k] = 1 - c / (len(pivot) + len(sets[m]) - c)
    return out


def _compared(sets: list, rows: np.ndarray, cols: np.ndarray, threshold: float):
    """(i, j, common) arrays of the pairs of a row and a column with Jaccard >= threshold."""
    sizes = np.array([len(s) for s in sets], np.float64)
    both = np.zeros((len(rows), len(cols)), np.float32)
    one = rows is cols
    members = rows if one else np.concatenate([rows, cols])
    grams, place, many = np.unique(np.concatenate([sets[m] for m in members]), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(members)), sizes[members].astype(np.int64))
    shared = many > 1
    new = np.cumsum(shared) - 1
    keep = shared[place]
    who, place = who[keep], new[place[keep]]
    by = np.argsort(place, kind="stable")
    who, place = who[by], place[by]
    width = max(1, min(CELLS // len(members), int(shared.sum())))
    for g in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, [g, g + width])
        has = np.zeros((len(members), width), np.float32)
        has[who[a:b], place[a:b] - g] = 1
        both += has[: len(rows)] @ (has if one else has[len(rows) :]).T
    for r in range(0, len(rows), 256):
        part = both[r : r + 256]
        ok = (part > 0) & (part >= threshold * (sizes[rows[r : r + 256], None] + sizes[cols][None] - part) - 1e-6)
        i, j = np.nonzero(ok)
        if one:
            i, j = i[j > i + r], j[j > i + r]
        c = part[i, j].astype(np.int64)
        i, j = rows[i + r], cols[j]
        exact = c >= threshold * (sizes[i] + sizes[j] - c) - 1e-9
        if exact.any():
            yield i[exact], j[exact], c[exact]


def _tiles(sets: list, members: np.ndarray) -> list:
    """Runs of members with at most TILE of them and about TILE_GRAMS n-grams."""
    ends = np.cumsum([len(sets[m]) for m in members])
    out, a = [], 0
    while a < len(members):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TILE_GRAMS, side="right"))
        b = min(max(b, a + 1), a + TILE)
        out.append(members[a:b])
        a = b
    return out


def _compared_tiles(sets: list, rows: np.ndarray, cols: np.ndarray, threshold: float):
    """`_compared` in pieces of bounded memory."""
    left = _tiles(sets, rows)
    right = left if rows is cols else _tiles(sets, cols)
    for k, a in enumerate(left):
        for b in right[k if rows is cols else 0 :]:
            yield from _compared(sets, a, b, threshold)


def connected(sets: list, threshold: float) -> np.ndarray:
    """Labels of what pairs with Jaccard >= threshold connect, without looking at all of these pairs.

    Some members are compared with all others. The largest component that this makes needs no further
    look inside; what is left is connected by itself, and then held against the component until it
    belongs to it. So n near copies cost about n comparisons, and members that nothing connects n^2.
    """
    label = np.arange(len(sets))

    def joined(found):
        nonlocal label
        for i, j, _ in found:
            label = merge(label, i, j)

    def connect(members):
        if len(members) < 2:
            return
        if len(members) <= 128:
            joined(_compared(sets, members, members, threshold))
            return
        order = members[np.argsort([len(sets[m]) for m in members], kind="stable")]
        probes = np.unique(np.linspace(0, len(order) - 1, 10).astype(np.int64)[1:-1])
        for part in _tiles(sets, members):
            joined(_compared(sets, order[probes], part[~np.isin(part, order[probes])], threshold))
        names, many = np.unique(label[members], return_counts=True)
        core = label[members] == names[many.argmax()]
        if 8 * many.max() < len(members):
            joined(_compared_tiles(sets, members, members, threshold))
            return
        rest, core = members[~core], members[core]
        connect(rest)
        for a in range(0, len(rest), 256):
            for part in _tiles(sets, core):
                some = rest[a : a + 256]
                some = some[label[some] != label[core[0]]]
                if len(some):
                    joined(_compared(sets, some, part, threshold))

    connect(np.arange(len(sets)))
    return label


def metric_join(sets: list, threshold: float, small: int = 200, pivots: int = 6, depth: int = 8):
    """Arrays (i, j, common) of all pairs of sorted arrays with Jaccard >= threshold, each pair once.

    Voronoi cells of pivots taken from the sets, replicated by the triangle inequality: if x has
    home p0 and y has home p, then d(x, p) <= d(y, p) + eps <= d(y, p0) + eps <= d(x, p0) + 2 eps.
    A pair that is in several cells is given by the first of them. A cell nearly as large as its
    parent is compared in full.
    """
    eps = 1 - threshold

    def split(members, level, frames):
        if len(members) > small and level < depth:
            order = members[np.argsort([len(sets[m]) for m in members], kind="stable")]
            chosen = order[np.linspace(0, len(order) - 1, pivots).astype(np.int64)]
            d = np.stack([_distances(sets[p], sets, members) for p in chosen])
            home = d.min(0)
            inside = (d <= home + 2 * eps + 1e-12) & (d <= home).any(1)[:, None]
            if inside.sum(1).max() <= 0.9 * len(members):
                lies = np.zeros((pivots, len(sets)), bool)
                lies[:, members] = inside
                for k in range(pivots):
                    if inside[k].sum() > 1:
                        yield from split(members[inside[k]], level + 1, [*frames, (lies, k)])
                return
        for i, j, c in _compared_tiles(sets, members, members, threshold):
            own = np.ones(len(i), bool)
            for lies, k in frames:
                own &= (lies[:, i] & lies[:, j]).argmax(0) == k
            if own.any():
                yield i[own], j[own], c[own]

    if len(sets) > 1:
        yield from split(np.arange(len(sets)), 0, [])


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of components after the edges (a, b); the smallest number of a component is its label."""
    while True:
        x, y = label[a], label[b]
        far = x != y
        if not far.any():
            return label
        a, b, x, y = a[far], b[far], x[far], y[far]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def joined_region(kind: int, key: int, cross: bool, rows: dict, threshold: float):
    """(ids, arrays (i, j, common)) of the pairs that this region reports.

    rows: {id: (mark, sketch, keys0, grams)}.
    """
    ids = np.array(sorted(rows), np.int64)
    own = [rows[d] for d in ids.tolist()]
    sets = [np.frombuffer(r[3], np.uint64) for r in own]
    prints = np.frombuffer(b"".join(r[1] for r in own), np.uint32).reshape(len(own), SKETCH).astype(np.int64)
    prints[prints >= (key if kind else 1 << 32)] = 0
    _, place, many = np.unique(prints, return_inverse=True, return_counts=True)
    place = place.reshape(prints.shape)
    place[(prints == 0) | (many[place] < 2)] = -1

    def elsewhere(i, j):
        """Whether pairs have a common print that makes them meet in another region."""
        hit = np.zeros(len(i), bool)
        for a in range(SKETCH):
            p = place[i, a]
            some = np.flatnonzero((p >= 0) & ~hit)
            hit[some] = (place[j[some]] == p[some, None]).any(1)
        return hit

    def first_common(i, j):
        return [min(set(own[a][2]) & set(own[b][2])) == key for a, b in zip(i.tolist(), j.tolist())]

    def pairs():
        if cross:
            mark = np.array([r[0] for r in own])
            found = _compared_tiles(sets, np.flatnonzero(mark == mark[0]), np.flatnonzero(mark != mark[0]), threshold) if (mark != mark[0]).any() else ()
        else:
            found = metric_join(sets, threshold)
        for i, j, c in found:
            here = ~elsewhere(i, j)
            if not kind and here.any():
                here[here] = first_common(i[here], j[here])
            if here.any():
                yield i[here], j[here], c[here]

    return ids, [len(s) for s in sets], pairs()


PAIRS = "id_a long, id_b long, common long, union long"
LINKS = "id long, n long, root long"


def _regions(threshold, result):
    def pairs(region, rows):
        kind, key, lo, hi = region
        ids, sizes, found = joined_region(kind, key, lo != hi, rows, threshold)
        sizes = np.array(sizes)
        for i, j, c in found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], ids[j], c, sizes[i] + sizes[j] - c)], ["id_a", "id_b", "common", "union"])

    def links(region, rows):
        """The number of links of each document in this region, and one that it is connected with."""
        kind, key, lo, hi = region
        ids, _, found = joined_region(kind, key, lo != hi, rows, threshold)
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j, _ in found:
            n += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            label = merge(label, i, j)
        some = n > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some], n[some], ids[label[some]])], ["id", "n", "root"])

    def classes(region, rows):
        """The documents that links in this region connect; n only says that there are some."""
        ids = np.array(sorted(rows), np.int64)
        label = connected([np.frombuffer(rows[d][3], np.uint64) for d in ids.tolist()], threshold)
        some = np.bincount(label, minlength=len(ids))[label] > 1
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some], np.ones(int(some.sum()), np.int64), ids[label[some]])], ["id", "n", "root"])

    return _gathered(_by_region(("mark", "sketch", "keys0", "blob"), {"pairs": pairs, "links": links, "classes": classes}[result]))


def _joined(docs: DataFrame, threshold: float, n: int, result: str) -> tuple[DataFrame, DataFrame]:
    """(documents, found): (doc_id, id) of each document and its set (null without words); result, of sets:
    "pairs" (PAIRS), "links" (LINKS), or "classes" (LINKS whose n counts nothing)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    own = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    found = checkpointed(own.mapInArrow(_statistics(n, threshold), FOUND))
    documents = found.where(F.col("kind") == DOCUMENT).select(F.col("c").alias("doc_id"), F.col("h").alias("id")).distinct()
    with shuffles_freed(spark):
        steer, entries = _order(found)
    order = spark.sparkContext.broadcast(steer)
    buckets = max(shuffle_partitions(spark), -(-entries // TASK_ENTRIES))
    bits = min(56, max(36, int(entries).bit_length() + 13), 63 - buckets.bit_length())
    at = lambda df: df.repartitionById(buckets, F.col("bucket"))
    replicas = own.mapInArrow(_replicas(n, threshold, buckets, bits, order), REPLICA)
    shared = checkpointed(at(replicas).mapInArrow(_shared(threshold, buckets), SHARED))
    sketched = at(shared).mapInArrow(_sketched(threshold, buckets), SKETCHED)
    live = at(sketched).mapInArrow(_live(threshold), LIVE)
    packs = [F.collect_set(F.when(F.col("kind") == k, F.col("key"))).alias(f"keys{k}") for k in (0, 1)]
    by_document = lambda df: df.groupBy("id").agg(*packs, F.max("size").alias("size"), F.max("sketch").alias("sketch"))
    first = documents.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    hashed = F.xxhash64("doc_id")

    def at_regions(placed, whole):
        """The payload of every document at each of its regions, sorted by region."""
        placed = checkpointed(placed)
        rows, keys = placed.agg(F.count("*"), F.coalesce(F.sum(F.size("keys0") + F.size("keys1")), F.lit(0))).first()
        with shuffles_freed(spark):
            flags = wanted_bitmap(placed.select("id").join(first, "id"), rows)
        text = own.where("doc_id is not null and text is not null").select("doc_id", "text", F.pmod(hashed, F.lit(WANTED_SLICES)).cast("int").alias("slice"), F.pmod(F.shiftright(hashed, 8), F.lit(flags.shape[1] * 8)).cast("int").alias("place"))
        blobs = text.mapInArrow(_payload(n, order, spark.sparkContext.broadcast(flags), whole), "id long, blob binary")
        regions = F.concat(F.transform("keys0", lambda x: F.struct(F.lit(0).alias("kind"), x.alias("key"))), F.transform("keys1", lambda x: F.struct(F.lit(1).alias("kind"), x.alias("key"))))
        each = placed.select("id", "size", F.explode(regions).alias("r")).select("id", "size", "r.*")
        most, most_grams = (BLOCK, BLOCK_GRAMS) if whole else (MAP_BLOCK, MAP_BLOCK_GRAMS)
        blocks = F.ceil(F.greatest(F.count("*") / most, F.sum("size") / most_grams)).cast("int")
        big = checkpointed(each.groupBy("kind", "key").agg(blocks.alias("blocks")).where("blocks > 1"))
        many = big.count()
        side = F.broadcast(placed) if 150 * rows + 8 * keys <= MAX_BROADCAST_BYTES else placed
        out = blobs.join(side, "id").withColumn("r", F.explode(regions)).select("id", "size", "sketch", "keys0", "blob", "r.*")
        if many:
            out = out.join(F.broadcast(big) if 40 * many <= MAX_BROADCAST_BYTES else big, ["kind", "key"], "left")
            mark = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
            out = out.withColumn("mark", mark).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        else:
            out = out.withColumn("mark", F.lit(0)).withColumn("other", F.lit(0))
        out = out.select("kind", "key", F.least("mark", "other").alias("lo"), F.greatest("mark", "other").alias("hi"), "id", "mark", "size", "sketch", *([F.when((F.col("kind") == 0) & F.lit(result != "classes"), F.col("keys0")).alias("keys0")] if whole else []), "blob")
        return out.repartition(buckets, "kind", "key", "lo", "hi").sortWithinPartitions("kind", "key", "lo", "hi")

    met = at_regions(by_document(live), False).mapInArrow(_meetings(threshold), LIVE)
    sets = at_regions(by_document(met), True)
    return documents, sets.mapInArrow(_regions(threshold, result), PAIRS if result == "pairs" else LINKS)


def jaccard_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """Pairs (doc_a < doc_b, common, union, jaccard) of different sets with jaccard >= threshold.

    Of documents with equal sets the smallest doc_id stands for all; `jaccard_classes` says which
    they are.
    """
    documents, pairs = _joined(docs, threshold, n, "pairs")
    first = documents.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("d"))
    a, b = (first.select(F.col("id").alias(f"id_{k}"), F.col("d").alias(f"d_{k}")) for k in "ab")
    named = pairs.join(a, "id_a").join(b, "id_b").where("d_a <> d_b")
    return named.select(F.least("d_a", "d_b").alias("doc_a"), F.greatest("d_a", "d_b").alias("doc_b"), "common", "union", (F.col("common") / F.col("union")).alias("jaccard"))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, counted: bool = True) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies): a row for each document, or each of its sets.

    A class is what links connect; class_id is its smallest doc_id. n_links counts the other sets
    within the threshold, n_copies the documents with the same set, this one too (0 without words).
    Where links are not `counted`, n_links is 0 or more than 0, and groups of near copies cost no more
    than connecting them.
    """
    documents, found = _joined(docs, threshold, n, "links" if counted else "classes")
    found = checkpointed(found)
    documents = checkpointed(documents)
    with shuffles_freed(docs.sparkSession):
        group = components(found.select(F.col("id").alias("doc_a"), F.col("root").alias("doc_b"))).select(F.col("doc_id").alias("id"), F.col("group_id").alias("g"))
    sets = documents.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    sets = sets.join(links.join(group, "id"), "id", "left").withColumn("g", F.coalesce("g", "id"))
    sets = checkpointed(sets)
    smallest = sets.where("n_links is not null").groupBy("g").agg(F.min("first").alias("smallest"))
    sets = sets.join(smallest, "g", "left").select("id", F.coalesce("smallest", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    every = documents.join(sets, "id", "left")
    return every.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"))


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every document in a pair: group_id is the smallest doc_id reachable.

    Labels spread along the pairs and are then followed to their own labels, so that the rounds
    grow with the logarithm of a group's diameter; each round is checkpointed.
    """
    edges = pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v"))
    edges = checkpointed(edges.union(edges.select("v", "u")).distinct())
    label = checkpointed(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("g")))
    while True:
        near = edges.join(label.select(F.col("u").alias("v"), F.col("g").alias("h")), "v").groupBy("u").agg(F.min("h").alias("h"))
        step = label.join(near, "u").select("u", "g", F.least("g", "h").alias("n"))
        jump = step.select(F.col("u").alias("k"), F.col("n").alias("to"))
        after = checkpointed(step.join(jump, step["n"] == jump["k"]).select("u", "g", F.least("n", "to").alias("n")))
        changed = after.where("g <> n").limit(1).count()
        label = after.select("u", F.col("n").alias("g"))
        if not changed:
            return label.select(F.col("u").alias("doc_id"), F.col("g").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """Keep the document with the smallest doc_id of each class; all columns stay.

    Documents without partners stay, rows with null doc_id too. Repeated rows of a doc_id all stay
    or all go.
    """
    gone = jaccard_classes(docs, threshold, n, counted=False).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = checkpointed(gone)
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"].try_cast("long") == gone["__gone"], "left_anti")


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x20]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2
    THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
k AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY doc_id),
r AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS rep, count(*) OVER (PARTITION BY h) AS n_copies FROM k),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT rep FROM r) AND b.doc_id IN (SELECT rep FROM r) GROUP BY 1, 2),
p AS (SELECT x, y FROM c JOIN k kx ON kx.doc_id = x JOIN k ky ON ky.doc_id = y WHERE common >= 0.6 * (kx.n + ky.n - common) - 1e-9),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach(x, y) AS (SELECT rep, rep FROM r UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
class AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
links AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT w.doc_id, coalesce(class.class_id, w.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 0)::BIGINT AS n_copies
FROM (SELECT DISTINCT doc_id FROM w) w LEFT JOIN r USING (doc_id) LEFT JOIN class ON class.x = r.rep LEFT JOIN links ON links.x = r.rep
"""
