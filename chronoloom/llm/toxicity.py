"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of the labelled documents (MAX_EXAMPLES); all of them are indexed, over
all their features: words and beginnings of words, so that inflected words are known by their
stems. Document frequencies of the features are counted over the whole corpus. The weight of a
feature in a text is (1 + ln tf) * idf * s: s, between FLOOR and 1 + FLOOR, rises with the
significance (chi-square) of the feature's being more frequent in toxic examples than in all, so
that no feature is without weight, but those that don't tell the classes apart have little. As with
any TF-IDF that is fitted on examples, features that no example has are passed over.

Of every document the K nearest examples are found exactly with an inverted index that scores all of
them: features that many examples have are rows of a matrix, others lists. Their
labels, weighted by cosine, give a vote that an isotonic fit to votes on the examples, each without
itself, turns into a probability; examples count as many labelled documents as they stand for. The
neighbours are the evidence.

Defined results: words are runs of ASCII letters and digits and of characters beyond ASCII, lower-
cased; beginnings are the first 4, 5 and 6 bytes of longer words. A null or empty text, and any
text without known features, has no neighbours and the score of such texts among the examples. Equal
cosines are ordered by doc_id. A document is no neighbour of its own doc_id. Several labels of a
document count as toxic if one is; null labels and labels of absent documents are passed over.
Without a toxic and a clean example every score is 0. Every row gets a row, repeated ones and those
with null doc_id too (a doc_id that isn't a whole number counts as null); other columns are not read
by `score_documents` and are kept by `keep_clean`.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, forget_others, process_cache, segments, shuffles_freed, slices, table, word_hashes

#: Bounds of the labelled sample, by class (clean, toxic).
MAX_EXAMPLES = (2000, 1000)
#: Least factor of a feature's weight, and the chi-square at which the rest is half.
FLOOR, HALF = 0.03, 60.0
PREFIXES = (4, 5, 6)
K = 15
#: Share of the examples from which a feature's weights are stored as a row.
COMMON = 0.08
#: Above what cosines in single precision are wrong by.
MARGIN = 2e-5
#: Bytes of text whose features are counted at a time, and texts that are scored at a time.
SLICE, BATCH = 500_000, 128
#: Cosine mass added to the clean side of every vote.
PRIOR = 0.5
#: Votes are compared to so many digits.
DIGITS = 5
THRESHOLD = 0.5


def _inside() -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[128:] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        flags[a:b] = True
    return flags


def features_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature hash, count), sorted: words and beginnings of words of every row."""
    words, starts, *prefixes = word_hashes(text, inside=_inside(), prefixes=PREFIXES)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.stack([words, *prefixes], 1)
    r = np.repeat(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), h.shape[1])
    h = h.ravel()
    r, h = r[h > 0], h[h > 0]
    bits = np.uint64(len(starts).bit_length())
    by = np.argsort((r.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    r, h = r[by], h[by]
    edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]))))
    return r[edge], h[edge], np.diff(np.append(edge, len(h)))


class FeatureTable:
    """Look-up of feature hashes by slot; those whose slot is taken are found by search."""

    BITS = 21

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        slot = self._slot(hashes)
        self.at = np.full(1 << self.BITS, -1, np.int32)
        self.at[slot[::-1]] = np.arange(len(hashes), dtype=np.int32)[::-1]
        late = np.flatnonzero(self.at[slot] != np.arange(len(hashes)))
        self.late = late[np.argsort(hashes[late])]
        self.crowded = np.zeros(1 << self.BITS, bool)
        self.crowded[slot[late]] = True

    def _slot(self, h):
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each feature, -1 for unknown ones."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        slot = self._slot(h)
        out = self.at[slot].astype(np.int64)
        out[self.hashes[np.maximum(out, 0)] != h] = -1
        again = np.flatnonzero((out < 0) & self.crowded[slot])
        if len(again):
            late = self.hashes[self.late]
            place = np.minimum(np.searchsorted(late, h[again]), len(late) - 1)
            hit = late[place] == h[again]
            out[again[hit]] = self.late[place[hit]]
        return out

    def counts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, count) of the known features of every row, by row."""
        r, h, n = features_of(text)
        f = self.find(h)
        ok = f >= 0
        return r[ok], f[ok], n[ok]


class ExampleIndex:
    """Inverted index over unit vectors, from postings (feature, example, weight).

    Features that a share COMMON of the examples has become rows of a matrix, which is multiplied with
    a batch of texts at once; the others are lists. It is made and sorted on the driver. Workers make
    the matrix of its entries, and use the lists as they came.
    """

    def __init__(self, n: int, features: int, feature: np.ndarray, example: np.ndarray, weight: np.ndarray):
        self.n = n
        number = np.uint16 if n <= 1 << 16 else np.int32
        many = np.bincount(feature, minlength=features) if len(feature) else np.zeros(features, np.int64)
        common = many >= max(4, COMMON * n)
        self.col = np.full(features, -1, np.int32)
        self.col[common] = np.arange(common.sum())
        some = common[feature]
        self.entries = (self.col[feature[some]], example[some].astype(number), weight[some].astype(np.float32))
        by = np.flatnonzero(~some)
        by = by[np.argsort(feature[by])]
        self.border = np.concatenate(([0], np.cumsum(np.where(common, 0, many))))
        self.example, self.weight = example[by].astype(number), weight[by].astype(np.float32)
        self.rows = None

    def search(self, cut: np.ndarray, feature: np.ndarray, weight: np.ndarray, k: int, skip: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, feature[cut[i]:cut[i+1]], the k examples of the largest positive cosine, exactly.

        Ties go to the lower number; skip has the examples that are none for a text. All examples are
        scored, rows in single precision; those within a margin of the k-th again in double.
        """
        if self.rows is None:
            col, example, value = self.entries
            self.rows = np.zeros((col.max(initial=-1) + 1, self.n), np.float32)
            self.rows[col, example] = value
            self.entries = None
        n = len(cut) - 1
        text = np.repeat(np.arange(n), np.diff(cut))
        col = self.col[feature]
        common, rare = np.flatnonzero(col >= 0), np.flatnonzero(col < 0)
        asked = np.zeros((n, len(self.rows)), np.float32)
        asked[text[common], col[common]] = weight[common]
        seen = asked @ self.rows
        lo = self.border[feature[rare]]
        many = self.border[feature[rare] + 1] - lo
        cuts = [np.searchsorted(text[x], np.arange(n + 1)) for x in (common, rare)]
        out = []
        for i, own in enumerate(skip):
            c, r = (slice(x[i], x[i + 1]) for x in cuts)
            at = segments(lo[r], many[r])
            score = np.bincount(self.example[at], np.repeat(weight[rare[r]], many[r]) * self.weight[at], minlength=self.n)
            both = seen[i] + score
            both[list(own)] = -1
            least = np.partition(both, self.n - k)[self.n - k] if self.n >= k else -1
            ids = np.flatnonzero((both > 0) & (both >= least - MARGIN))
            cosine = weight[common[c]] @ self.rows[col[common[c]][:, None], ids] + score[ids]
            top = np.lexsort((ids, -np.round(cosine, 12)))[:k]
            out.append((ids[top], cosine[top]))
        return out


#: The same by an earlier name.
BlockMaxIndex = ExampleIndex


def unit_weights(rows, features, counts, factor, n) -> np.ndarray:
    """Weights of unit vectors of rows 0 to n - 1."""
    weight = (1 + np.log(np.maximum(counts, 1))) * factor[features] if len(features) else np.zeros(0)
    norm = np.sqrt(np.bincount(rows, weight**2, minlength=n)) if len(rows) else np.ones(n)
    return weight / norm[rows] if len(rows) else weight


def vote(labels: np.ndarray, cosines: np.ndarray) -> float:
    """Share of toxic neighbours by cosine, with a prior for clean."""
    return float((labels * cosines).sum() / (cosines.sum() + PRIOR)) if len(cosines) else 0.0


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step function nearest to y over x with weights w: borders and values."""
    ux, at = np.unique(np.round(x, DIGITS), return_inverse=True)
    out: list[list[float]] = []
    for g in zip(ux, np.bincount(at, y * w), np.bincount(at, w)):
        out.append(list(g))
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            b = out.pop()
            out[-1][1] += b[1]
            out[-1][2] += b[2]
    return np.array([g[0] for g in out]), np.array([g[1] / g[2] for g in out])


def known_labels(labels: DataFrame) -> DataFrame:
    whole = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), "toxic")
    return whole.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample_examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most MAX_EXAMPLES labelled documents of each class, checkpointed."""
    ensure_checkpoint_dir(docs.sparkSession)
    known = known_labels(labels)
    dice = F.xxhash64("doc_id", F.lit("examples"))

    def first(df, most):
        clean, toxic = (df.where(F.col("toxic") == c).orderBy(dice, "doc_id").limit(m) for c, m in enumerate(most))
        return clean.unionByName(toxic)

    # twice as many labels as examples: labels of absent documents leave enough
    likely = first(known, [2 * m for m in MAX_EXAMPLES]).withColumnRenamed("doc_id", "__example")
    own = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").where("text is not null")
    here = own.select("doc_id").join(F.broadcast(likely), F.col("doc_id") == F.col("__example")).select("doc_id", "toxic").distinct()
    # only numbers go through the limits, which have one task
    chosen = first(here, MAX_EXAMPLES).withColumnRenamed("doc_id", "__example")
    texts = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("__example")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    with shuffles_freed(docs.sparkSession):
        return texts.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).checkpoint()


def _example_features(batches):
    forget_others("toxicity")
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            rows, h, n = features_of(part.column("text"))
            cut = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v)) for v in (h.view(np.int64), n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], ["doc_id", "toxic", "feature", "n"])


def _frequencies(hashes):
    def run(batches):
        known = process_cache("toxicity-model", lambda: FeatureTable(hashes.value[1]), hashes.value[0] + " features")
        df, n = np.zeros(len(known.hashes), np.int64), 0
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                text = part.column("text").drop_null()
                n += len(text)
                df += np.bincount(known.counts(text)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"feature": np.concatenate(([-1], some)).astype(np.int64), "n": np.concatenate(([n], df[some])).astype(np.int64)})

    return run


class Model:
    """What scoring needs: features, their weights, indexed examples and the calibration."""

    def __init__(self, hashes, factor, index, ids, toxic):
        self.table = FeatureTable(hashes)
        self.factor, self.index, self.ids, self.toxic = factor, index, ids, toxic
        self.borders = self.values = np.zeros(0)
        self.place = {}
        for i, d in enumerate(ids.tolist()):
            self.place.setdefault(d, []).append(i)

    def probability(self, v: float) -> float:
        return float(self.values[max(0, np.searchsorted(self.borders, round(v, DIGITS) + 1e-9) - 1)]) if len(self.values) else 0.0

    def nearest(self, ids: list, text: pa.Array):
        """(examples, cosines) of each row."""
        rows, feature, n = self.table.counts(text)
        weight = unit_weights(rows, feature, n, self.factor, len(text))
        cut = np.searchsorted(rows, np.arange(len(text) + 1))
        for a in range(0, len(ids), BATCH):
            part = cut[a : min(a + BATCH, len(ids)) + 1]
            f = slice(part[0], part[-1])
            yield from self.index.search(part - part[0], feature[f], weight[f], K, [self.place.get(d, ()) for d in ids[a : a + BATCH]])

    def score(self, ids: list, text: pa.Array) -> list[tuple[float, list]]:
        """(score, neighbours) of each row."""
        out = []
        for near, cosine in self.nearest(ids, text):
            p = self.probability(vote(self.toxic[near], cosine))
            out.append((p, [{"doc_id": int(self.ids[i]), "cosine": float(c), "toxic": int(self.toxic[i])} for i, c in zip(near, cosine)]))
        return out


def significance(with_feature, toxic_with, n, n_toxic) -> np.ndarray:
    """Factor of each feature, of how many examples have it and how many toxic ones do."""
    p = n_toxic / n
    expected = with_feature * p
    chi = (toxic_with - expected) ** 2 / np.maximum(with_feature * p * (1 - p), 1e-9)
    return FLOOR + np.where(toxic_with > expected, chi / (chi + HALF), 0.0)


def _model(parts, calibration=None) -> Model:
    """The model of a Python worker; the same one votes on examples and scores."""
    version, *arrays = parts.value
    m = process_cache("toxicity-model", lambda: Model(*arrays), version)
    if calibration is not None:
        m.borders, m.values = calibration
    return m


def _votes(parts):
    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                m = _model(parts)
                out = [vote(m.toxic[near], cosine) for near, cosine in m.nearest(part.column("doc_id").to_pylist(), part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(out, pa.float64())], ["toxic", "vote"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple:
    """(broadcast parts of a Model, calibration): examples are bounded, corpus frequencies cover every document.

    The driver only numbers the features of the examples; their votes are found by executors.
    """
    spark = docs.sparkSession
    examples = sample_examples(docs, labels)
    with shuffles_freed(spark):
        got = examples.mapInArrow(_example_features, "doc_id long, toxic int, feature array<long>, n array<int>").toArrow().sort_by("doc_id").combine_chunks()
        labelled = {r["toxic"]: r["count"] for r in known_labels(labels).groupBy("toxic").count().collect()}
    ids, toxic = (np.asarray(got.column(c)).astype(np.int64) for c in ("doc_id", "toxic"))
    version = str(uuid.uuid4())
    if not (toxic == 0).any() or not (toxic == 1).any():
        none = np.zeros(0, int)
        return spark.sparkContext.broadcast((version, np.zeros(0, np.uint64), np.zeros(0), ExampleIndex(0, 0, none, none, np.zeros(0)), none, none)), (np.zeros(0), np.zeros(0))
    lists = [got.column(c).combine_chunks() for c in ("feature", "n")]
    example = np.repeat(np.arange(len(ids), dtype=np.int32), np.asarray(pc.list_value_length(lists[0])))
    n = np.asarray(lists[1].flatten()).astype(np.int32)
    h = np.asarray(lists[0].flatten()).view(np.uint64)
    hashes = np.unique(h)
    feature = np.searchsorted(hashes, h).astype(np.int32)
    del got, lists, h
    known = spark.sparkContext.broadcast((version, hashes))
    with shuffles_freed(spark):
        found = docs.select("text").mapInArrow(_frequencies(known), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    f, c = (np.asarray(found.column(k)).astype(np.int64) for k in ("feature", "n"))
    df, total = np.zeros(len(hashes)), int(c[f < 0].sum())
    df[f[f >= 0]] = c[f >= 0]
    del found, f, c
    known.destroy()
    idf = np.log((1 + total) / (1 + df)) + 1
    with_feature = np.bincount(feature, minlength=len(hashes))
    factor = idf * significance(with_feature, np.bincount(feature, toxic[example], minlength=len(hashes)), len(ids), int(toxic.sum()))
    weight = unit_weights(example, feature, n, factor, len(ids)).astype(np.float32)
    index = ExampleIndex(len(ids), len(hashes), feature, example, weight)
    del feature, example, n, weight
    parts = spark.sparkContext.broadcast((version, hashes, factor, index, ids, toxic))
    with shuffles_freed(spark):
        votes = examples.mapInArrow(_votes(parts), "toxic int, vote double").toPandas()
    y = votes["toxic"].to_numpy().astype(np.int64)
    stands = np.array([labelled.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)])
    return parts, isotonic(votes["vote"].to_numpy(), y.astype(float), stands[y])


def _scored(parts, calibration, threshold, keep):
    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                m = _model(parts, calibration)
                text = part.column("text").fill_null("")
                got = m.score(part.column("__id" if keep else "doc_id").to_pylist(), text)
                if keep:
                    yield part.filter(pa.array([p < threshold for p, _ in got], pa.bool_())).select([i for i, c in enumerate(part.schema.names) if c != "__id"])
                    continue
                near = pa.array([n for _, n in got], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))
                score = [p for p, _ in got]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64()), pa.array([p >= threshold for p in score], pa.bool_()), near], ["doc_id", "score", "toxic", "neighbours"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic, neighbours) of every row."""
    model = fit(docs, labels)
    schema = "doc_id long, score double, toxic boolean, neighbours array<struct<doc_id: long, cosine: double, toxic: int>>"
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(_scored(*model, threshold, False), schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, with all their columns."""
    model = fit(docs, labels)
    return docs.withColumn("__id", F.col("doc_id").try_cast("long")).mapInArrow(_scored(*model, threshold, True), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
