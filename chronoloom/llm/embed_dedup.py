"""Embedding near-dedup by collision counting over one-dimensional projections.

Every vector is projected to COUNTED random lines. Sorted along a line, the neighbours of a vector
within a window centred on it collide with it; pairs with enough collisions are compared exactly.
The half-width of the window and the count come from the wanted recall: on a bounded sample, vectors
are paired with others exactly at the threshold, and the count is the largest that RECALL of these
pairs reach.

Counting among all pairs would be quadratic, so lines also cut space: `tables` times, vectors that
lie on the same sides of the medians of `sides` other lines make up a region. How many lines and
tables depends on the number of vectors and on the measured share of pairs at the threshold that
stay on one side; both grow slowly (with 0.05 apart in 64 dimensions: 8 lines and about 10 tables for
50,000 vectors, 22 and about 50 for a thousand million). What goes to regions is small: projections
of one byte each and the sides of all tables, no vectors. Only vectors with enough collisions with
another one in a region send themselves there. A pair counts in the first table in which it shares
a region. A region of many vectors is cut into blocks, and a task compares two blocks.

Defined results: a row for each vec_id that isn't null (for each different vector of it).
Null vectors, vectors with null, NaN or infinite parts, of length zero, or of another dimension than
most have no links. Equal vectors are one vector, held by n_copies rows. vec_id must be a whole number
(or castable to long; else it is null). Where most vectors are empty, no vector has links. Other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions, shuffles_freed, table
from .jaccard_join import LINKS, MAX_BROADCAST_ROWS, _by_region, _gathered, components, merge

THRESHOLD = 0.95
RECALL = 0.995
COUNTED = 48
#: Half-width of a window, in standard deviations of a pair at the threshold; projections have STEPS steps in it.
WINDOW, STEPS = 1.0, 8
#: Vectors that a region should have.
REGION_ROWS = 256
#: Vectors of a block of a region.
BLOCK = 2048
#: Bound of the sample for medians and calibration.
SAMPLE_ROWS = 2048
#: Bytes up to which a side is broadcast.
MAX_BROADCAST_BYTES = 8_000_000
SEED = 5


def unit_rows(batch, name="embedding", id_name="vec_id", dimension=None):
    """(ids, unit vectors) of the usable rows of a batch."""
    ids, vectors = batch.column(id_name), batch.column(name)
    keep = [i for i, v in enumerate(vectors.to_pylist()) if v is not None and ids[i].is_valid and len(v) == dimension and None not in v]
    x = np.array([vectors[i].values.to_numpy(zero_copy_only=False) for i in keep], np.float64).reshape(len(keep), dimension)
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return np.array([ids[i].as_py() for i in keep], np.int64)[ok], x[ok] / norm[ok, None]


def common_dimension(vectors: DataFrame, name="embedding") -> tuple[int, int]:
    """(number of vectors, the most frequent dimension)."""
    got = vectors.where(F.col(name).isNotNull()).groupBy(F.size(name).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).take(1)
    return (got[0]["count"], got[0]["d"]) if got else (0, 0)


def _lines(dimension, count, seed):
    a = np.random.default_rng(seed).normal(size=(dimension, count))
    return a / np.linalg.norm(a, axis=0)


def plan(x: np.ndarray, rows: int, threshold: float, recall: float) -> dict:
    """Medians, widths and counts for so many vectors like the sample x."""
    dimension = x.shape[1]
    sides = max(0, math.ceil(math.log2(max(1, rows / REGION_ROWS))))
    far = np.random.default_rng(SEED).normal(size=x.shape)
    far -= (far * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(far, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * far / np.where(norm > 0, norm, 1)
    step = WINDOW * math.sqrt(2 * (1 - threshold)) / math.sqrt(dimension) / STEPS or 1.0
    counted = _lines(dimension, COUNTED, SEED + 3)
    collisions = (np.abs(projected(x @ counted, step).astype(int) - projected(y @ counted, step)) <= STEPS).sum(1)
    need = int(np.floor(np.quantile(collisions, 1 - recall))) if len(x) else 1
    shape = {"step": step, "need": max(1, need), "counted": counted}
    if not sides:  # one region
        return shape | {"sides": 0, "tables": 1, "lines": np.zeros((dimension, 0)), "medians": np.zeros(0)}
    lines = _lines(dimension, 512, SEED + 1)
    medians = np.median(x @ lines, axis=0)
    # whole codes of pairs at the threshold, of which many are made from these lines
    same = ((x @ lines >= medians) == (y @ lines >= medians))
    groups = same[:, : 512 // sides * sides].reshape(len(x), -1, sides).all(2)
    together = min(0.999, max(0.01, float(groups.mean())))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - together))
    lines = _lines(dimension, sides * tables, SEED + 2)
    return shape | {"sides": sides, "tables": tables, "lines": lines, "medians": np.median(x @ lines, axis=0)}


def projected(h: np.ndarray, step: float) -> np.ndarray:
    """Projections in steps, one byte each; those at the ends of the byte count as equal."""
    return np.clip(np.rint(h / step), -127, 127).astype(np.int8)


def codes_of(x: np.ndarray, how: dict) -> np.ndarray:
    """(vector, table): the sides on which a vector lies, as bits."""
    side = (x @ how["lines"] >= how["medians"]).reshape(len(x), how["tables"], how["sides"])
    return (side @ (np.uint64(1) << np.arange(how["sides"], dtype=np.uint64))).astype(np.uint64)


def _spread(dimension, model, only_keys):
    def run(batches):
        """A row for each table with the region in which a vector lies; equal vectors of a task are one."""
        how = model.value
        seen: set = set()
        for batch in batches:
            ids, x = unit_rows(batch, id_name="id", dimension=dimension)
            if not only_keys:
                new = [i for i, d in enumerate(ids.tolist()) if d not in seen and not seen.add(d)]
                ids, x = ids[new], x[new]
                if len(seen) > 500_000:
                    seen.clear()
            for a in range(0, len(ids), 4096):
                codes = codes_of(x[a : a + 4096], how)
                if only_keys:
                    for t in range(how["tables"]):
                        u, n = np.unique(codes[:, t], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t, np.int32)), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])
                    continue
                own, all_codes = [v.tobytes() for v in projected(x[a : a + 4096] @ how["counted"], how["step"])], [c.tobytes() for c in codes]
                for t in range(how["tables"]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), t, np.int32)), pa.array(codes[:, t].copy().view(np.int64)), pa.array(ids[a : a + 4096]), pa.array(all_codes, pa.binary()), pa.array(own, pa.binary())], ["kind", "key", "id", "codes", "h"])

    return run


def count_collisions(h: np.ndarray, window: float, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Collisions of the vectors `rows` with the vectors `cols`, by sorted projections."""
    counts = np.zeros((len(rows), len(cols)), np.int8)
    r = np.arange(len(rows))
    for k in range(h.shape[1]):
        order = np.argsort(h[cols, k], kind="stable")
        line = h[cols, k][order].astype(np.int16)
        mine = h[rows, k].astype(np.int16)
        lo, hi = np.searchsorted(line, mine - window), np.searchsorted(line, mine + window, side="right")
        marks = np.zeros((len(rows), len(cols) + 1), np.int8)
        marks[r, lo] += 1
        np.subtract.at(marks, (r, hi), 1)
        counts[:, order] += np.cumsum(marks[:, :-1], axis=1, dtype=np.int8)
    return counts


def _blocks(mark, cross, size=256):
    """(rows, columns) index arrays of the pairs that a task compares."""
    if cross:
        rows, cols = np.flatnonzero(mark == mark[0]), np.flatnonzero(mark != mark[0])
    else:
        rows = cols = np.arange(len(mark))
    for i in range(0, len(rows), size):
        yield rows[i : i + size], cols if cross else cols[i:]


def _first_here(codes, table_no, i, j):
    """Whether pairs share no region of an earlier table."""
    ok = np.ones(len(i), bool)
    for t in range(table_no):
        ok &= codes[i, t] != codes[j, t]
    return ok


def _candidates(need):
    def close(region, rows):
        """Vectors of a region with enough collisions with another one that they are to meet there."""
        t, key, lo, hi = region
        ids = list(rows)
        mark = np.array([rows[d][0] for d in ids])
        codes = np.array([np.frombuffer(rows[d][1], np.uint64) for d in ids])
        h = np.array([np.frombuffer(rows[d][2], np.int8) for d in ids])
        live = np.zeros(len(ids), bool)
        for r, c in _blocks(mark, lo != hi):
            if not len(c):
                continue
            i, j = np.nonzero(count_collisions(h, STEPS, r, c) >= need)
            i, j = r[i], c[j]
            some = (i != j) & ~(live[i] & live[j])
            i, j = i[some], j[some]
            ok = _first_here(codes, t, i, j)
            live[i[ok]] = live[j[ok]] = True
        got = [ids[i] for i in np.flatnonzero(live)]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(got), pa.int32()), pa.array([key] * len(got), pa.int64()), pa.array(got, pa.int64())], ["kind", "key", "id"])

    return _gathered(_by_region(("mark", "codes", "h"), close))


def _verified(dimension, threshold, model, as_pairs):
    def pairs(region, rows):
        """(ids, arrays (i, j, cosine)) of the pairs at the threshold in this region."""
        t, _, lo, hi = region
        ids = np.array(sorted(rows), np.int64)
        mark = np.array([rows[d][0] for d in ids.tolist()])
        x = np.array([np.frombuffer(rows[d][1], np.float64) for d in ids.tolist()]).reshape(len(ids), dimension)
        codes = codes_of(x, model.value)

        def found():
            for r, c in _blocks(mark, lo != hi):
                cosine = x[r] @ x[c].T
                i, j = np.nonzero(cosine >= threshold)
                s, i, j = cosine[i, j], r[i], c[j]
                ok = i < j if lo == hi else np.ones(len(i), bool)
                ok[ok] = _first_here(codes, t, i[ok], j[ok])
                if ok.any():
                    yield i[ok], j[ok], s[ok]

        return ids, found()

    def links(region, rows):
        ids, found = pairs(region, rows)
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j, _ in found:
            n += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            label = merge(label, i, j)
        some = n > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[some], n[some], ids[label[some]])], ["id", "n", "root"])

    def listed(region, rows):
        ids, found = pairs(region, rows)
        for i, j, s in found:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[i], ids[j], s)], ["id_a", "id_b", "cosine"])

    return _gathered(_by_region(("mark", "x"), listed if as_pairs else links))


def _payload(dimension):
    def run(batches):
        for batch in batches:
            ids, x = unit_rows(batch, id_name="id", dimension=dimension)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "x"])

    return run


def _sample(vectors: DataFrame, dimension: int):
    got = vectors.where(F.size("embedding") == dimension).orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE_ROWS).toArrow()
    parts = [unit_rows(b, id_name="id", dimension=dimension)[1] for b in got.to_batches()]
    return np.concatenate(parts) if parts else np.zeros((0, dimension))


def _joined(vectors: DataFrame, threshold: float, recall: float, as_pairs: bool):
    """(documents, found): (doc_id, id) of each row and its vector; pairs or LINKS of vectors. found is None if there can't be any."""
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").try_cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    own = own.withColumn("id", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding", F.size("embedding"), F.transform("embedding", lambda x: x.isNull()))))
    rows = checkpointed(own.select(F.col("vec_id").alias("doc_id"), "id").distinct())
    count, dimension = common_dimension(own)
    sample = _sample(own, dimension) if dimension > 0 else ()
    if not len(sample):
        return rows, None
    how = plan(sample, count, threshold, recall)
    model = spark.sparkContext.broadcast(how)
    usable = own.where(F.size("embedding") == dimension).select("id", "embedding")
    counted = usable.mapInArrow(_spread(dimension, model, True), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    big = checkpointed(counted.where(F.col("n") > BLOCK).select("kind", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    many = big.count()
    parts = shuffle_partitions(spark)

    def at_regions(df, *columns):
        """Rows at every pair of blocks in which they are to be compared, sorted."""
        if many:
            df = df.join(F.broadcast(big) if 40 * many <= MAX_BROADCAST_BYTES else big, ["kind", "key"], "left")
            blocks = F.coalesce("blocks", F.lit(1))
            df = df.withColumn("mark", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        else:
            df = df.withColumn("mark", F.lit(0)).withColumn("other", F.lit(0))
        df = df.select("kind", "key", F.least("mark", "other").alias("lo"), F.greatest("mark", "other").alias("hi"), "id", "mark", *columns)
        return df.repartition(parts, "kind", "key", "lo", "hi").sortWithinPartitions("kind", "key", "lo", "hi")

    placed = at_regions(usable.mapInArrow(_spread(dimension, model, False), "kind int, key long, id long, codes binary, h binary"), "codes", "h")
    live = checkpointed(placed.mapInArrow(_candidates(how["need"]), "kind int, key long, id long").distinct())
    # one row for each vector that is live somewhere; copies of a vector send one
    first = rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("vec_id"))
    wanted = live.groupBy("id").agg(F.collect_list(F.struct("kind", "key")).alias("regions")).join(first, "id")
    wanted = checkpointed(wanted)
    n, keys = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("regions")), F.lit(0))).first()
    wanted = F.broadcast(wanted) if 60 * n + 16 * keys <= MAX_BROADCAST_BYTES else wanted
    sent = own.where(F.size("embedding") == dimension).join(wanted, ["id", "vec_id"]).select("id", "embedding", "regions")
    shipped = sent.select("id", "embedding").mapInArrow(_payload(dimension), "id long, x binary").join(wanted.select("id", "regions"), "id")
    each = shipped.select("id", "x", F.explode("regions").alias("r")).select("id", "x", "r.*")
    schema = "id_a long, id_b long, cosine double" if as_pairs else LINKS
    return rows, at_regions(each, "x").mapInArrow(_verified(dimension, threshold, model, as_pairs), schema)


def embedding_pairs(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_a < vec_b, cosine) of different vectors near each other; of equal ones the smallest vec_id stands for all."""
    rows, found = _joined(vectors, threshold, recall, True)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_a long, vec_b long, cosine double")
    first = rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("d"))
    a, b = (first.select(F.col("id").alias(f"id_{k}"), F.col("d").alias(f"d_{k}")) for k in "ab")
    named = found.join(a, "id_a").join(b, "id_b").where("d_a <> d_b")
    return named.select(F.least("d_a", "d_b").alias("vec_a"), F.greatest("d_a", "d_b").alias("vec_b"), "cosine")


def embedding_classes(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, class_id, n_links, n_copies): a row for each vec_id, or each of its vectors.

    A class is what links connect; class_id is its smallest vec_id. n_links counts the other vectors
    within the threshold, n_copies the rows with the same vector, this one too (0 for null).
    """
    rows, found = _joined(vectors, threshold, recall, False)
    sets = rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    if found is None:
        sets = sets.select("id", F.col("first").alias("class_id"), F.lit(0).alias("n_links"), "n_copies")
    else:
        found = checkpointed(found)
        with shuffles_freed(vectors.sparkSession):
            group = components(found.select(F.col("id").alias("doc_a"), F.col("root").alias("doc_b"))).select(F.col("doc_id").alias("id"), F.col("group_id").alias("g"))
        links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
        sets = checkpointed(sets.join(links.join(group, "id"), "id", "left").withColumn("g", F.coalesce("g", "id")))
        smallest = sets.where("n_links is not null").groupBy("g").agg(F.min("first").alias("smallest"))
        sets = sets.join(smallest, "g", "left").select("id", F.coalesce("smallest", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    every = rows.join(sets, "id", "left")
    return every.select(F.col("doc_id").alias("vec_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"))


def drop_near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `vectors` without those whose class has a smaller vec_id; all columns stay."""
    gone = checkpointed(embedding_classes(vectors, threshold).where("vec_id <> class_id").select(F.col("vec_id").alias("__gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone
    return vectors.join(gone, vectors["vec_id"].try_cast("long") == gone["__gone"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return embedding_classes(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, min(vec_id) OVER (PARTITION BY embedding) AS rep, count(*) OVER (PARTITION BY embedding) AS n_copies
  FROM (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL) q),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.rep = a.vec_id AND b.rep = b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM e WHERE rep = vec_id UNION SELECT reach.x, p.y FROM reach JOIN p ON p.x = reach.y),
class AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
links AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(class_id, vec_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, CASE WHEN v IS NULL THEN 0 ELSE n_copies END::BIGINT AS n_copies
FROM e LEFT JOIN class ON class.x = rep LEFT JOIN links ON links.x = rep
"""
