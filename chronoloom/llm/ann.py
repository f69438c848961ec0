"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word from each of CODEBOOKS full-dimensional codebooks. Codebooks start
as k-means of residuals and are refitted by least squares; encoding keeps the BEAM best partial
sums at each codebook. Squared norms of the sums are stored, so that the score of a query and a code
is a sum of CODEBOOKS look-ups in a table of the query's products with all words, and the SHORTLIST
best are compared exactly. The length of what a code leaves of its vector is stored too; it bounds
the cosine, and all codes whose bound reaches the k-th exact cosine are compared exactly as well. So
a block is searched exactly, also where the codes can't rank its vectors (near copies).

Coarse cells keep it from reading everything for each query: a vector is stored in the cell of its
nearest centre and asks in its nearest `probes` cells. How many are needed depends on the data, so
they are counted on calibration queries against all vectors: the least number of cells that hold
TARGET of their true neighbours. Where vectors are clustered these are few; where they have no
structure nearly all. The model is fitted on a bounded sample (TRAIN_ROWS), every vector is indexed.
Cells of more than CELL_ROWS vectors are cut into blocks, each of which is asked, so no task holds
more than a block, however many near copies there are.

`query` asks with the vectors whose vec_id is divisible by 100, against all vectors; without
`asking`, every vector asks.

Defined results: similarity is the cosine. Null vectors, vectors with null, NaN or infinite parts,
of length zero, or of another dimension than most, and null vec_ids take no part; where most vectors
are empty there are no neighbours. vec_id must be a whole number (or castable to long; else it is
null). A vector is no neighbour of its own vec_id; of repeated vec_ids the nearest row counts. Ties
go to the smaller vec_id. Fewer than k vectors give fewer neighbours. Other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, process_cache, segments, shuffle_partitions, table
from .embed_dedup import common_dimension, unit_rows

K = 10
CODEBOOKS, WORDS, BEAM = 8, 256, 6
SHORTLIST = 160
#: For rounding, above bounds; products of a block of queries and a cell's vectors.
SLACK, PRODUCTS = 1e-5, 1 << 22
CELL_ROWS = 4096
#: Bounds of the samples for training and calibration.
TRAIN_ROWS, CALIBRATION_ROWS = 16384, 256
#: Most cells: a centre needs some vectors of the sample. Beyond, cells have more blocks.
MAX_CELLS = 512
#: A row id divisible by this asks, in the registered query.
ASKING = 100
TARGET = 0.985
SEED = 11


def kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]))])
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Quantiser:
    """Codebooks with the products among their words."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.m, self.words, self.dimension = books.shape
        flat = books.reshape(-1, self.dimension)
        self.cross = (flat @ flat.T).reshape(self.m, self.words, self.m, self.words)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of the rows of x: at each codebook the best partial sums survive."""
        n = len(x)
        codes = np.zeros((n, 1, self.m), np.uint8)
        cost = np.zeros((n, 1))
        for k in range(self.m):
            base = (self.books[k] ** 2).sum(1)[None] - 2 * x @ self.books[k].T
            new = cost[:, :, None] + base[:, None, :]
            for j in range(k):
                new += 2 * self.cross[j, codes[:, :, j]][:, :, k]
            wide = new.reshape(n, -1)
            keep = min(beam, wide.shape[1])
            top = np.argpartition(wide, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(wide, top, 1)
            parent, word = top // self.words, top % self.words
            codes = np.take_along_axis(codes, parent[:, :, None], 1)
            codes[:, :, k] = word
        return codes[np.arange(n), cost.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[k][codes[:, k]] for k in range(self.m))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(query, codebook, word): products, for scoring by look-up."""
        return np.einsum("qd,mwd->qmw", queries, self.books).astype(np.float32)


def train_quantiser(x: np.ndarray, rng, rounds: int = 2) -> np.ndarray:
    books, rest = [], x.copy()
    for _ in range(CODEBOOKS):
        b = kmeans(rest, WORDS, 6, rng)
        books.append(b)
        rest = rest - b[np.argmax(rest @ b.T - (b**2).sum(1) / 2, axis=1)]
    books = np.stack(books)
    for _ in range(rounds):
        codes = np.concatenate([Quantiser(books).encode(x[i : i + 512]) for i in range(0, len(x), 512)])
        at = codes.astype(np.int64) + np.arange(CODEBOOKS) * WORDS
        size = CODEBOOKS * WORDS
        gram = np.zeros((size, size))
        for a in range(CODEBOOKS):
            for b in range(CODEBOOKS):
                np.add.at(gram, (at[:, a], at[:, b]), 1)
        right = np.zeros((size, x.shape[1]))
        for a in range(CODEBOOKS):
            np.add.at(right, at[:, a], x)
        gram[np.arange(size), np.arange(size)] += 1e-3
        right += 1e-3 * books.reshape(size, -1)
        books = np.linalg.solve(gram, right).reshape(books.shape)
    return books


def exact_top(queries, query_ids, x, ids, k):
    """Ids and cosines of the k nearest rows of x, for calibration."""
    s = queries @ x.T
    s[query_ids[:, None] == ids[None]] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return ids[top], np.take_along_axis(s, top, 1)


def _sample(vectors: DataFrame, dimension: int, rows: int, seed: int):
    got = vectors.where(F.size("embedding") == dimension).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(rows).toArrow()
    parts = [unit_rows(b, dimension=dimension) for b in got.to_batches()]
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, dimension))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _probes(vectors: DataFrame, dimension: int, centres: np.ndarray, k: int) -> int:
    """The least number of cells that hold TARGET of the true neighbours of calibration queries."""
    ids, q = _sample(vectors, dimension, CALIBRATION_ROWS, SEED + 1)
    if len(centres) < 2 or not len(q):
        return 1

    def run(batches):
        best_s = np.full((len(q), k), -np.inf)
        best_c = np.zeros((len(q), k), np.int64)
        for batch in batches:
            own, x = unit_rows(batch, dimension=dimension)
            for i in range(0, len(own), 2048):
                s = q @ x[i : i + 2048].T
                s[ids[:, None] == own[None, i : i + 2048]] = -np.inf
                cell = np.argmax(x[i : i + 2048] @ centres.T, axis=1)
                s, c = np.concatenate([best_s, s], 1), np.concatenate([best_c, np.tile(cell, (len(q), 1))], 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best_s, best_c = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
        r = np.repeat(np.arange(len(q)), k)
        ok = np.isfinite(best_s.ravel())
        yield pa.RecordBatch.from_pydict({"q": r[ok], "s": best_s.ravel()[ok], "cell": best_c.ravel()[ok]})

    got = vectors.mapInArrow(run, "q long, s double, cell long").toPandas()
    if not len(got):
        return 1
    got = got.sort_values(["q", "s"], ascending=[True, False]).groupby("q").head(k)
    rank = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)
    need = np.sort(rank[got["q"].to_numpy(), got["cell"].to_numpy()])
    return int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))) - 1)]) + 1


def _cell_sizes(centres, dimension):
    def run(batches):
        """How many vectors of each batch lie in each cell."""
        for batch in batches:
            _, x = unit_rows(batch, dimension=dimension)
            n = np.bincount(np.argmax(x @ centres.value.T, axis=1), minlength=len(centres.value)) if len(x) else np.zeros(1, np.int64)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(n[some].astype(np.int64))], ["cell", "n"])

    return run


def _place(model, probes, dimension, asking):
    def run(batches):
        """Packed rows of stored vectors (kind 0) and of queries (kind 1) by block of a cell."""
        version, centres, books, blocks, starts = model.value
        quantiser = process_cache("ann-quantiser", lambda: Quantiser(books), version)
        for batch in batches:
            all_ids, all_x = unit_rows(batch, dimension=dimension)
            for i in range(0, len(all_ids), 2048):
                ids, x = all_ids[i : i + 2048], all_x[i : i + 2048]
                codes = np.concatenate([quantiser.encode(x[j : j + 128]) for j in range(0, len(x), 128)])
                decoded = quantiser.decode(codes)
                norms = (decoded**2).sum(1).astype(np.float32)
                errors = np.linalg.norm(x - decoded, axis=1).astype(np.float32)
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
                home = starts[near[:, 0]] + (mix(ids.view(np.uint64)) % blocks[near[:, 0]].astype(np.uint64)).astype(np.int64)
                asks = np.flatnonzero(ids % asking == 0)
                who = np.repeat(asks, blocks[near[asks]].sum(1))
                where = segments(starts[near[asks]].ravel(), blocks[near[asks]].ravel())
                out = {k: [] for k in ("cell", "kind", "ids", "x", "codes", "norms", "errors")}
                for kind, rows, cells in ((0, np.arange(len(ids)), home), (1, who, where)):
                    by = np.argsort(cells, kind="stable")
                    edge = np.flatnonzero(np.diff(cells[by], prepend=-1, append=1 << 60))
                    for a, b in zip(edge[:-1], edge[1:]):
                        c, sel = cells[by[a]], rows[by[a:b]]
                        row = (int(c), kind, ids[sel].tobytes(), x[sel].astype(np.float32).tobytes(), codes[sel].tobytes() if not kind else b"", norms[sel].tobytes() if not kind else b"", errors[sel].tobytes() if not kind else b"")
                        for k, v in zip(out, row):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("cell", pa.int64()), ("kind", pa.int32()), *((k, pa.binary()) for k in ("ids", "x", "codes", "norms", "errors"))]))

    return run


def widen(near, cosine, possible, own, ids, x, queries, k):
    """Exact cosines of all possible rows, in place of the k found."""
    repeated = len(np.unique(ids)) < len(ids)
    wide = np.flatnonzero(possible.any(1))
    cols = np.flatnonzero(possible[wide].any(0))
    s = queries[wide] @ x[cols].T
    s[own[np.ix_(wide, cols)]] = -np.inf
    for r, row in zip(wide, s):
        least = np.partition(row, -k)[-k] - SLACK if len(row) > k and not repeated else -np.inf
        c = cols[np.flatnonzero((row >= least) & np.isfinite(row))]
        exact = np.einsum("d,sd->s", queries[r], x[c])
        order = np.lexsort((ids[c], -exact))
        if repeated:
            order = order[np.sort(np.unique(ids[c][order], return_index=True)[1])]
        order = order[:k]
        near[r, : len(order)], cosine[r, : len(order)] = ids[c][order], exact[order]
        cosine[r, len(order) :] = -np.inf


def search_cell(quantiser, ids, x, codes, norms, errors, query_ids, queries, k, shortlist):
    """The k nearest of a cell's vectors for each query: look-ups, shortlist, exact cosines."""
    tables = quantiser.tables(queries)
    products = np.zeros((len(queries), len(ids)), np.float32)
    for m in range(codes.shape[1]):
        products += tables[:, m][:, codes[:, m]]
    own = query_ids[:, None] == ids[None]
    # the vector with the smallest distance to a query of unit length
    score = products - norms / 2
    score[own] = -np.inf
    take = min(max(shortlist, k), len(ids))
    short = np.argpartition(-score, take - 1, axis=1)[:, :take]
    exact = np.einsum("qd,qsd->qs", queries, x[short])
    exact[query_ids[:, None] == ids[short]] = -np.inf
    order = np.lexsort((ids[short], -exact), axis=1)
    if len(np.unique(ids)) < len(ids):
        # the nearest row of each vec_id comes first, its other rows go last
        for r, row in enumerate(ids[short]):
            later = np.ones(take, bool)
            later[np.unique(row[order[r]], return_index=True)[1]] = False
            exact[r, order[r][later]] = -np.inf
        order = np.lexsort((ids[short], -exact), axis=1)
    order = order[:, :k]
    near, cosine = np.take_along_axis(ids[short], order, 1), np.take_along_axis(exact, order, 1)
    if take < len(ids):
        # no cosine is above these: by the product with what a code leaves, by the triangle inequality
        bound = 1 - np.maximum(np.sqrt(np.maximum(1 - 2 * products + norms, 0)) - errors, 0) ** 2 / 2
        possible = np.minimum(bound, products + errors) + SLACK >= cosine[:, -1:]
        possible[own] = False
        left = possible.copy()
        np.put_along_axis(left, short, False, 1)
        np.put_along_axis(possible, short, True, 1)
        possible[~left.any(1)] = False
        if left.any():
            widen(near, cosine, possible, own, ids, x, queries, k)
    return near, cosine


def without_copies(ids, *rest):
    """The arrays without repeated rows: the same vec_id with the same vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, *rest
    seen = {}
    for i, (d, v) in enumerate(zip(ids.tolist(), rest[0])):
        seen.setdefault((d, v.tobytes()), i)
    keep = np.fromiter(seen.values(), np.int64)
    return ids[keep], *(r[keep] for r in rest)


def _search(model, dimension, k, shortlist):
    def run(group: pa.Table) -> pa.Table:
        version, books = model.value[0], model.value[2]
        quantiser = process_cache("ann-quantiser", lambda: Quantiser(books), version)
        base = {"ids": [], "x": [], "codes": [], "norms": [], "errors": []}
        asked = []
        for r in group.to_pylist():
            if r["kind"]:
                asked.append((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"], np.float32).reshape(-1, dimension)))
            else:
                for name, kind, shape in (("ids", np.int64, -1), ("x", np.float32, (-1, dimension)), ("codes", np.uint8, (-1, CODEBOOKS)), ("norms", np.float32, -1), ("errors", np.float32, -1)):
                    base[name].append(np.frombuffer(r[name], kind).reshape(shape))
        out_ids, near, cosine = [], [], []
        if base["ids"]:
            ids, x, codes, norms, errors = without_copies(*(np.concatenate(v) for v in base.values()))
            for query_ids, queries in asked:
                step = max(1, min(128, PRODUCTS // len(ids)))
                for i in range(0, len(queries), step):
                    q = slice(i, i + step)
                    a, b = search_cell(quantiser, ids, x, codes, norms, errors, query_ids[q], queries[q], k, shortlist)
                    out_ids += query_ids[q].tolist()
                    near += [n[np.isfinite(c)].tolist() for n, c in zip(a, b)]
                    cosine += [c[np.isfinite(c)].astype(np.float64).tolist() for c in b]
        return pa.table([pa.array(out_ids, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(cosine, pa.list_(pa.float64()))], ["vec_id", "near", "cosine"])

    return run


def nearest_neighbours(vectors: DataFrame, k: int = K, shortlist: int = SHORTLIST, asking: int = 1) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine): the k nearest, rank from 1, of the vectors whose vec_id is divisible by asking."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").try_cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    rows, dimension = common_dimension(vectors)
    if dimension <= 0:
        return spark.createDataFrame([], "vec_id long, rank long, neighbour_id long, cosine double")
    rng = np.random.default_rng(SEED)
    _, sample = _sample(vectors, dimension, TRAIN_ROWS, SEED)
    if not len(sample):
        return spark.createDataFrame([], "vec_id long, rank long, neighbour_id long, cosine double")
    cells = min(MAX_CELLS, max(1, -(-rows // CELL_ROWS)))
    centres = kmeans(sample, cells, 8, rng) if cells > 1 else np.zeros((1, dimension))
    probes = _probes(vectors, dimension, centres, k)
    blocks = np.ones(cells, np.int64)
    for c, n in vectors.mapInArrow(_cell_sizes(spark.sparkContext.broadcast(centres), dimension), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        blocks[c] = max(1, -(-n // CELL_ROWS))
    starts = np.cumsum(blocks) - blocks
    model = spark.sparkContext.broadcast((str(uuid.uuid4()), centres, train_quantiser(sample, rng), blocks, starts))
    placed = vectors.mapInArrow(_place(model, probes, dimension, asking), "cell long, kind int, ids binary, x binary, codes binary, norms binary, errors binary")
    parts = max(shuffle_partitions(spark), min(int(blocks.sum()), 20_000))
    found = placed.repartition(parts, "cell").groupBy("cell").applyInArrow(_search(model, dimension, k, shortlist), "vec_id long, near array<long>, cosine array<double>")
    pair = F.transform(F.arrays_zip("near", "cosine"), lambda p: F.struct((-p["cosine"]).alias("s"), p["near"].alias("n")))
    best = found.groupBy("vec_id").agg(F.array_sort(F.flatten(F.collect_list(pair))).alias("p"))
    # of a repeated neighbour the nearest row stays
    every = F.transform("p", lambda x: x["n"])
    top = best.select("vec_id", "p", every.alias("every"), F.slice(F.array_distinct(every), 1, k).alias("top"))
    one = top.select("vec_id", "p", "every", F.posexplode("top").alias("rank", "neighbour_id"))
    cosine = -F.element_at("p", F.array_position("every", F.col("neighbour_id")).cast("int"))["s"]
    return one.select("vec_id", (F.col("rank") + 1).cast("long").alias("rank"), "neighbour_id", cosine.alias("cosine"))


def query(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), asking=ASKING)
