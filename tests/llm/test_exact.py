"""Operators without SQL against brute force, round trips and held-out labels."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import ann, bpe, embed_dedup, jaccard_join, line_dedup, token_counts, toxicity
from chronoloom.llm.common import table
from ..oracle import SF_DIR
from . import brute, messy


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*bpe.load_vocabulary()[1:])


@pytest.fixture(scope="module")
def reference():
    return brute.encoding()


ODD = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'abcdestlvrm019.,!_-ÀéñßĀ漢字  \U0001f600́")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_encoding_and_decoding(codec, reference, text):
    ids = codec.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text) and codec.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_every_prefix_count(codec, reference, text):
    width, changes = token_counts.Units(codec).count(text)
    assert token_counts.counts_of(changes, width).tolist() == [len(reference.encode_ordinary(text[:k])) for k in range(len(text) + 1)]


def test_whole_table_by_the_other_encoder(spark, reference):
    docs = table(spark, SF_DIR, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    encoded = bpe.encode_documents(docs)
    got = encoded.collect()
    assert len(got) == len(text) and all(r.ids == reference.encode_ordinary(text[r.doc_id]) and r.exact for r in got)
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded).collect()} == text
    for r in token_counts.prefix_token_counts(docs).collect():
        t = text[r.doc_id]
        assert r.n_tokens == len(reference.encode_ordinary(t)) and r.n_chars == len(t)
        counts = token_counts.counts_of(r.changes, r.width)
        for k in random.Random(r.doc_id).sample(range(len(t) + 1), min(8, len(t))):
            assert counts[k] == len(reference.encode_ordinary(t[:k])) == token_counts.tokens_at(r.changes, r.width, k)
        for b in token_counts.BUDGETS:
            assert r[f"chars_in_{b}"] == max(k for k in range(len(t) + 1) if counts[k] <= b)


def test_budgets_of_texts_with_more_tokens_than_characters(spark, reference):
    texts = [c * n for c in ("안녕하세요 세계 ", "สวัสดีชาวโลก ", "\U0001f9ec\U0001fae0", "日本語の文章です。", "ꙮ") for n in (1, 40, 60, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    budgets, more = (10, 512, 2048), 0
    for r in token_counts.prefix_token_counts(docs, budgets=budgets).collect():
        t = texts[r.doc_id]
        more += r.n_tokens > r.n_chars
        counts = token_counts.counts_of(r.changes, r.width)
        assert r.n_tokens == len(reference.encode_ordinary(t))
        for b in budgets:
            k = r[f"chars_in_{b}"]
            assert k == max(i for i, n in enumerate(counts.tolist()) if n <= b)
            assert len(reference.encode_ordinary(t[:k])) <= b and (k == len(t) or len(reference.encode_ordinary(t[: k + 1])) > b)
    assert more > 5


def test_decoding_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 5]), (None, [5])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_documents(df).collect()} == {1: None, 2: "", 3: None, None: "&"}


def near_copies(seed, groups=12, copies=9, size=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, k = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, size))]
        for _ in range(rng.randint(1, copies)):
            text = [rng.choice(vocabulary) if rng.random() < rng.choice((0, 0.02, 0.1, 0.25)) else w for w in base]
            rows.append((k, " ".join(text) + rng.choice(("", " ", "\n")), "en", "a", 0))
            k += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_of_near_copies(spark, seed):
    rows = near_copies(seed)
    for threshold, n in ((0.6, 2), (0.3, 1), (0.9, 3)):
        got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_join.jaccard_pairs(messy.docs(spark, rows), threshold, n).collect()}
        assert got == pytest.approx(brute.jaccard_pairs([(r[0], r[1]) for r in rows], threshold, n))


def with_copies(seed):
    rows = near_copies(seed)
    rows += [(len(rows) + i, rows[i % 7][1], "en", "a", 0) for i in range(30)] + [(3, "now " + rows[5][1], "en", "a", 0)]
    return rows


def classes(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_of_near_copies(spark, seed):
    """Links of different texts, copies and classes, against every two documents."""
    rows = with_copies(seed)
    got = classes(jaccard_join.jaccard_classes(messy.docs(spark, rows)))
    assert got == brute.jaccard_classes([(r[0], r[1]) for r in rows]) and max(r[2] for r in got) > 3


def test_classes_without_counts(spark, monkeypatch):
    """The classes of counted links, for bitmaps and sets cut into blocks too."""
    docs = messy.docs(spark, with_copies(4))
    expected = {(r[0], r[1], min(r[2], 1), r[3]) for r in classes(jaccard_join.jaccard_classes(docs))}
    for most in (None, 3):
        if most:
            for name in ("BLOCK", "MAP_BLOCK"):
                monkeypatch.setattr(jaccard_join, name, most)
        got = classes(jaccard_join.jaccard_classes(docs, counted=False))
        assert {(r[0], r[1], min(r[2], 1), r[3]) for r in got} == expected


def test_hot_regions_and_blocks(spark, monkeypatch):
    """Every n-gram hot, regions cut into blocks, sides too large to be broadcast: the same classes."""
    for name, value in (("HOT", 4), ("BLOCK", 3), ("MAX_BROADCAST_BYTES", -1), ("MAX_BROADCAST_ROWS", -1), ("TASK_ENTRIES", 500)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = with_copies(3) * 2
    rows += [(1000 + i, " ".join(f"q{(j * j) % 31} u{j}" if j != i else "other" for j in range(60)), "en", "a", 0) for i in range(40)]
    got = classes(jaccard_join.jaccard_classes(messy.docs(spark, rows)))
    assert got == brute.jaccard_classes([(r[0], r[1]) for r in rows])
    assert {r[2] for r in got if r[0] >= 1000} == {39}


def test_a_large_group_recurses(spark):
    """A region that pivots split: chains of texts that drift apart, with common prints."""
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(base[k : k + 120]), "en", "a", 0) for k in range(280)]
    got = classes(jaccard_join.jaccard_classes(messy.docs(spark, rows)))
    assert got == brute.jaccard_classes([(r[0], r[1]) for r in rows]) and {r[1] for r in got} == {0}


def embedding_classes(x, threshold=embed_dedup.THRESHOLD):
    """Rows of classes of the rows of x, by all cosines."""
    by = {}
    for i, v in enumerate(x):
        by.setdefault(v.tobytes(), set()).add(i)
    names = list(by)
    u = np.array([np.frombuffer(n, x.dtype) for n in names], np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    return brute.classes(by, [(names[i], names[j]) for i, j in zip(a.tolist(), b.tolist())])


def vector_table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("block", [2048, 40])
def test_embedding_classes(spark, monkeypatch, block):
    """Groups of near copies from two to 400, exact copies among them, many without partner."""
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    if block == 40:
        monkeypatch.setattr(embed_dedup, "MAX_BROADCAST_BYTES", -1)
        monkeypatch.setattr(embed_dedup, "REGION_ROWS", 32)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 32))
    sizes = [2, 2, 3, 4, 5, 6, 8, 10, 20, 40, 100, 400]
    groups = [c + 0.12 * rng.normal(size=(n, 32)) for c, n in zip(centres, sizes)]
    x = np.concatenate([*groups, rng.normal(size=(700, 32))]).astype(np.float32)
    x = np.concatenate([x, x[[0, 5, 5, 200, 201, 700]]])[rng.permutation(1306)]
    got, true = classes(embed_dedup.embedding_classes(vector_table(spark, x))), embedding_classes(x)
    assert len(got) == len(true) == 1306
    assert {r[:2] for r in got} == {r[:2] for r in true}
    assert sum(r[2] for r in got) >= 0.99 * sum(r[2] for r in true) > 1000
    own = {r[0]: r for r in true}
    assert all(r[2] <= own[r[0]][2] and r[3] == own[r[0]][3] for r in got)


@pytest.mark.parametrize("seed", [4, 5])
def test_recursion_over_pivots(seed):
    sets = sorted({tuple(sorted({hash(g) % 2**31 for g in brute.grams(r[1])})) for r in near_copies(seed, 40, 12)})
    arrays = [np.array(s, np.uint64) for s in sets]
    got = [(min(p), max(p)) for i, j, _ in jaccard_join.metric_join(arrays, 0.6, small=6, pivots=3) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got))
    got = set(got)
    expected = {(i, j) for j in range(len(sets)) for i in range(j) if len(set(sets[i]) & set(sets[j])) >= 0.6 * len(set(sets[i]) | set(sets[j])) - 1e-9}
    assert got == expected


def near_sets(groups, seed=3):
    """Sorted arrays: groups of (size, n-grams changed), and some that hold n-grams of two groups."""
    rng = np.random.default_rng(seed)
    out, bases = [], []
    for size, changed in groups:
        bases.append(rng.choice(1 << 40, 60, replace=False).astype(np.uint64))
        for _ in range(size):
            x = bases[-1].copy()
            x[rng.choice(60, changed, replace=False)] = rng.choice(1 << 40, changed).astype(np.uint64)
            out.append(np.unique(x))
    out += [np.unique(np.concatenate((a[:k], b[: 60 - k]))) for a, b in zip(bases, bases[1:]) for k in (15, 25, 35, 45)]
    return [out[i] for i in rng.permutation(len(out))]


@pytest.mark.parametrize("groups", [[(400, 5)], [(300, 16), (100, 25), (60, 2)], [(1, 0)] * 150, [(30, 20)] * 12])
def test_what_is_connected(groups, monkeypatch):
    """The same classes as all pairs make, in tiles too; near copies aren't compared in full."""
    sets = near_sets(groups)
    label = np.arange(len(sets))
    for i, a in enumerate(sets):
        j = np.array([k for k in range(i) if (c := len(np.intersect1d(a, sets[k]))) >= 0.6 * (len(a) + len(sets[k]) - c) - 1e-9], np.int64)
        label = jaccard_join.merge(label, np.full(len(j), i), j)
    done, compared = [], jaccard_join._compared
    monkeypatch.setattr(jaccard_join, "_compared", lambda s, a, b, t: done.append(len(a) * len(b)) or compared(s, a, b, t))
    assert (jaccard_join.connected(sets, 0.6) == label).all()
    if groups == [(400, 5)]:
        assert sum(done) < 400 * 400 / 8
    m = np.arange(len(sets))
    pairs = sorted((min(p), max(p)) for i, j, _ in compared(sets, m, m, 0.6) for p in zip(i.tolist(), j.tolist()))
    monkeypatch.setattr(jaccard_join, "TILE", 7)
    assert (jaccard_join.connected(sets, 0.6) == label).all()
    assert sorted((min(p), max(p)) for i, j, _ in jaccard_join._compared_tiles(sets, m, m, 0.6) for p in zip(i.tolist(), j.tolist())) == pairs


def test_chains_are_one_group(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "doc_a long, doc_b long")
    assert {(r.doc_id, r.group_id) for r in jaccard_join.components(pairs).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("seed", [6, 7])
def test_line_windows(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " d ", "e"]) for _ in range(rng.randint(0, 14))), "en", "a", 0) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(messy.docs(spark, rows)).collect()}
    assert got == dict(zip(range(60), brute.line_dedup([(r[0], r[1]) for r in rows])))


def unit_table(spark, rows=1500, dimension=32, seed=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dimension))
    x = centres[rng.integers(0, 40, rows)] + rng.normal(size=(rows, dimension)) * rng.choice([0.02, 0.12, 0.5], (rows, 1))
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return df, x @ x.T


def test_embedding_pairs_recall(spark):
    df, s = unit_table(spark)
    a, b = np.nonzero(np.triu(s >= embed_dedup.THRESHOLD, 1))
    got = {(r.vec_a, r.vec_b) for r in embed_dedup.embedding_pairs(df).collect()}
    true = set(zip(a.tolist(), b.tolist()))
    assert got <= true and len(got) >= 0.97 * len(true)


@pytest.mark.parametrize("cell", [4096, 200])
def test_nearest_neighbours_recall(spark, monkeypatch, cell):
    monkeypatch.setattr(ann, "CELL_ROWS", cell)
    df, s = unit_table(spark)
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1, kind="stable")[:, :10]
    got = ann.nearest_neighbours(df).collect()
    assert len(got) == 15000
    assert np.mean([r.neighbour_id in top[r.vec_id] for r in got]) >= 0.95
    assert all(abs(r.cosine - s[r.vec_id, r.neighbour_id]) < 1e-4 for r in got)


@pytest.mark.parametrize("cell", [4096, 700])
def test_nearest_in_a_group_of_near_copies(spark, monkeypatch, cell):
    """Thousands of near copies, which the codes can't rank, and some exact ones among them."""
    monkeypatch.setattr(ann, "CELL_ROWS", cell)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2600, 48))
    x[:2400] = x[0] + 0.2 * rng.normal(size=(2400, 48))
    x[100:120] = x[100]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1, kind="stable")[:, :10]
    got = ann.nearest_neighbours(df).collect()
    hit = np.array([r.neighbour_id in top[r.vec_id] for r in got if r.vec_id < 2400])
    assert len(hit) == 24000 and np.mean(hit) >= (0.999 if cell > 2600 else 0.95), np.mean(hit)
    assert [r.neighbour_id for r in sorted(got, key=lambda r: r["rank"]) if r.vec_id == 110] == list(range(100, 110))


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 20), st.booleans())
def test_block_max_search_is_exact(seed, k, own):
    rng = np.random.default_rng(seed)
    n, features = int(rng.integers(1, 900)), 30
    dense = rng.random((n, features)) * (rng.random((n, features)) < rng.choice([0.003, 0.15], features))
    dense[n // 2 :] = dense[: n - n // 2]
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-9)[:, None]
    example, feature = np.nonzero(dense)
    weight = dense[example, feature].astype(np.float32)
    dense[example, feature] = weight
    index = toxicity.BlockMaxIndex(n, features, feature, example, weight)
    texts = [rng.random(features) * (rng.random(features) < 0.3) for _ in range(3)] + [np.zeros(features)]
    skip = [(int(rng.integers(0, n)),) if own else () for _ in texts]
    cut = np.concatenate(([0], np.cumsum([np.count_nonzero(q) for q in texts])))
    got = index.search(cut, np.concatenate([np.flatnonzero(q) for q in texts]), np.concatenate([q[q > 0] for q in texts]), k, skip)
    for q, own_, (ids, cosine) in zip(texts, skip, got):
        all_ = dense @ q
        all_[list(own_)] = 0
        order = sorted(np.flatnonzero(all_ > 0), key=lambda i: (-round(all_[i], 12), i))[:k]
        assert ids.tolist() == [int(i) for i in order] and np.allclose(cosine, all_[order])


def test_held_out_labels(spark):
    docs, labels = table(spark, SF_DIR.replace("0.001", "0.01"), "documents"), table(spark, SF_DIR.replace("0.001", "0.01"), "labels")
    seen = toxicity.score_documents(docs, labels.where("xxhash64(doc_id) % 3 <> 0"))
    got = seen.join(labels.where("xxhash64(doc_id) % 3 = 0").selectExpr("doc_id", "toxic AS y"), "doc_id").collect()
    right = [r.toxic == bool(r.y) for r in got]
    assert len(got) > 80 and np.mean(right) > 0.93
    assert np.mean([r.toxic for r in got if r.y]) > 0.6 and np.mean([r.toxic for r in got if not r.y]) < 0.05
    assert all(0 <= r.score <= 1 and (not r.toxic or r.neighbours) and r.doc_id not in [n.doc_id for n in r.neighbours] for r in got)


def test_scores_by_brute_force(spark):
    """Features, frequencies, weights, cosines, votes and calibration, all made anew."""
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute.toxicity(rows, [(r.doc_id, r.toxic) for r in labels.collect()])
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    for (d, _), (score, near, last) in zip(rows, expected):
        mine = {x.doc_id: x.cosine for x in got[d].neighbours}
        assert len(mine) == len(near) and all(abs(near[x] - c) < 1e-6 for x, c in mine.items() if x in near)
        assert all(abs(c - last) < 1e-6 for x, c in mine.items() if x not in near)
        assert got[d].score == pytest.approx(score, abs=1e-6)
    assert sum(len(r.neighbours) > 0 for r in got.values()) > 0.95 * len(rows)


def test_neighbours_of_the_stated_queries(spark):
    """op8's rows: all ids divisible by 100 ask, all vectors are searched."""
    from chronoloom.llm import queries

    folder = SF_DIR.replace("0.001", "0.1")
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    asks = np.flatnonzero(ids % 100 == 0)
    s = x[asks] @ x.T
    s[np.arange(len(asks)), asks] = -9
    top = {int(ids[a]): set(ids[t].tolist()) for a, t in zip(asks, np.argsort(-s, axis=1)[:, : ann.K])}
    got = queries.op8_nearest_neighbours(spark, folder).collect()
    assert {r.vec_id for r in got} == set(top) and len(got) == ann.K * len(top)
    assert np.mean([r.neighbour_id in top[r.vec_id] for r in got]) >= 0.95


def test_a_workers_model_is_small(spark):
    """Beyond what was broadcast and the look-up of features, a worker holds little more than the matrix."""
    import tracemalloc

    folder = SF_DIR.replace("0.001", "0.01")
    docs = table(spark, folder, "documents")
    parts, _ = toxicity.fit(docs, table(spark, folder, "labels"))
    _, hashes, *others = parts.value
    texts = docs.where("text is not null").limit(20).select("text").toArrow().column("text").combine_chunks()
    rows = toxicity.features_of(texts)
    tracemalloc.start()
    lookup = toxicity.FeatureTable(hashes)
    base = tracemalloc.get_traced_memory()[0]
    del lookup
    tracemalloc.reset_peak()
    model = toxicity.Model(hashes, *others)
    peak = tracemalloc.get_traced_memory()[1] - base
    list(model.nearest([-1] * len(texts), texts))
    held = tracemalloc.get_traced_memory()[0] - base
    tracemalloc.stop()
    assert peak < 5_000_000 and held < model.index.rows.nbytes + 2_000_000
