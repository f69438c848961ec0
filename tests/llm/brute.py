"""Plain versions of the operators, of a few lines each."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import defaultdict

from chronoloom.llm.bpe import PATTERN, TOKENIZER


def words(text):
    return re.findall(r"[^\x00-\x20]+", text)


def line_dedup(rows):
    """[(doc_id, text)] -> texts in the order of rows; rows of equal doc_id and text are one."""
    order = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), defaultdict(set)
    for d, t in order:
        lines = [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")]
        for a, b, c in zip(lines, lines[1:], lines[2:]):
            w = (a[1], b[1], c[1])
            if w in seen:
                gone[d, t] |= {a[0], b[0], c[0]}
            seen.add(w)
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t]) for d, t in rows]


def grams(text, n=2):
    w = words(text.lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def jaccard_sets(rows, threshold=0.6, n=2):
    """({set: doc_ids}, {(set, set): jaccard}) of the different sets and their pairs."""
    by = defaultdict(set)
    for d, t in rows:
        if d is not None and t is not None and grams(t, n):
            by[grams(t, n)].add(d)
    sets, pairs = list(by), {}
    for i, s in enumerate(sets):
        for t in sets[:i]:
            j = len(s & t) / len(s | t)
            if j >= threshold - 1e-12:
                pairs[s, t] = j
    return by, pairs


def jaccard_pairs(rows, threshold=0.6, n=2):
    """{(a, b): jaccard} of different sets, each named by its smallest doc_id."""
    by, pairs = jaccard_sets(rows, threshold, n)
    named = {tuple(sorted((min(by[s]), min(by[t])))): j for (s, t), j in pairs.items()}
    return {p: j for p, j in named.items() if p[0] != p[1]}


def jaccard_classes(rows, threshold=0.6, n=2):
    """{(doc_id, class_id, n_links, n_copies)} of every document's sets."""
    by, pairs = jaccard_sets(rows, threshold, n)
    return classes(by, pairs) | {(d, d, 0, 0) for d, t in rows if d is not None and not grams(t or "", n)}


def classes(by, pairs):
    """Rows of classes from {thing: ids} and the pairs of things that are linked."""
    names = list(by)
    root = {s: s for s in names}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for s, t in pairs:
        root[find(s)] = find(t)
    least, links = {}, defaultdict(int)
    for s in names:
        least[find(s)] = min(min(by[s]), least.get(find(s), 1 << 62))
    for s, t in pairs:
        links[s] += 1
        links[t] += 1
    return {(d, least[find(s)], links[s], len(by[s])) for s in names for d in by[s]}


def keep_first(rows):
    """doc_ids that go when the smallest of each class stays."""
    return {d for d, c, _, _ in jaccard_classes(rows) if d != c}


def toxic_features(text):
    """{feature: count}: words and their beginnings of 4, 5 and 6 bytes."""
    out = defaultdict(int)
    for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower()):
        b = w.encode()
        for f in (b, *((k, b[:k]) for k in (4, 5, 6) if len(b) >= k)):
            out[f] += 1
    return out


def toxicity(docs, labels, k=15):
    """[(score, {doc_id of a neighbour: cosine}, the k-th cosine)] of docs, [(doc_id, text)]; all labelled ones are examples."""
    import numpy as np

    label = {}
    for d, t in labels:
        if d is not None and t is not None:
            label[d] = max(t, label.get(d, 0))
    counts = [toxic_features(t or "") for _, t in docs]
    examples = [i for i, (d, t) in enumerate(docs) if d in label and t is not None]
    y = np.array([label[docs[i][0]] for i in examples])
    place = {f: j for j, f in enumerate(sorted({f for i in examples for f in counts[i]}, key=str))}
    have, bad, df = np.zeros(len(place)), np.zeros(len(place)), np.zeros(len(place))
    for i, label_ in zip(examples, y):
        for f in counts[i]:
            have[place[f]] += 1
            bad[place[f]] += label_
    for (_, t), c in zip(docs, counts):
        for f in c if t is not None else ():
            if f in place:
                df[place[f]] += 1
    total, p = sum(t is not None for _, t in docs), y.mean()
    chi = (bad - have * p) ** 2 / (have * p * (1 - p))
    factor = (np.log((1 + total) / (1 + df)) + 1) * (0.03 + np.where(bad > have * p, chi / (chi + 60), 0))

    def unit(c):
        f = [x for x in c if x in place]
        at = np.array([place[x] for x in f], int)
        w = (1 + np.log([c[x] for x in f])) * factor[at] if f else np.zeros(0)
        return at, w / (np.linalg.norm(w) or 1)

    dense = np.zeros((len(examples), len(place)))
    for r, i in enumerate(examples):
        at, w = unit(counts[i])
        dense[r, at] = w
    ids = np.array([docs[i][0] for i in examples])

    def nearest(i):
        at, w = unit(counts[i])
        c = np.round(dense[:, at] @ w, 12)
        c[ids == docs[i][0]] = 0
        best = [j for j in np.lexsort((ids, -c))[:k] if c[j] > 0]
        return best, c[best], float((y[best] * c[best]).sum() / (c[best].sum() + 0.5))

    known = sorted((round(nearest(i)[2], 5), label_) for i, label_ in zip(examples, y))
    x, t = np.array([v for v, _ in known]), np.array([float(v) for _, v in known])
    ux = np.unique(x)
    n, s = np.array([(x == v).sum() for v in ux]), np.array([t[x == v].sum() for v in ux])
    up = np.array([max(min(s[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(ux))) for a in range(i + 1)) for i in range(len(ux))]) if len(ux) < 120 else _rising(s, n)
    out = []
    for i in range(len(docs)):
        best, c, v = nearest(i)
        out.append((float(up[max(0, np.searchsorted(ux, round(v, 5) + 1e-9) - 1)]), dict(zip(ids[best].tolist(), c.tolist())), c[-1] if len(c) else 0.0))
    return out


def _rising(s, n):
    """Isotonic means by cumulative sums: the greatest convex minorant."""
    import numpy as np

    px, py = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(s)])
    hull = [0]
    for i in range(1, len(px)):
        while len(hull) > 1 and (py[hull[-1]] - py[hull[-2]]) * (px[i] - px[hull[-2]]) >= (py[i] - py[hull[-2]]) * (px[hull[-1]] - px[hull[-2]]):
            hull.pop()
        hull.append(i)
    return np.concatenate([np.full(b - a, (py[b] - py[a]) / (px[b] - px[a])) for a, b in zip(hull, hull[1:])])


def mixture(rows, quality, temperature=0.5, seed=17):
    """[(doc_id, source, text)] -> [(doc_id, source, copy_no, position, n_tokens, tokens_before)]."""
    by = defaultdict(list)
    for d, s, t in rows:
        n = len(words(t or ""))
        if n:
            u = (int(hashlib.md5(f"{seed}:0:{-1 if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            by[s].append((-math.log(u) / {1: 4, 0: 1}.get(quality.get(d), 2), -1 if d is None else d, n, d))
    total = {s: sum(x[2] for x in v) for s, v in by.items()}
    share = {s: t**temperature for s, t in total.items()}
    out = []
    for s, v in by.items():
        budget = math.floor(sum(total.values()) * share[s] / sum(share.values()))
        whole, rest = divmod(budget, total[s])
        before = 0
        for k, (_, _, n, d) in enumerate(sorted(v, key=lambda x: x[:2]), 1):
            for c in range(whole + (before + n <= rest)):
                out.append((d, s, c + 1, k, n, c * total[s] + before))
            before += n
    return out


def encoding():
    import tiktoken

    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
