from __future__ import annotations

import random
import re

import numpy as np

from chorusmill.llm import cap_filters, hyperminhash
from chorusmill.llm.components import connected_components
from chorusmill.llm.shingles import shingle_sets

from .data import SCHEMA, clashing, frame, odd_texts, prose


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 - k, 101 - k) for k in range(30)] + [(500, k) for k in range(200, 260)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: r for n, r in roots({x for e in links for x in e}, links).items() if n != r}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_set(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_shingle_sets():
    texts = odd_texts() + ["a b c", "A B C", "a b", "b a", "a  b\tc\x0bd"]
    raw = [(t or "").encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    names = {}
    for n in (3, 5):
        got = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offs, n)
        for t, s in zip(texts, got, strict=True):
            want = word_set(t, n)
            assert len(s) == len(want)
            assert names.setdefault((n, frozenset(want)), s.tolist()) == s.tolist()


def brute(rows, num, den, n):
    sets = {d: word_set(t, n) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return sets, roots(list(sets), links)


def near_rows(seed):
    """A chain, a large group around one text, exact copies, short texts."""
    rng = random.Random(seed)
    base = prose(rng, 120).split()
    out, chain = [], list(base)
    for _ in range(12):
        chain[rng.randrange(120)] = prose(rng, 1)
        out.append(" ".join(chain))
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(120)] = prose(rng, 1)
        out.append(" ".join(copy))
    out += [" ".join(base)] * 20 + [prose(rng, n) for n in range(1, 40)] + ["a b c d e f g h", "a b c d e f g h i"] + [prose(rng, 300)] * 2
    rng.shuffle(out)
    return [(k + 1, t) for k, t in enumerate(out)]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows(8)
    docs = clashing(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA))
    for num, n in ((85, 3), (80, 5)):
        sets, want = brute(rows, num, 100, n)
        got = {r["doc_id"]: r for r in hyperminhash.near_duplicates(docs, num=num, den=100, words=n).collect()}
        assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(sets[d]), c, c == d) for d, c in want.items()}
    assert hyperminhash.keep_first(docs).columns == docs.columns


def test_hot_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "CHUNK", 16)
    rows = near_rows(9)
    _, want = brute(rows, 85, 100, 3)
    got = hyperminhash.near_duplicates(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA), 85, 100, 3).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_odd_documents(spark):
    docs = frame(spark)
    got = hyperminhash.near_duplicates(docs, 85, 100, 3).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_shingles"] == 0 and by[0]["kept"] and by[3]["component_id"] == 3 and by[18]["component_id"] == 15 and by[51]["component_id"] == 15 and by[None]["component_id"] is None and by[None]["kept"]
    assert hyperminhash.near_duplicates(frame(spark, [])).count() == 0 and hyperminhash.keep_first(frame(spark, [])).count() == 0


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.85):
        n = 3000
        both = rng.integers(0, 1 << 63, int(2 * n * share / (1 + share))).astype(np.uint64) * np.uint64(2)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, n - len(both)).astype(np.uint64) * np.uint64(2)]) for _ in range(2))
        got = hyperminhash.estimate(hyperminhash.sketch(a)[None], hyperminhash.sketch(b)[None], np.array([n]), np.array([n]))[0]
        assert abs(got - share) < 0.13


def cosine_truth(rows, limit=0.93):
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n = [], {k: 0 for k in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= limit:
                    links.append((rows[i][0], rows[j][0]))
                    n[i] += 1
                    n[j] += 1
    return {rows[k][0]: v for k, v in n.items()}, roots([r[0] for r in rows], links)


def test_cap_filters_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "CHUNK", 24)
    rng = np.random.default_rng(6)
    rows = [(1, None, 1), (2, [0.0] * 64, 1), (3, [float("nan")] + [1.0] * 63, 1), (4, [1.0] * 64, None), (5, [], 1), (6, [None] + [1.0] * 63, 1), (7, [float("inf")] * 64, 1)]
    for label in (0, 1):
        centre = rng.standard_normal(64)
        vectors = [rng.standard_normal(64) for _ in range(40)] + [centre + 0.2 * rng.standard_normal(64) for _ in range(60)] + [centre * 3.0] * 5 + [centre] * 4 + [-centre]
        vectors += [rng.standard_normal(8) for _ in range(3)] + [np.array([1.0, 2.0]), np.array([1.0, 2.1]), np.array([5.0]), np.array([2.0])]
        rows += [(len(rows) + k + 10, v.astype(np.float32).tolist(), label) for k, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    from pyspark.sql import functions as F

    got = cap_filters.near_duplicates(table.withColumn("rep", F.lit(1)).withColumn("vector", F.lit("x"))).collect()
    links, component = cosine_truth(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {k: (links[k], component[k], component[k] == k) for k in links}
    assert cap_filters.near_duplicates(table.where("false")).count() == 0


def test_decoder_lists_every_filter():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((5, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, cap = cap_filters._codes(24, cap_filters.LEAST_SIZE, 0.93)
    for v, got in zip(x, cap_filters.decode(x), strict=True):
        want = []
        for c, (rotation, half, head, tail) in enumerate(codes):
            y = (v @ rotation).astype(np.float32)
            scores = (y[:half] @ head.T)[:, None] + (y[half:] @ tail.T)[None, :]
            i, j = np.nonzero(scores >= cap)
            if len(i) >= cap_filters.LEAST:
                want += ((c * len(head) + i) * len(head) + j).tolist()
        assert set(want) <= set(got.tolist())


def test_code_grows_with_the_label():
    for dim in (16, 64, 768):
        plans = [cap_filters.plan(dim, n, 0.93) for n in (1 << 10, 1 << 14, 1 << 18, 1 << 30)]
        assert plans[0] < plans[1] and plans[2][0] > plans[1][0] - 0.02 and plans[3][0] > plans[1][0] - 0.02 and all(cap_filters.share_chance(dim, cap, 0.93) > 0.19 for cap, _ in plans)
        assert all(count * dim * cap_filters.CODES * 4 <= cap_filters.BOOK_BYTES for _, count in plans)
    # in 64 dimensions a filter holds few vectors by chance at any size
    caps = [cap_filters.plan(64, n, 0.93)[0] for n in (1 << 10, 1 << 16)]
    grid = np.linspace(-1, 1, 400_001)
    assert all(float(np.interp(cap, grid, cap_filters._tail(64, grid))) * n < 0.2 for cap, n in zip(caps, (1 << 10, 1 << 16), strict=True))


def test_recall_of_searched_rows(spark, monkeypatch):
    """Links of the rows whose id is divisible by 100 against brute force over all rows, pairs close to the limit among them."""
    monkeypatch.setattr(cap_filters, "LEAST_SIZE", 256)  # so these labels have codes of their own size
    rng = np.random.default_rng(12)
    found = wanted = 0
    for dim in (16, 64, 768):
        base = rng.standard_normal((500, dim))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        side = rng.standard_normal(base.shape)
        side -= (side * base).sum(axis=1, keepdims=True) * base
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        cos = rng.uniform(0.9305, 0.96, (500, 1))
        x = np.concatenate([base, cos * base + np.sqrt(1 - cos * cos) * side]).astype(np.float32)
        ids = np.concatenate([np.arange(500) * 100, np.arange(500) * 100 + 1])
        table = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int")
        got = {r["vec_id"]: r["n_links"] for r in cap_filters.near_duplicates(table).collect()}
        y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        want = dict(zip(ids.tolist(), ((y @ y.T >= 0.93).sum(axis=1) - 1).tolist(), strict=True))
        assert all(got[i] <= want[i] for i in want)
        asked = [i for i in want if i % 100 == 0]
        found, wanted = found + sum(got[i] for i in asked), wanted + sum(want[i] for i in asked)
    assert wanted >= 1500 and found >= 0.999 * wanted
