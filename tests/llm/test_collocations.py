from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from chorusmill.llm import collocations

from .data import SCHEMA, clashing, frame, odd_rows


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least, longest, most):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    key = lang, tuple(words[k : k + size])
                    f[key] = f.get(key, 0) + 1
    some = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in some.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        held = any(la == lang and len(q) > len(p) and b >= a and any(q[j : j + len(p)] == p for j in range(len(q))) for (la, q), b in some.items())
        if not held:
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((" ".join(p), a, left, right, n[lang], score))
    return {(lang, k, *row) for lang, rows in out.items() for k, row in enumerate(sorted(rows, key=lambda r: (-r[5], -r[1], r[0].encode()))[:most], 1)}


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def texts(seed, n):
    rng = random.Random(seed)
    words = "the of und Der é日本 x\x00y ünï a b".split(" ")
    return [(k, rng.choice([" ", "  ", "\t"]).join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", "!?"]) for _ in range(rng.randrange(200))), rng.choice(["en", "de", None]), None, None) for k in range(n)]


def test_against_brute_force(spark):
    rows = texts(12, 60)
    for least, longest, most in ((5, 5, 40), (2, 3, 2000)):
        assert found(collocations.collocations(frame(spark, rows).repartition(3), least, longest, most)) == brute(rows, least, longest, most)


def test_many_small_shards(spark):
    """Shards closed in the middle of documents, runs of few blocks, many ranges of counts: the same result."""
    rows = texts(5, 40) + odd_rows()
    small = collocations._Open()
    for _, text, *_ in rows:
        small.add((text or "").encode().lower().translate(collocations._CLEAN))
    closed = list(small.closed(50))
    assert len(closed) > 10 and sum(c[0] for c in closed) == sum(len(p) for _, t, *_ in rows for p in pieces(t))
    assert collocations.build_shards(frame(spark, rows), 50, 90).count() > 10
    assert found(collocations.collocations(frame(spark, rows), 4, 5, 500, shard=50, run=7, counts=40)) == brute(rows, 4, 5, 500)


def test_bitmaps_shift_over_blocks_and_stop_at_gaps():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4, 400).astype(np.uint32)
    maps = collocations.Bitmaps(ids, 3)
    want = Counter((int(a) - 1, int(b) - 1) for a, b in zip(ids[:-1], ids[1:], strict=True) if a and b)
    got = Counter()
    for word, block, bits in maps.runs():
        for p, w, _, both in zip(*maps.extend(word, block, bits), strict=True):
            got[int(p), int(w)] += int(both).bit_count()
    assert got == want
    assert sum(int(b).bit_count() for b in maps.bits) == np.count_nonzero(ids)


def test_packing_and_folding():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 1000):
        values = rng.integers(0, 1 << 45, n)
        assert np.array_equal(collocations._unpacked(collocations._packed(values), np.int64), values)
        assert np.array_equal(collocations._climbed(collocations._steps(np.sort(values))), np.sort(values))
    fold = lambda *ids: collocations._folded(np.array(ids, np.uint32)).tolist()
    assert fold(0, 0, 5, 6, 0, 7, 0, 8, 9, 0, 0) == [0, 5, 6, 0, 8, 9, 0] and fold(3) == [0] and fold() == [] and fold(1, 2) == [1, 2]


def test_scores_beyond_64_bits(spark):
    f = {"a": 3 * 10**15, "b": 7 * 10**15, "c": 10**15 + 9, "a b": 10**15 + 1, "b c": 10**14, "a b c": 99_999_999_999_999}
    phrases = spark.createDataFrame([("en", p, len(p.split()), n) for p, n in f.items()], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    got = {r["phrase"]: (r["score"], r["l"], r["r"]) for r in collocations.scored(phrases, totals).collect()}
    cut = lambda a, left, right: (1000 * f[a] * 9 * 10**15 // (f[left] * f[right]), f[left], f[right])
    assert got == {"a b": cut("a b", "a", "b"), "b c": cut("b c", "b", "c"), "a b c": min(cut("a b c", "a", "b c"), cut("a b c", "a b", "c"))}


def test_best_by_parts(spark):
    rows = [("en", f"p{k % 7} q{k}", 2, k % 5, 1, 1, 10, k % 11) for k in range(500)]
    got = [tuple(r)[-1] for r in collocations.best(spark.createDataFrame(rows, "lang string, phrase string, size int, a long, l long, r long, n long, score long"), 60).orderBy("rank").collect()]
    assert got == list(range(1, 61))


def test_empty_and_clashing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(frame(spark), least=10**6).count() == 0
    rows = texts(9, 10)
    assert found(collocations.collocations(clashing(frame(spark, rows)), 3)) == brute(rows, 3, 5, 2000)
