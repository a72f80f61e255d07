from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from chorusmill.llm import spelling

from .data import SCHEMA, clashing, frame, odd_texts, prose


def table(spark, rows):
    return frame(spark, [(doc, text, None, None, None) for doc, text in rows])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def word_counts(rows, marker=97, shortest=5, least=3):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % marker == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def groups(counts):
    words = sorted(counts)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 2 * counts[w]:
                form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def test_variants_against_brute_force(spark):
    rng = random.Random(11)
    stems = ["señora", "ÀÀtion", "colour", "abcdef", "x" * 300, "overlap", "×÷×÷×÷"]

    def typo(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("aeñz") + w[k + 1 :], w[:k] + rng.choice("aeÿz") + w[k:], w.upper()])

    rows = [(k, " ".join(typo(rng.choice(stems)) for _ in range(40))) for k in range(60)]
    rows += [(100 + k, t) for k, t in enumerate(odd_texts())] + [(3, None), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(200 + k, prose(rng, 80)) for k in range(10)]
    counts = word_counts(rows)
    got = [tuple(r) for r in spelling.spelling_variants(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == groups(counts)
    assert {f for _, f, *_ in got if f} and any(r[4] > 3 for r in got)


def test_chains_follow_to_the_last_form(spark):
    chain = {"abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24, "abcdefghi": 48, "abcdefghij": 96, "lonely": 5, "tiesaa": 4, "tiesab": 9, "tiesac": 9}
    got = {tuple(r) for r in spelling.variant_groups(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert got == groups(chain)
    assert {r[2] for r in got if r[0].startswith("abcde")} == {"abcdefghij"}


def test_every_edit_leaves_a_band_and_a_half(spark):
    """All single edits of a word are found, at its ends and in its middle, and no pair twice."""
    letters, base = "abzñÿ", "abcdefgh"
    edits = {base} | {base[:k] + base[k + 1 :] for k in range(8)} | {base[:k] + c + base[k + 1 :] for k in range(8) for c in letters} | {base[:k] + c + base[k:] for k in range(9) for c in letters}
    words = spark.createDataFrame([(w, 1) for w in edits], "word string, n long")
    got = [tuple(sorted(r)) for r in spelling.near_pairs(words.select("word", "n", spelling.parity_mask(words["word"]).alias("mask"))).select("word_a", "word_b").collect()]
    want = {(a, b) for a in edits for b in edits if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_flip_of_bits_is_an_edit(spark):
    rows = [("aab", 0b100), ("abc", 0b1110), ("éa", 1 << (233 % 48) | 1 << (97 % 48))]
    got = {r["w"]: r["m"] for r in spark.createDataFrame([(w,) for w, _ in rows], "w string").select("w", spelling.parity_mask(spelling.F.col("w")).alias("m")).collect()}
    want = {}
    for w, _ in rows:
        mask = defaultdict(int)
        for c in w:
            mask[ord(c) % 48] ^= 1
        want[w] = sum(bit << k for k, bit in mask.items())
    assert got == want


def test_empty_and_clashing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(k, "colour colour color") for k in range(3)]
    assert {tuple(r) for r in spelling.spelling_variants(clashing(table(spark, rows))).collect()} == groups(word_counts(rows))
