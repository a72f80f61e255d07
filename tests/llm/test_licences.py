from __future__ import annotations

import random
import re

import pytest

from chorusmill.llm import licences

from .data import SCHEMA, clashing, frame, odd_rows, prose


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def base_of(words, base=licences.BASE):
    places, labels = [], set()
    for phrase, label in base.items():
        p = phrase.split(" ")
        at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(places), min(places, default=None), max(places, default=None), sorted(labels)


def brute(rows, templates=licences.TEMPLATES):
    files = [(doc, words_of(text)) for doc, text, *_ in rows]
    held = [set(w) for _, w in files]
    df = {w: sum(w in h for h in held) for _, text, _ in templates for w in text.split(" ")}
    out = []
    for doc, words in files:
        n, first, last, base = base_of(words)
        labels, share = set(base), 0.0
        for label, text, keys in templates:
            t = text.split(" ")
            rare = sorted({w for w in t if df[w]}, key=lambda w: (df[w], w))[: min(12, max(4, len(t) // 8))]
            need = max(2, -(-len(rare) * 60 // 100))
            hits = [(i - k, w) for i, w in enumerate(words) if w in rare for k, v in enumerate(t) if v == w]
            cells = {}
            for shift, w in hits:
                for cell in ((0, shift // 8), (1, (shift + 4) // 8)):
                    cells.setdefault(cell, []).append((shift, w))
            for cell in cells.values():
                same = len({w for _, w in cell})
                at = max(0, min(s for s, _ in cell) - 8)
                around = f" {' '.join(words[at : at + len(t) + 24])} "
                if same >= need and all(f" {k} " in around for k in keys):
                    labels.add(label)
                    share = max(share, same / len(rare))
        out.append((doc, len(words), n, first, last, ",".join(base), ",".join(sorted(labels)), max(share, 0.5 if base else 0.0)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def notices(seed=13):
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        _, text, _ = rng.choice(licences.TEMPLATES)
        words = text.split(" ")
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words)), "inserted")
        if rng.random() < 0.3:
            words = words[: len(words) * 2 // 3]
        if rng.random() < 0.2:
            rng.shuffle(words)
        around = prose(rng, rng.randrange(60))
        rows.append((k, f"{around}. {' '.join(w.title() for w in words)}! {prose(rng, 9)}" + (" /* Released under the MIT License */" if k % 7 == 0 else ""), "en", "s", None))
    rows += [(50, "cc by cc by cc-by CC;BY ccby", None, None, None), (51, "All rights reserved", None, None, None), (52, "  all RIGHTS\nreserved é", None, None, None), (53, "general public licenses", None, None, None), (54, "日本cc by", None, None, None)]
    return rows + odd_rows()


def test_scan_against_brute_force(spark):
    rows = notices()
    got = found(licences.scan(frame(spark, rows)))
    assert got == brute(rows)
    assert sum(r[6] != r[5] for r in got) > 10


def test_no_python_on_the_way(spark):
    plan = licences.scan(frame(spark, notices()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("Released under the MIT License", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
        ("All rights reserved.", "reserved"),
        ("He said the license was under the table; version 3 of the general story, to the public.", ""),
        ("Apache helicopters were licensed in 2.0 versions of the game", ""),
        (" ".join(licences.TEMPLATES[5][1].split(" ")[:40]), "mit"),
    ],
)
def test_hand_labelled(spark, text, labels):
    assert [r["labels"] for r in licences.scan(frame(spark, [(1, text, None, None, None)])).collect()] == [labels]


def test_empty_and_clashing(spark):
    assert licences.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = notices(2)[:12]
    assert found(licences.scan(clashing(frame(spark, rows)))) == brute(rows)
