from __future__ import annotations

import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest

from chorusmill.llm import packing, simple8b, tokens
from chorusmill.llm.common import texts_of

from .data import SCHEMA, clashing, frame, odd_texts

PATH = tokens.vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_chunks_equal_the_library(library):
    texts = [t or "" for t in odd_texts()] + ["don't 'tis it's,'s", "a b  c", "!\x1c a", "word,\nword; (x)y", "a\x85 b", "½×, é,", "\n\n x\t\ty", "<|endoftext|> x"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab ,.'s!\n\té½×0#(") for _ in range(60)) for _ in range(200)]
    got = tokens.CachedEncoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    enc = tokens.CachedEncoder(PATH)
    for text in ("a b c d e f", "g h i", "a b z " + "long" * 40):
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def brute(rows, library, end):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(np.array(library.encode(r["text"], add_special_tokens=False).ids + [end], "<u4"))
    return out


@pytest.mark.parametrize("window", [64, 1024])
def test_packing(spark, library, window):
    docs = clashing(frame(spark))
    pieces = packing.pack(docs, PATH, window=window).collect()
    want = brute(texts_of(docs).collect(), library, 0)
    seen = {k: sum(len(x) for x in v) for k, v in want.items()}
    for p in pieces:
        seen[p["doc_id"]] -= p["length"]
        assert any(p["doc_tokens"] == len(x) and p["ids_crc32"] == zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) for x in want[p["doc_id"]])
    assert not any(seen.values())
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == sequences.get(p["sequence_id"], 0)
        sequences[p["sequence_id"]] = p["offset"] + p["length"]
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(n == window or n & (n - 1) == 0 for n in sequences.values()) and max(sequences.values()) <= window
    assert packing.sequences(packing.pack(docs, PATH, window=window)).count() == len(sequences)


def test_least_squares_fit_the_histogram():
    hist = np.zeros(65, int)
    hist[[10, 54, 20, 24]] = [500, 500, 300, 600]
    plan = packing.plan_windows(hist, 64)
    used = np.zeros(65, int)
    for parts, n in plan:
        assert sum(parts) == 64
        for v in parts:
            used[v] += n
    assert (used <= hist).all() and used.sum() > 0.9 * hist[[10, 54]].sum()
    assert packing.plan_windows(np.zeros(65, int), 64) == [] and packing.pack_lengths(np.zeros(0, int), 64) == []


def test_plan_places_most_pieces():
    rng = np.random.default_rng(4)
    for count in (1000, 8000):
        hist = np.bincount(np.minimum(rng.lognormal(6, 0.7, count).astype(int), 1023), minlength=1025)
        hist[0] = 0
        plan = packing.plan_windows(hist, 1024)
        used = np.zeros(1025, int)
        for parts, n in plan:
            assert sum(parts) == 1024 and n > 0
            for v in parts:
                used[v] += n
        assert (used <= hist).all() and used.sum() > 0.75 * hist.sum()


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    cases = [[], [0], [0] * 500, [1 << 59, (1 << 60) - 1, (1 << 60) - 2, (1 << 64) - 1, 0, 5], list(range(70)), [(1 << 64) - 1] * 3]
    cases += [rng.integers(0, 1 << b, n).tolist() for b in (1, 4, 12, 16, 31, 62) for n in (1, 59, 61, 240, 1000)]
    for c in cases:
        a = np.array(c, np.uint64)
        coded = simple8b.encode(a)
        assert simple8b.decode(coded).tolist() == a.tolist() and len(coded) <= 16 * max(1, len(c))
    assert len(simple8b.encode(np.zeros(240, np.uint64))) == 8


def test_token_files(spark, library, monkeypatch):
    docs = clashing(frame(spark))
    got = simple8b.read_token_files(simple8b.write_token_files(docs, PATH)).collect()
    want = brute(texts_of(docs).collect(), library, 2)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        assert any(r["n_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x.tobytes()) for x in want[r["doc_id"]])
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda k: (k is not None, k or 0)) and len(got) == docs.count()


def test_empty_tables(spark):
    none = frame(spark, [])
    assert packing.pack(none, PATH).count() == 0
    assert simple8b.read_token_files(simple8b.write_token_files(none, PATH)).count() == 0


def test_scratch_folder(spark, tmp_path, monkeypatch):
    from chorusmill.llm import common

    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))), master="spark://host:7077", applicationId="app")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):  # a cluster that names no shared folder
        common.scratch_dir(SimpleNamespace(conf={}, sparkContext=context))
    monkeypatch.setattr(common, "scratch_dir", lambda _: str(tmp_path))
    table = common.materialize(spark.range(3), "x")
    assert table.count() == 3 and len(list((tmp_path / "chorusmill").iterdir())) == 1
    common.delete_table(table)
    assert not list((tmp_path / "chorusmill").iterdir())


def test_one_doc_id_on_a_third_of_the_rows(spark):
    from chorusmill.llm import simple8b

    rows = [(7 if k % 3 == 0 else k, f"text {k % 40} of many", None, None, None) for k in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in simple8b.read_token_files(simple8b.write_token_files(docs, PATH)).collect())
    assert len(got) == 900 and [x[2] for x in got] == sorted(r[0] for r in rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False)) and got[0][0] == 0
