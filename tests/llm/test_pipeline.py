from __future__ import annotations

import re

import corpus_pipeline
from chorusmill.llm.tokens import vocabulary_path

from .data import clashing, frame, odd_rows
from .test_near_duplicates import brute as near_brute
from .test_suffix_language_surrogates import brute as repeat_brute


def test_stages_against_brute_force(spark, tmp_path):
    rows = [r for r in odd_rows()[:-2]]
    docs = frame(spark, rows)
    out, columns = [], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"{k}-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        out.append({r[0]: r for r in docs.collect()} if k < 4 else docs.collect())
        assert k == 4 or docs.columns == columns
    language, near, repeats, private, packed = out
    assert set(language) == {r[0] for r in rows if re.search(r"[^\W\d_]", r[1] or "")}
    assert {r["lang"] for r in language.values()} == {"en"}  # half the labels were null
    left = [(d, r["text"]) for d, r in language.items()]
    _, component = near_brute(left, 80, 100, 5)
    assert set(near) == {d for d, c in component.items() if c == d}
    want = repeat_brute([(d, r["text"]) for d, r in near.items()], 100)
    assert set(repeats) == set(near) and all(r["text"] == near[d]["text"] for d, r in repeats.items() if want[d][1] == 0)
    assert sum(want[d][1] > 0 for d in want) > 0 and all(len(r["text"].encode()) <= want[d][0] - want[d][1] for d, r in repeats.items())
    assert set(private) == set(repeats) and not any("a.b@mail7.example.com" in r["text"] for r in private.values())
    assert all(r["n_chars"] == len(r["text"]) for r in private.values())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    total = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in private.values())
    assert sum(p["length"] for p in packed) == total


def test_run_reads_documents(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_clashing_columns_stay(spark, tmp_path):
    docs = clashing(frame(spark, [r for r in odd_rows()[:-2]]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns[:5] == frame(spark, []).columns and docs.where("name <> 'name' OR id <> 'id' OR rest <> 'rest' OR key <> 'key'").count() == 0
    assert docs.count() > 5 and corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
