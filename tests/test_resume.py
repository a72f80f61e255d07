from __future__ import annotations

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from chorusmill import tables
from chorusmill.operators import ingest, resume, run
from chorusmill.schemas import RAW_FIELDS

from .test_ingest import capture, comment, read

DOCS = [
    capture("A", [comment("1"), comment(None, "same"), comment("2", "two", parent="1")]),
    capture("B", [comment("3"), comment(None, None, None)], media={"discovery": {"matched_asins": ["B000000002"], "matched_queries": ["q2"]}}),
    capture("A", [comment("1", "later"), comment("4")], {"coverage": "partial"}, media={"discovery": {"matched_asins": ["B000000003"], "matched_queries": ["q3"]}}),
    capture("C", [], {"status": "rate_limited"}),
    capture("B", [comment("3", "again"), comment("5"), comment("6")]),
]
SAME = ["raw_captured_count", "invalid_row_count", "technical_duplicate_count", "internal_raw_unique_count", "final_collected_count", "reply_count", "media_count", "pass_media_count", "blocked_media_count", "quality_gate", "amazon_asins"]


def shown(done):
    rows = sorted((json.dumps(r.asDict(), sort_keys=True, default=str) for r in done.rows.select(*RAW_FIELDS).collect()))
    audits = sorted((json.dumps(r.asDict(), sort_keys=True, default=str) for r in done.audits.collect()))
    return rows, audits, done.manifest.select(*SAME).first()


def some(checked, *numbers):
    return checked.where(F.regexp_extract("ord", r"c(\d+)\.json", 1).isin([str(n) for n in numbers]))


@pytest.fixture
def checked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    return read(spark, tmp_path / "in", DOCS).cache()


def test_runs_add_up_to_one_run(spark, tmp_path, checked):
    whole = shown(run.ingest_run(checked, ["B000000001"], "q"))
    folder = str(tmp_path / "state")
    for numbers in ((0,), (0, 1, 2), (3, 4, 0)):
        done = resume.resume_ingest(some(checked, *numbers), folder, ["B000000001"], "q", buckets=4)
    assert shown(done) == whole
    number = resume.open_state(spark, folder).number
    again = resume.resume_ingest(checked, folder, ["B000000001"], "q", buckets=4)
    assert shown(again) == whole and resume.open_state(spark, folder).number == number == 3


def test_only_touched_buckets_are_written(spark, tmp_path, checked):
    folder = str(tmp_path / "state")
    resume.resume_ingest(some(checked, 0, 1, 4), folder, buckets=64)
    before = resume.open_state(spark, folder).where["rows"]
    resume.resume_ingest(some(checked, 2), folder, buckets=64)
    after = resume.open_state(spark, folder).where["rows"]
    moved = {b for b in after if after[b] != before.get(b)}
    assert len(after) > 2 and 1 <= len(moved) <= 2 and len(resume._names(spark, f"{folder}/rows/number=2")) <= 4


def test_a_run_that_fails_half_way_may_be_repeated(spark, tmp_path, checked, monkeypatch):
    whole = shown(run.ingest_run(checked))
    folder = str(tmp_path / "state")
    resume.resume_ingest(some(checked, 0, 1), folder, buckets=2)
    kept = shown(resume.current_run(resume.open_state(spark, folder)))
    with monkeypatch.context() as broken, pytest.raises(RuntimeError, match="lost"):
        broken.setattr(resume.audit, "latest_audits", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        resume.resume_ingest(checked, folder, buckets=2)
    assert shown(resume.current_run(resume.open_state(spark, folder))) == kept
    assert shown(resume.resume_ingest(checked, folder, buckets=2)) == whole


def test_target_counts_earlier_rows(spark, tmp_path, checked):
    folder = str(tmp_path / "state")
    first = resume.resume_ingest(some(checked, 0), folder, target=4, buckets=2)
    assert (first.rows.count(), first.manifest.first()["target_reached"]) == (3, False)
    more = resume.resume_ingest(checked, folder, target=5, buckets=2)  # B brings one row, the second A another; the rest stays unread
    assert (more.rows.count(), more.manifest.first()["stop_reason"]) == (5, "target_comments_reached")
    assert resume.open_state(spark, folder).processed().count() == 3
    beyond = resume.resume_ingest(checked, folder, target=5, buckets=2)  # reached already: one capture goes on
    assert beyond.rows.count() == 5 and resume.open_state(spark, folder).processed().count() == 4
    assert beyond.manifest.first()["blocked_media_count"] == 1


def test_page_states_stop_their_own_run_only(tmp_path, checked):
    folder = str(tmp_path / "state")
    assert resume.resume_ingest(some(checked, 3), folder, buckets=2).manifest.first()["stop_reason"] == "rate_limited"
    later = resume.resume_ingest(some(checked, 0), folder, buckets=2).manifest.first()
    assert later["Workflow_Status"] == "STOPPED_RATE_LIMIT"  # its audit still tells so
    plain = resume.resume_ingest(some(checked, 0, 1), str(tmp_path / "other"), buckets=2).manifest.first()
    assert plain["stop_reason"] == "captures_exhausted"


def test_batches_are_committed_once(spark, tmp_path, checked):
    folder = str(tmp_path / "state")
    resume.resume_ingest(some(checked, 0), folder, batch=0, buckets=2)
    resume.resume_ingest(checked, folder, batch=0, buckets=2)
    assert resume.open_state(spark, folder).processed().count() == 1
    resume.resume_ingest(some(checked, 0), folder, batch=1, buckets=2)
    assert resume.open_state(spark, folder).batch == 1


def test_candidates_listed_twice(spark, checked):
    listed = spark.createDataFrame([("N", 1, "HIGH", "COLLECT"), ("N", 0, "LOW", None), ("A", 2, "LOW", None)], "shortcode string, ord int, relevance_tier string, decision string")
    audits = run.ingest_run(checked, candidates=listed).audits.where("media_id = 'N'").collect()
    assert len(audits) == 2 and {a["relevance_tier"] for a in audits} == {"HIGH"} and {a["collection_status"] for a in audits} == {"COLLECT", "AUDIT_ONLY"}
    with pytest.raises(Exception, match="need an ord"):
        run.ingest_run(checked, candidates=listed.drop("ord")).audits.collect()


def test_null_counts_of_access_are_zero(checked):
    m = run.ingest_run(checked, automation={"access_control": {"rate_limit_count": None, "rate_limit_level": None, "post_batch_size": 7}}).manifest.first()
    assert (m["rate_limit_count"], m["rate_limit_level"], m["post_batch_size"]) == (0, 0, 7)


def test_a_cluster_must_name_its_shared_folder():
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))), master="spark://host:7077", applicationId="app")
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://x/shared/"}, sparkContext=context)
    assert tables.shared_folder(named) == "hdfs://x/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(SimpleNamespace(conf={}, sparkContext=context))
