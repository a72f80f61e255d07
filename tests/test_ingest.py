from __future__ import annotations

import json
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from chorusmill.operators import audit, ingest, merge, run
from chorusmill.schemas import AUDIT_FIELDS, CAPTURE_TAG, RAW_FIELDS
from chorusmill.sources import captures as sources
from chorusmill.sources import sinks
from chorusmill.streaming import incremental


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook(path):
    """Rows of every sheet, found as a reader finds them: by content types, relations and style references."""
    with zipfile.ZipFile(path) as z:
        parts = {n: ET.fromstring(z.read(n)) for n in z.namelist()}
    listed = {o.get("PartName").lstrip("/") for o in parts["[Content_Types].xml"] if o.get("PartName")}
    assert listed <= set(parts)
    styles = parts["xl/styles.xml"]
    assert [f.get("patternType") for f in styles.iter(f"{SHEET}patternFill")] == ["none", "gray125"] and all(len(f) == 1 for f in styles.iter(f"{SHEET}fill"))
    formats = len(styles.find(f"{SHEET}cellXfs"))
    targets = {r.get("Id"): r.get("Target") for r in parts["xl/_rels/workbook.xml.rels"]}
    out = {}
    for sheet in parts["xl/workbook.xml"].iter(f"{SHEET}sheet"):
        root = parts["xl/" + targets[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]]
        assert all(int(c.get("s")) < formats for c in root.iter(f"{SHEET}c"))
        assert [e.tag[len(SHEET):] for e in root] == ["sheetViews", "cols", "sheetData", "autoFilter"]
        out[sheet.get("name")] = [[float(c.findtext(f"{SHEET}v")) if c.get("t") is None else c.findtext(f"{SHEET}is/{SHEET}t") or "" for c in row] for row in root.iter(f"{SHEET}row")]
    return out


def comment(cid, text="hello", author="ann", parent=None, **more):
    return {"comment_id": cid, "parent_comment_id": parent, "author": author, "comment_text": text, "published_at": "2024-01-01T00:00:00Z"} | more


def capture(code, comments, page=None, **more):
    return {"schema_version": CAPTURE_TAG, "captured_at": "2024-01-02T00:00:00Z", "media": {"media_url": f"https://www.instagram.com/p/{code}/?utm=1", "owner": "o", **more.pop("media", {})}, "page": {"status": "ready", "coverage": "complete", "remaining_expand_controls": 0, **(page or {})}, "comments": comments} | more


def read(spark, folder, docs):
    for k, doc in enumerate(docs):
        (folder / f"c{k}.json").write_text("﻿" * (k % 2) + json.dumps(doc), encoding="utf-8")
    return ingest.checked(sources.read_captures(spark, str(folder / "*.json")))


def summary(checked, **options):
    good = ingest.valid(checked)
    reports = audit.capture_reports(good)
    blocked = reports.where("audit_status = 'BLOCKED'").select("ord")
    rows = ingest.comment_rows(good.join(blocked, "ord", "left_anti"), ["B000000001"], "q")
    unique = ingest.dedupe(rows.where(ingest.is_valid_row()))
    audits = audit.latest_audits(reports)
    listed = audits.select("media_id", F.col("deliverable_eligible").alias("eligible")).where("false")
    delivery = ingest.delivered(unique, listed)
    return audit.manifest(unique, delivery, audit.finished(audits, delivery), ingest.counters(rows), **options).first().asDict(), rows, unique


def test_two_captures_with_repeats(spark, tmp_path):
    first = [comment(f"{k}") for k in range(5)] + [comment("r1", parent="0"), comment(None, "no id")]
    second = [comment("0", "other text"), comment(None, "no id"), comment("9")]
    m, rows, unique = summary(read(spark, tmp_path, [capture("AAA", first), capture("AAA", second)]))
    assert (m["raw_captured_count"], m["technical_duplicate_count"], m["final_collected_count"], m["reply_count"]) == (10, 2, 8, 1)
    assert [c for c in unique.columns if c in RAW_FIELDS] == RAW_FIELDS and len(RAW_FIELDS) == 33
    kept = unique.where("comment_id = '0'").first()
    assert kept["comment_text"] == "hello" and kept["matched_queries"] == ["q"] and kept["username"] == kept["author"]
    assert unique.where("comment_id = 'r1'").first()["source_parent_id"] == "comment:0"


def test_mismatch_discards_and_fails(spark, tmp_path):
    wrong = capture("AAA", [comment("1", comment_url="https://www.instagram.com/p/BBB/c/1/")])
    m, _, _ = summary(read(spark, tmp_path, [wrong]))
    assert m["final_collected_count"] == 0 and m["shortcode_mismatch_count"] > 0 and m["quality_gate"] == "FAIL"


def test_partial_blocked_and_pass(spark, tmp_path):
    docs = [capture("A", [comment("1")], {"remaining_expand_controls": 2}), capture("B", [], {"status": "login_required"}), capture("C", [comment("2")], {"status": "login_required"}), capture("D", [comment("3", text=None)])]
    r = {x["media_id"]: x for x in audit.capture_reports(ingest.valid(read(spark, tmp_path, docs))).collect()}
    assert r["A"]["audit_status"] == "PARTIAL" and r["A"]["reason"] == "expand_controls_remaining"
    assert r["B"]["audit_status"] == "BLOCKED" and r["B"]["reason"] == "login_required"
    assert r["C"]["audit_status"] == "PARTIAL" and r["C"]["stop_reason"] == "login_required"
    assert r["D"]["audit_status"] == "PASS" and r["D"]["reason"] == "missing_comment_text"


def test_invalid_documents_and_rows(spark, tmp_path):
    bad = capture("A", [comment("1")])
    bad["schema_version"] = "other"
    checked = read(spark, tmp_path, [bad, capture("B", [comment(None, None), comment("x", None), comment(None, "t", author=" ")])])
    assert [x["error"] for x in ingest.rejected(checked).collect()] == ["schema_version"]
    m, rows, unique = summary(checked)
    assert (m["raw_captured_count"], m["invalid_row_count"], m["final_collected_count"], m["quality_gate"]) == (3, 2, 1, "WARNING")
    assert rows.where("comment_id = 'x'").first()["field_warnings"] == ["missing_comment_text"]


def test_targets(spark, tmp_path):
    checked = read(spark, tmp_path, [capture("A", [comment("1"), comment("2")]), capture("B", [comment("3")]), capture("C", [comment("4")])])
    m, rows, _ = summary(checked, target=1, soft=True)
    assert m["Coverage_Status"] == "SOFT_TARGET_MET" and m["target_shortfall_reason"] is None and m["final_collected_count"] == 4
    assert ingest.target_prefix(rows, 3).count() == 3 and ingest.target_prefix(rows, 2).count() == 2


def test_stop_reason_priority(spark):
    stop = lambda seen, **o: spark.range(1).select(audit.stop_reason(F.array(*map(F.lit, seen)), F.lit(5), o.pop("target", 0), o.pop("soft", False), **o)).first()[0]
    assert stop(["semantic_low_audit_only", "rate_limited"]) == "rate_limited"
    assert stop(["other"]) == "captures_exhausted"
    assert stop(["max_rounds"], target=5) == "target_comments_reached"
    assert stop(["max_rounds"], target=5, soft=True) == "max_rounds"
    assert stop(["max_rounds"], automation="semantic_saturation") == "semantic_saturation"


def test_ineligible_stays_internal(spark, tmp_path):
    _, _, unique = summary(read(spark, tmp_path, [capture("A", [comment("1")]), capture("B", [comment("2")])]))
    listed = spark.createDataFrame([("A", False)], "media_id string, eligible boolean")
    assert [r["media_id"] for r in ingest.delivered(unique, listed).collect()] == ["B"]


def test_retry_merge(spark):
    rows = spark.createDataFrame([(0, 0, "A", "1", "ann", None, "old", None), (0, 1, "A", None, "bob", None, "t", "1"), (1, 0, "A", "1", "ann", None, "new", None)], "attempt int, pos int, shortcode string, comment_id string, author string, username string, comment_text string, parent_comment_id string")
    got = {r["author"]: r for r in merge.retry_merge(rows).collect()}
    assert got["ann"]["comment_text"] == "new" and tuple(got["ann"]["place"]) == (0, 0) and got["bob"]["parent_comment_id"] == "1"
    known = merge.keep_known_by_id(spark.createDataFrame([(0, "1", "a"), (1, "1", "b")], "ord int, comment_id string, t string"), spark.createDataFrame([(0, "1", "c"), (1, "2", "d"), (2, None, "e")], "ord int, comment_id string, t string"))
    assert sorted((r["comment_id"], r["t"]) for r in known.collect()) == [("1", "b"), ("2", "d")]


def test_candidate_dedupe_order(spark):
    rows = spark.createDataFrame([(0, "https://www.instagram.com/p/ABC123/", "one", None, ["B"]), (1, "https://instagram.com/u/reel/ZZ_9/", "two", None, None), (2, "https://www.instagram.com/reel/ABC123/", "two", ["One", "three"], ["A"]), (3, "https://x.com/p/Q/", "n", None, None)], "ord int, url string, source_query string, matched_queries array<string>, matched_asins array<string>")
    got = merge.dedupe_candidates(rows).orderBy("ord").collect()
    assert [r["shortcode"] for r in got] == ["ABC123", "ZZ_9"] and got[0]["matched_queries"] == ["one", "two", "three"] and got[0]["matched_asins"] == ["B", "A"]


def test_sinks(spark, tmp_path):
    _, _, unique = summary(read(spark, tmp_path / "in" if (tmp_path / "in").mkdir() is None else tmp_path, [capture("A", [comment("1", "say \"hi\", 狗\nx")])]))
    sinks.write_jsonl(unique, str(tmp_path / "rows"))
    back = sources.read_rows(spark, str(tmp_path / "rows"))
    assert back.count() == 1 and back.first()["comment_text"] == 'say "hi", 狗\nx'
    assert sources.read_rows(spark, str(tmp_path / "nothing")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"comment_id": "1"}\n\n{broken\n')
    assert sources.read_rows(spark, str(tmp_path / "bad"), strict=False).count() == 1
    sinks.write_csv_file(unique, RAW_FIELDS, str(tmp_path / "r.csv"))
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and '""hi""' in raw.decode("utf-8-sig") and '["B000000001"]'.replace('"', '""') in raw.decode("utf-8-sig")
    sinks.write_workbook(str(tmp_path / "w.xlsx"), [("Raw_Comments", RAW_FIELDS, sinks.sheet_rows(unique, RAW_FIELDS)), ("Media_Audit", AUDIT_FIELDS, [])])
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert "狗" in z.read("xl/worksheets/sheet1.xml").decode() and z.read("xl/worksheets/sheet2.xml").decode().count("<row") == 1
    assert workbook(tmp_path / "w.xlsx")["Raw_Comments"][0] == RAW_FIELDS
    assert sinks.column_letters(1) == "A" and sinks.column_letters(27) == "AA" and sinks.column_letters(703) == "AAA"


def test_single_files_are_joined_from_parts(spark, tmp_path):
    import csv as plain

    rows = [(k, f'a "quoted" {k}', None if k % 3 else "x,y\r\nz", [str(k)] if k % 2 else None, "狗 \t") for k in range(25)]
    table = spark.createDataFrame(rows, "k int, a string, b string, c array<string>, d string")
    for name, t, want in (("full", table.repartition(4, "k").sortWithinPartitions("k"), 25), ("none", table.where("false"), 0)):
        sinks.write_csv_file(t, ["k", "a", "b", "c", "absent", "d"], str(tmp_path / f"{name}.csv"))
        with open(tmp_path / f"{name}.csv", encoding="utf-8-sig", newline="") as f:
            header, *got = list(plain.reader(f))
        assert header == ["k", "a", "b", "c", "absent", "d"] and len(got) == want
        expected = [[str(k), a, b or "", json.dumps(c) if c else "", "", d] for k, a, b, c, d in rows] if want else []
        assert sorted(got) == sorted(expected)
        sinks.write_json_array(t, str(tmp_path / f"{name}.json"))
        assert sorted(r["k"] for r in json.loads((tmp_path / f"{name}.json").read_text(encoding="utf-8"))) == list(range(want))
    sinks.write_csv_file(table.limit(1), ["k"], str(tmp_path / "full.csv"))  # takes the other's place
    assert (tmp_path / "full.csv").read_text(encoding="utf-8-sig").split() == ["k", "0"]
    with pytest.raises(Exception, match="broken"):
        sinks.write_json_array(table.withColumn("k", F.raise_error(F.lit("broken"))), str(tmp_path / "full.json"))
    assert len(json.loads((tmp_path / "full.json").read_text(encoding="utf-8"))) == 25
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["full.csv", "full.json", "none.csv", "none.json"]


def test_asins(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ASIN,b000000002\nB000000003,\n")
    (tmp_path / "q.csv").write_text('ASIN,"B000000004"\n"B000000005, B000000006",x\n')
    quoted = sources.asins(spark, file=str(tmp_path / "q.csv"))
    with pytest.raises(Exception, match="not an ASIN: B000000005, B000000006"):
        quoted.collect()
    got = sources.asins(spark, ["b000000001"], "B000000002, B000000001", str(tmp_path / "a.csv")).orderBy("ord")
    assert [r["asin"] for r in got.collect()] == ["B000000001", "B000000002", "B000000003"]


def test_incremental_rerun_is_a_no_op(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(capture("A", [comment("1"), comment("2")])))
    incremental.run(spark, str(folder), state)
    assert incremental.unique_rows(spark, state).count() == 2
    (folder / "copy.json").write_text((folder / "a.json").read_text())
    (folder / "b.json").write_text(json.dumps(capture("A", [comment("2", "later"), comment("3")])))
    incremental.run(spark, str(folder), state)
    incremental.run(spark, str(folder), state)
    rows = {r["comment_id"]: r["comment_text"] for r in incremental.unique_rows(spark, state).collect()}
    assert rows == {"1": "hello", "2": "hello", "3": "hello"} and incremental.processed(spark, state).count() == 2


def test_captures_without_comments_and_strict(spark, tmp_path):
    bare = capture("A", [])
    del bare["comments"]
    (tmp_path / "x.json").write_text("{broken")
    checked = read(spark, tmp_path, [bare, capture("B", None), capture("C", [comment("1")])])
    assert sorted((r["error"] or "", r["ord"].rsplit("/", 1)[1].removeprefix("c")) for r in checked.collect()) == [("", "0.json"), ("", "1.json"), ("", "2.json"), ("schema_version", "x.json")]
    assert [r["captured_rows"] for r in audit.capture_reports(ingest.valid(checked)).orderBy("ord").collect()] == [0, 0, 1]
    with pytest.raises(Exception, match="invalid capture: schema_version"):
        ingest.strict(checked).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_captures(spark, str(tmp_path / "*.json"), strict=True).collect()


def test_run_writes_everything(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docs = [capture("A", [comment("1"), comment("1", "again"), comment("2", "x" * 40)]), capture("L", [comment("9")]), capture("B", [], {"status": "login_required"})]
    checked = read(spark, tmp_path / "in", docs)
    listed = [("A", "HIGH", True, "COLLECT", None, "o", 0), ("L", "LOW", False, "AUDIT_ONLY", None, "o", 0), ("N", "LOW", False, None, None, "owner", 3)]
    candidates = spark.createDataFrame(listed, "shortcode string, relevance_tier string, deliverable_eligible boolean, decision string, stop_reason string, owner string, shortcode_mismatch_count int")
    done = run.ingest_run(checked, ["B000000001"], "q", candidates, known_asins=["B000000000"])
    plan = spark.createDataFrame([("a", "f", "s", True, 1, 0)], "query string, family string, generation_source string, executed boolean, posts_found int, qualified_posts int")
    said = sinks.write_run(done, str(tmp_path / "out"), plan)["manifest"]
    assert (said["raw_captured_count"], said["technical_duplicate_count"], said["internal_raw_unique_count"], said["final_collected_count"]) == (4, 1, 3, 2)
    assert said["amazon_asins"] == ["B000000000", "B000000001"] and said["stop_reason"] == "login_required" and said["quality_gate"] == "FAIL" and said["shortcode_mismatch_count"] == 3
    audits = {a["media_id"]: a for a in json.loads((tmp_path / "out" / "post_audit.json").read_text())}
    assert audits["L"]["collection_status"] == "EXCLUDED_FROM_DELIVERABLE" and audits["N"]["media_owner"] == "owner" and audits["N"]["collection_status"] == "AUDIT_ONLY" and audits["N"]["audit_status"] == "PARTIAL"
    sheets = workbook(tmp_path / "out" / "raw_comments.xlsx")
    assert [len(rows) for rows in sheets.values()] == [3, 5, 2, len(said), 8] and list(sheets) == ["Raw_Comments", "Media_Audit", "Query_Plan", "Run_Summary", "Quality_Gate"]
    assert ["raw_rows_equal_csv_rows", "true"] in sheets["Quality_Gate"] and sheets["Query_Plan"][1][4] == 1.0
    later = audit.patched(done.manifest, {"rate_limit_count": 2, "recovery_phase": "ramp"}).first()
    assert (later["rate_limit_count"], later["recovery_phase"], later["post_batch_size"]) == (2, "ramp", 5)
    hard = run.ingest_run(checked, target=2).manifest.first()
    assert (hard["final_collected_count"], hard["media_count"], hard["target_reached"], hard["stop_reason"]) == (2, 1, True, "target_comments_reached")


def test_parents_with_one_id_do_not_multiply(spark):
    rows = spark.createDataFrame([(0, 0, "A", "1", None, "ann"), (1, 0, "A", "1", None, "bob"), (2, 0, "A", "2", "1", "cid")], "ord int, pos int, media_id string, comment_id string, parent_comment_id string, author string")
    got = ingest.lineage(rows).orderBy("ord").collect()
    assert [(r["ord"], r["parent_author"]) for r in got] == [(0, None), (1, None), (2, "ann")]


def test_known_rows_and_blank_authors(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text('{"comment_id": "1", "author": "a"}\n{"comment_id": "", "author": "b"}\n{bad\n{"comment_id": "1", "author": "c"}\n')
    assert [r["author"] for r in sources.read_known(spark, str(tmp_path / "k.jsonl")).collect()] == ["c"]
    assert sources.read_candidates(spark, str(tmp_path / "none.json")).count() == 0
    rows = spark.createDataFrame([(0, 0, "A", None, "", "ann", "t"), (1, 0, "A", None, None, "ann", "t")], "attempt int, pos int, shortcode string, comment_id string, author string, username string, comment_text string")
    assert merge.retry_merge(rows).count() == 1
