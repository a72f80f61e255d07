"""Queries over whole captures: conversations as captures of media, two captures to a media, with every state a page may have.

The SQL builds the same captures row by row and repeats the rules on its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import audit, ingest, merge, relevance, resume, run, state
from ..schemas import CAPTURE_TAG, COMMENT, RAW_COMMENT, RAW_FIELDS
from ..sources import captures as sources
from ..sources import sinks
from ..tables import shared_folder
from .registry import query, table

NO_TEXT = "array<string>"
OWN_ASIN = "B000000009"


def _by(number, cases: dict[int, object], kind: str, otherwise=None):
    """A value for each remainder."""
    out = F.lit(otherwise).cast(kind)
    for k, v in cases.items():
        out = F.when(number == k, (v if hasattr(v, "cast") else F.lit(v)).cast(kind)).otherwise(out)
    return out


def captures(spark, d) -> DataFrame:
    """Captures with ord = conv_id."""
    c, t = F.col("conv_id"), F.col("turn")
    media = (c % 50).cast("string")
    idless = t % 3 == 2
    same = idless & (c % 7 == 2)
    other = F.when((c % 17 == 0) & (t == 1), "https://www.instagram.com/p/ZZ/").when((c % 19 == 0) & (t == 0), "https://example.com/x")
    named = (t % 2 == 0) | ((c % 5 == 0) & (c % 10 != 0))
    address = F.coalesce(other, F.when(named, F.concat(F.lit("https://www.instagram.com/p/M"), media, F.lit("/c/"), t.cast("string"), F.lit("/"))))
    body = F.when((c + t) % 13 == 0, None).when((c + t) % 13 == 1, "  ").otherwise(F.when(same, "same words").otherwise(F.col("text")))
    none = F.lit(None).cast("string")
    comment = F.struct(
        F.when(idless, "  ").otherwise(F.concat_ws("-", media, t.cast("string"), "role")).alias("comment_id"),
        F.when(t % 2 == 1, F.concat_ws("-", media, (t - 1).cast("string"), F.lit("user"))).alias("parent_comment_id"), F.when(t % 7 == 6, 1).alias("depth"),
        F.when(same, "ann").when(t % 5 == 4, None).otherwise(F.col("role")).alias("author"), body.alias("comment_text"), F.when(t % 4 != 3, "2024-01-01").alias("published_at"),
        none.alias("published_label"), F.lit("1").alias("like_count"), address.alias("comment_url"),
        F.struct(F.when(t % 2 == 0, "HIGH").alias("tier"), F.lit(0.5).alias("score"), F.array(F.lit("x")).alias("evidence_terms"), none.alias("reason")).alias("semantic"),
    ).cast(COMMENT)
    each = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", comment.alias("c")))), lambda x: x["c"]).alias("all"))
    n, code = F.size("all"), F.concat(F.lit("M"), media)
    address = F.when(c % 31 == 0, F.concat(F.lit("http://www.instagram.com/p/"), code, F.lit("/")))
    address = address.otherwise(F.concat(F.lit("https://www.instagram.com/"), F.when(c % 2 == 0, "p").otherwise("reels"), F.lit("/"), code, F.lit("/?utm=1")))
    discovery = F.struct(
        F.array(F.concat(F.lit("B00000000"), (c % 3).cast("string"))).alias("matched_asins"), F.array(F.concat(F.lit("q"), (c % 4).cast("string")), F.concat(F.lit("r"), (c % 5).cast("string"))).alias("matched_queries"),
        _by(c % 3, {0: "HIGH", 1: "LOW"}, "string").alias("relevance_tier"), (c % 10 / 10.0).alias("relevance_score"), F.lit(None).cast(NO_TEXT).alias("evidence_terms"),
        F.when(c % 8 == 0, False).alias("deliverable_eligible"), F.when(c % 43 == 0, 1).alias("shortcode_mismatch_count"), none.alias("discovery_url"), none.alias("discovery_media_type"),
    )
    page = F.struct(
        _by(c % 11, {0: "login_required", 2: "rate_limited", 3: "odd_state", **{k: "ready" for k in range(4, 11)}}, "string").alias("status"), F.when(c % 3 == 0, "visible_only").otherwise("complete").alias("coverage"),
        F.when(c % 5 == 0, True).when(c % 37 == 1, False).alias("identity_verified"), _by(c % 4, {0: n + 1, 1: n}, "int").alias("visible_comment_count"),
        F.when(c % 6 == 1, 2).when(c % 6 != 0, 0).alias("remaining_expand_controls"), F.when(c % 7 == 0, n + 3).when(c % 7 != 1, n).alias("platform_comment_count"),
        F.when(c % 41 == 0, 2).alias("shortcode_mismatch_count"), none.alias("actual_shortcode"), F.when(c % 41 == 0, F.array(F.lit("OTHER"))).alias("observed_shortcodes"),
    )
    ledger = F.transform(F.sequence(F.lit(1), (c % 3 + 1).cast("int")), lambda k: F.struct(k.alias("round")))
    scroll = F.struct(
        (c % 9).cast("int").alias("round_count"), (c % 5).cast("int").alias("expand_action_count"), (c % 6).cast("int").alias("scroll_action_count"), F.lit(None).cast("int").alias("attempt_count"),
        F.when(c % 13 == 0, "max_rounds").alias("stop_reason"), F.lit(None).cast(NO_TEXT).alias("expanded_thread_signatures"), F.lit(None).cast("map<string,string>").alias("scroll_frontier"), ledger.alias("action_ledger"),
    )
    navigation = F.struct(
        none.alias("requested_url"), none.alias("rendered_url"), none.alias("working_media_url"), none.alias("requested_media_type"), none.alias("rendered_media_type"),
        (c % 2).cast("int").alias("route_fallback_attempt_count"), F.lit(None).cast("int").alias("route_fallback_success_count"),
    )
    return each.select(
        c.alias("ord"), F.when(c % 29 != 0, CAPTURE_TAG).otherwise("other").alias("schema_version"), F.lit("2024-01-02T00:00:00Z").alias("captured_at"),
        F.struct(address.alias("media_url"), none.alias("media_id"), F.concat(F.lit("o"), (c % 3).cast("string")).alias("owner"), discovery.alias("discovery")).alias("media"),
        page.alias("page"), F.when(c % 23 != 0, F.col("all")).alias("comments"), scroll.alias("continuous_scroll"), navigation.alias("navigation"),
    )


#: com: comments; cap: captures with their states; acc: accepted comments of valid captures with their counts; aud: audits.
CAPTURES = """WITH com AS (SELECT conv_id AS c, turn AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, conv_id % 50 AS m,
  CASE WHEN turn % 3 <> 2 THEN (conv_id % 50) || '-' || turn || '-' || role END AS cid, CASE WHEN turn % 2 = 1 THEN (conv_id % 50) || '-' || (turn - 1) || '-user' END AS parent,
  CASE WHEN turn % 3 = 2 AND conv_id % 7 = 2 THEN 'ann' WHEN turn % 5 <> 4 THEN role END AS author,
  CASE (conv_id + turn) % 13 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE CASE WHEN turn % 3 = 2 AND conv_id % 7 = 2 THEN 'same words' ELSE text END END AS body,
  CASE WHEN conv_id % 17 = 0 AND turn = 1 THEN 'other' WHEN conv_id % 19 = 0 AND turn = 0 THEN 'none' WHEN turn % 2 = 0 OR (conv_id % 5 = 0 AND conv_id % 10 <> 0) THEN 'own' END AS link
  FROM conversations WHERE conv_id % 23 <> 0),
cap AS (SELECT conv_id AS c, 'M' || (conv_id % 50) AS code, CASE WHEN conv_id % 2 = 0 THEN 'p' ELSE 'reel' END AS kind, count(*) AS n,
  CASE WHEN conv_id % 29 = 0 THEN 'schema_version' WHEN conv_id % 31 = 0 THEN 'media_url' END AS error,
  CASE conv_id % 11 WHEN 0 THEN 'login_required' WHEN 1 THEN NULL WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'odd_state' ELSE 'ready' END AS status,
  conv_id % 3 <> 0 AS complete, conv_id % 5 = 0 AS strict, conv_id % 5 <> 0 AND conv_id % 37 = 1 AS denied, CASE conv_id % 4 WHEN 0 THEN count(*) + 1 WHEN 1 THEN count(*) END AS visible,
  CASE conv_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 0 END AS remaining, CASE conv_id % 7 WHEN 0 THEN count(*) + 3 WHEN 1 THEN NULL ELSE count(*) END AS platform,
  CASE WHEN conv_id % 41 = 0 THEN 2 ELSE 0 END AS own_wrong, CASE conv_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS tier FROM conversations GROUP BY conv_id),
wrong AS (SELECT cap.c, any_value(greatest(own_wrong, denied::INT)) + count(com.c) FILTER (WHERE link IN ('other', 'none') OR (link IS NULL AND strict)) AS mismatch FROM cap LEFT JOIN com USING (c) GROUP BY 1),
acc AS (SELECT com.* FROM com JOIN cap USING (c) JOIN wrong USING (c) WHERE error IS NULL AND mismatch = 0),
cnt AS (SELECT c, count(*) AS rows_, count(*) FILTER (WHERE trim(coalesce(body, '')) <> '') AS texts, count(*) FILTER (WHERE cid IS NOT NULL) AS ids, count(*) FILTER (WHERE parent IS NOT NULL OR t % 7 = 6) AS replies FROM acc GROUP BY 1),
sta AS (SELECT cap.*, mismatch, coalesce(rows_, 0) AS rows_, coalesce(texts, 0) AS texts, coalesce(replies, 0) AS replies, coalesce(c % 43 = 0, false)::INT AS found_wrong,
  CASE WHEN mismatch > 0 THEN 'MEDIA_ID_MISMATCH' ELSE coalesce(status, 'unknown') END AS page_status FROM cap JOIN wrong USING (c) LEFT JOIN cnt USING (c) WHERE error IS NULL),
aud AS (SELECT *, page_status IN ('login_required', 'captcha', 'rate_limited', 'private', 'unavailable', 'blocked', 'MEDIA_ID_MISMATCH') AS barred,
  CASE WHEN page_status IN ('login_required', 'captcha', 'rate_limited', 'private', 'unavailable', 'blocked', 'MEDIA_ID_MISMATCH') THEN CASE WHEN rows_ > 0 THEN 'PARTIAL' ELSE 'BLOCKED' END
  WHEN complete AND remaining = 0 AND (visible IS NULL OR visible <= rows_) THEN 'PASS' ELSE 'PARTIAL' END AS audit FROM sta)
"""
#: rws: accepted rows with their technical key and validity; uniq: the first row of each key.
KEYED = """, rws AS (SELECT *, CASE WHEN cid IS NOT NULL THEN 'id:' || cid ELSE 'x:' || m || ':' || coalesce(author, '?') || ':' || coalesce(body, '?') END AS key, cid IS NOT NULL OR (author IS NOT NULL AND coalesce(body, '') <> '') AS ok FROM acc),
uniq AS (SELECT DISTINCT ON (key) * FROM rws WHERE ok ORDER BY key, c, pos)
"""


@query(CAPTURES + """ SELECT cap.c AS ord, error, CASE WHEN error IS NULL THEN mismatch END AS mismatch, CASE WHEN error IS NULL THEN CASE WHEN mismatch = 0 AND c % 23 <> 0 THEN n ELSE 0 END END AS accepted
FROM cap JOIN wrong USING (c)""")
def capture_validation(spark, d):
    c = ingest.checked(captures(spark, d))
    good = F.col("error").isNull()
    return c.select("ord", "error", F.when(good, F.col("mismatch").cast("long")).alias("mismatch"), F.when(good, F.size("accepted").cast("long")).alias("accepted"))


@query(CAPTURES + f""" SELECT c AS ord, pos, cid AS comment_id, CASE WHEN parent IS NOT NULL THEN 'comment:' || parent ELSE 'media:M' || m END AS source_parent_id, CASE WHEN t % 7 = 6 OR parent IS NOT NULL THEN 1 ELSE 0 END AS depth,
 concat_ws(';', CASE WHEN cid IS NULL THEN 'missing_comment_id' END, CASE WHEN author IS NULL THEN 'missing_author' END, CASE WHEN coalesce(body, '') = '' THEN 'missing_comment_text' END, CASE WHEN t % 4 = 3 THEN 'missing_published_at' END,
  CASE WHEN t % 7 = 6 AND parent IS NULL THEN 'reply_parent_unresolved' END) AS warnings, 'B00000000' || (c % 3) || ',{OWN_ASIN}' AS asins, 'asked' AS matched_query, 'q' || (c % 4) || ',r' || (c % 5) || ',asked' AS queries,
 CASE WHEN c % 2 = 0 THEN 'p' ELSE 'reel' END AS media_type, 'o' || (c % 3) AS media_owner, coalesce(author, '') AS username, CASE WHEN t % 2 = 0 THEN 'HIGH' END AS comment_tier, cid IS NOT NULL OR (author IS NOT NULL AND coalesce(body, '') <> '') AS valid FROM acc""")
def comment_fields(spark, d):
    r = ingest.comment_rows(ingest.valid(ingest.checked(captures(spark, d))), [OWN_ASIN], "asked")
    join = lambda c, by=",": F.array_join(c, by)
    return r.select(
        "ord", F.col("pos").cast("long").alias("pos"), "comment_id", "source_parent_id", "depth", join("field_warnings", ";").alias("warnings"), join("amazon_asins").alias("asins"), "matched_query", join("matched_queries").alias("queries"),
        "media_type", "media_owner", F.coalesce("username", F.lit("")).alias("username"), F.col("comment_relevance_tier").alias("comment_tier"), ingest.is_valid_row().alias("valid"),
    )


@query(CAPTURES + """ SELECT c AS ord, code AS media_id, kind AS media_type, audit AS audit_status, page_status, rows_ AS captured_rows, texts AS text_rows, replies AS reply_rows, rows_ - replies AS main_comment_rows, mismatch + found_wrong AS mismatches,
 CASE WHEN c % 13 = 0 THEN 'max_rounds' ELSE page_status END AS stop_reason, CASE WHEN c % 8 = 0 THEN false ELSE coalesce(tier = 'HIGH', false) END AS eligible, c % 2 AS route_attempts,
 concat_ws(';', CASE WHEN audit = 'BLOCKED' THEN page_status END, CASE WHEN audit = 'PARTIAL' AND barred THEN 'access_restricted_after_visible_capture:' || page_status END, CASE WHEN audit = 'PARTIAL' AND NOT complete THEN 'visible_only_or_unknown_coverage' END,
  CASE WHEN audit = 'PARTIAL' AND remaining IS NULL THEN 'expand_frontier_unverified' END, CASE WHEN audit = 'PARTIAL' AND remaining > 0 THEN 'expand_controls_remaining' END, CASE WHEN audit = 'PARTIAL' AND visible > rows_ THEN 'visible_count_gap' END,
  CASE WHEN audit = 'PARTIAL' AND platform > rows_ THEN 'platform_count_gap' END, CASE WHEN texts < rows_ THEN 'missing_comment_text' END, CASE WHEN ids_ < rows_ THEN 'missing_comment_id' END, CASE WHEN mismatch > 0 THEN 'MEDIA_ID_MISMATCH' END) AS reason
FROM aud JOIN (SELECT aud.c, count(acc.c) AS ids_ FROM aud LEFT JOIN acc USING (c) GROUP BY 1) USING (c)""")
def capture_audits(spark, d):
    r = audit.capture_reports(ingest.valid(ingest.checked(captures(spark, d))))
    long = lambda c: F.col(c).cast("long")
    return r.select(
        "ord", "media_id", "media_type", "audit_status", "page_status", *(long(c).alias(c) for c in ("captured_rows", "text_rows", "reply_rows", "main_comment_rows")), long("shortcode_mismatch_count").alias("mismatches"),
        "stop_reason", F.col("deliverable_eligible").alias("eligible"), long("route_fallback_attempt_count").alias("route_attempts"), "reason",
    )


def _rows(spark, d) -> DataFrame:
    return ingest.comment_rows(ingest.valid(ingest.checked(captures(spark, d))))


@query(CAPTURES + KEYED + """ SELECT u.c AS ord, u.pos, u.cid AS comment_id, (SELECT string_agg(DISTINCT 'B00000000' || (r.c % 3), ',' ORDER BY 'B00000000' || (r.c % 3)) FROM rws r WHERE r.key = u.key AND r.ok) AS asins,
 'q' || (u.c % 4) || ',r' || (u.c % 5) || coalesce((SELECT ',' || string_agg(q, ',' ORDER BY first) FROM (SELECT 'q' || (r.c % 4) AS q, min(r.c) AS first FROM rws r WHERE r.key = u.key AND r.ok AND r.c % 4 <> u.c % 4 GROUP BY 1)), '') AS queries FROM uniq u""")
def capture_dedupe(spark, d):
    u = ingest.dedupe(_rows(spark, d).where(ingest.is_valid_row()))
    return u.select("ord", F.col("pos").cast("long").alias("pos"), "comment_id", F.array_join("amazon_asins", ",").alias("asins"), F.array_join("matched_queries", ",").alias("queries"))


@query(CAPTURES + KEYED + " SELECT count(*) AS raw_captured_count, count(*) FILTER (WHERE NOT ok) AS invalid_row_count, count(*) FILTER (WHERE ok) - count(DISTINCT key) FILTER (WHERE ok) AS technical_duplicate_count FROM rws")
def capture_counters(spark, d):
    return ingest.counters(_rows(spark, d))


def candidates(spark, d) -> DataFrame:
    """Seventy media, fifty of which may have captures."""
    k = F.col("k")
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").select((F.col("doc_id") % 70).alias("k")).distinct().select(
        F.concat(F.lit("M"), k.cast("string")).alias("shortcode"), k.alias("ord"), F.lit("p").alias("media_type"), F.concat(F.lit("https://www.instagram.com/p/M"), k.cast("string"), F.lit("/")).alias("url"), F.concat(F.lit("w"), (k % 3).cast("string")).alias("owner"),
        F.when(k % 2 == 0, "reel").alias("rendered_media_type"), none.alias("working_media_url"), _by(k % 3, {0: "HIGH", 1: "LOW", 2: "MEDIUM"}, "string").alias("relevance_tier"), (k % 10 / 10.0).alias("relevance_score"),
        F.array(F.lit("e")).alias("evidence_terms"), F.when(k % 4 != 0, k % 3 != 1).alias("deliverable_eligible"), F.when(k % 5 != 0, F.when(k % 3 == 1, "AUDIT_ONLY").otherwise("COLLECT")).alias("decision"),
        F.when(k % 11 == 0, "max_rounds").alias("stop_reason"), F.when(k == 61, 2).alias("shortcode_mismatch_count"), (k % 2).cast("int").alias("route_fallback_attempt_count"), F.lit(1).alias("route_fallback_success_count"),
    )


LISTED = """, cand AS (SELECT DISTINCT doc_id % 70 AS k, 'M' || (doc_id % 70) AS code, CASE doc_id % 70 % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS ctier, coalesce(CASE WHEN doc_id % 70 % 4 <> 0 THEN doc_id % 70 % 3 <> 1 END, false) AS celigible,
  CASE WHEN doc_id % 70 % 5 <> 0 THEN CASE WHEN doc_id % 70 % 3 = 1 THEN 'AUDIT_ONLY' ELSE 'COLLECT' END END AS decision, CASE WHEN doc_id % 70 % 11 = 0 THEN 'max_rounds' END AS cstop FROM documents),
syn AS (SELECT *, coalesce(cstop, CASE WHEN ctier = 'LOW' THEN 'semantic_low_audit_only' ELSE 'target_posts_budget' END) AS stop, coalesce(decision, 'AUDIT_ONLY') AS status FROM cand WHERE code NOT IN (SELECT code FROM aud)),
last AS (SELECT DISTINCT ON (code) * FROM aud ORDER BY code, c DESC),
deliv AS (SELECT u.*, 'M' || u.m AS code FROM uniq u LEFT JOIN cand ON cand.code = 'M' || u.m WHERE coalesce(celigible, true)),
fin AS (SELECT l.code AS media_id, coalesce(ctier, CASE WHEN celigible IS NULL THEN tier END) AS tier, audit, rows_, mismatch + found_wrong AS mismatches, CASE WHEN c % 13 = 0 THEN 'max_rounds' ELSE page_status END AS stop, c % 2 AS routes, 0 AS routes_ok, 'o' || (c % 3) AS owner, NULL AS rendered,
  coalesce(celigible, CASE WHEN c % 8 = 0 THEN false ELSE coalesce(tier = 'HIGH', false) END) AS eligible, 'COLLECTED' AS status FROM last l LEFT JOIN cand USING (code)
 UNION ALL SELECT code, ctier, 'PARTIAL', 0, CASE WHEN k = 61 THEN 2 ELSE 0 END, stop, k % 2, 1, 'w' || (k % 3), CASE WHEN k % 2 = 0 THEN 'reel' END, celigible, status FROM syn)
"""


def _run(spark, d) -> run.IngestRun:
    return run.ingest_run(ingest.checked(captures(spark, d)), candidates=candidates(spark, d), known_asins=[OWN_ASIN])


@query(CAPTURES + KEYED + LISTED + """ SELECT media_id, tier, audit AS audit_status, mismatches, stop AS stop_reason, routes AS route_attempts, routes_ok AS route_successes, owner, rendered AS rendered_media_type, eligible,
 CASE WHEN NOT eligible AND rows_ > 0 THEN 'EXCLUDED_FROM_DELIVERABLE' ELSE status END AS collection_status, (SELECT count(*) FROM deliv WHERE deliv.code = media_id) AS final_rows FROM fin""")
def run_audits(spark, d):
    a = _run(spark, d).audits
    long = lambda c: F.col(c).cast("long")
    return a.select(
        "media_id", F.col("relevance_tier").alias("tier"), "audit_status", long("shortcode_mismatch_count").alias("mismatches"), "stop_reason", long("route_fallback_attempt_count").alias("route_attempts"),
        F.col("route_fallback_success_count").alias("route_successes"), F.col("media_owner").alias("owner"), "rendered_media_type", F.col("deliverable_eligible").alias("eligible"), "collection_status", F.col("final_unique_comment_count").alias("final_rows"),
    )


@query(CAPTURES + KEYED + LISTED + f""" SELECT 'asin_research' AS run_mode, '{OWN_ASIN}' AS asins, (SELECT count(*) FROM rws) AS raw_captured_count, (SELECT count(*) FROM rws WHERE NOT ok) AS invalid_row_count,
 (SELECT count(*) FROM uniq) AS internal_raw_unique_count, (SELECT count(*) FROM deliv) AS final_collected_count, (SELECT count(*) FROM uniq) - (SELECT count(*) FROM deliv) AS deliverable_excluded_count,
 (SELECT count(*) FROM deliv WHERE parent IS NOT NULL OR t % 7 = 6) AS reply_count, count(*) AS media_count, count(*) FILTER (WHERE audit = 'PASS') AS pass_media_count, count(*) FILTER (WHERE audit = 'BLOCKED') AS blocked_media_count,
 count(*) FILTER (WHERE tier IN ('HIGH', 'MEDIUM')) AS qualified_candidate_count, count(*) FILTER (WHERE stop = 'semantic_low_audit_only') AS low_audit_only_count, sum(mismatches)::BIGINT AS mismatches, sum(routes)::BIGINT AS route_attempts,
 (SELECT arg_max(page_status, c) FROM aud WHERE audit = 'BLOCKED' OR page_status IN ('login_required', 'captcha', 'rate_limited', 'private', 'unavailable', 'blocked')) AS stop_reason,
 CASE WHEN sum(mismatches) > 0 THEN 'FAIL' WHEN bool_and(audit = 'PASS') AND (SELECT count(*) FROM rws WHERE NOT ok) = 0 THEN 'PASS' ELSE 'WARNING' END AS quality_gate, 0 AS standalone, 20::DOUBLE AS navigation_delay, 'target' AS goal FROM fin""")
def run_manifest(spark, d):
    m = _run(spark, d).manifest
    same = ["raw_captured_count", "invalid_row_count", "internal_raw_unique_count", "final_collected_count", "deliverable_excluded_count", "reply_count", "media_count", "pass_media_count", "blocked_media_count", "qualified_candidate_count", "low_audit_only_count"]
    return m.select(
        "run_mode", F.array_join("amazon_asins", ",").alias("asins"), *same, F.col("shortcode_mismatch_count").alias("mismatches"), F.col("route_fallback_attempt_count").alias("route_attempts"), "stop_reason", "quality_gate",
        F.col("standalone_media_records").alias("standalone"), F.col("navigation_delay_min_seconds").alias("navigation_delay"), F.col("collection_goal").alias("goal"),
    )


# ---- files ------------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/chorusmill-run/{name}-{uuid.uuid4().hex}"


@query(CAPTURES + """ SELECT cap.c AS ord, error, CASE WHEN error IS NULL THEN mismatch END AS mismatch, CASE WHEN error IS NULL THEN CASE WHEN mismatch = 0 AND c % 23 <> 0 THEN n ELSE 0 END END AS accepted, true AS hashed
FROM cap JOIN wrong USING (c)""")
def captures_from_files(spark, d):
    """Captures written as JSON files, one a capture, and read again as files."""
    folder = _folder(spark, "capture-files")
    captures(spark, d).withColumn("captured_at", F.col("ord").cast("string")).drop("ord").write.option("maxRecordsPerFile", 1).json(folder)
    c = ingest.checked(sources.read_captures(spark, f"{folder}/*.json"))
    good = F.col("error").isNull()
    return c.select(
        F.col("captured_at").cast("long").alias("ord"), "error", F.when(good, F.col("mismatch").cast("long")).alias("mismatch"), F.when(good, F.size("accepted").cast("long")).alias("accepted"),
        F.col("fingerprint").rlike("^[0-9a-f]{64}$").alias("hashed"),
    )


@query(CAPTURES + KEYED + " SELECT u.c AS ord, u.pos, u.cid AS comment_id, u.author, md5(u.body) AS text_md5, 'q' || (u.c % 4) AS matched_query, CASE WHEN u.parent IS NOT NULL OR u.t % 7 = 6 THEN 1 ELSE 0 END AS depth FROM uniq u")
def rows_from_jsonl(spark, d):
    """Unique rows written as JSON lines, and read again strictly."""
    folder = _folder(spark, "raw-comments")
    unique = ingest.dedupe(_rows(spark, d).where(ingest.is_valid_row()))
    sinks.write_jsonl(unique, folder)
    r = sources.read_rows(spark, folder, schema=f"ord long, pos int, {RAW_COMMENT}")
    return r.select("ord", F.col("pos").cast("long").alias("pos"), "comment_id", "author", F.md5(F.col("comment_text").cast("binary")).alias("text_md5"), "matched_query", "depth")


@query(CAPTURES + KEYED + " SELECT coalesce(u.cid, '') AS comment_id, coalesce(u.author, '') AS author, md5(coalesce(u.body, '')) AS text_md5, 'q' || (u.c % 4) AS matched_query, 'M' || u.m AS media_id FROM uniq u")
def rows_from_csv(spark, d):
    """Unique rows written as one CSV file, and read again."""
    path = _folder(spark, "raw-comments") + ".csv"
    sinks.write_csv_file(ingest.dedupe(_rows(spark, d).where(ingest.is_valid_row())), RAW_FIELDS, path)
    r = spark.read.csv(path, header=True, multiLine=True, escape='"', lineSep="\r\n", emptyValue="")
    text = lambda c: F.coalesce(c, F.lit(""))
    return r.select(text("comment_id").alias("comment_id"), text("author").alias("author"), F.md5(text("comment_text").cast("binary")).alias("text_md5"), "matched_query", "media_id")


@query("SELECT 'P' || lpad(p_partkey::VARCHAR, 9, '0') AS asin, 2 AS source FROM part UNION ALL SELECT 'B000000001', 0")
def asin_file(spark, d):
    """ASINs of one argument, then of a CSV file with a header, lower case and repeats."""
    path = _folder(spark, "asins") + ".csv"
    p = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "p").otherwise("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("a"))
    sinks.write_joined(p.orderBy("p_partkey").select(F.concat_ws(",", F.col("a"), F.lit(""), F.when(F.col("p_partkey") % 3 == 0, F.upper("a"))).alias("value")), path, begin="ASIN,,asin\n")
    found = sources.asins(spark, ["b000000001"], file=path)
    return found.select("asin", F.col("ord.source").alias("source"))


def _resumed(spark, d) -> run.IngestRun:
    """Three runs into one state: each gets all captures so far, so what earlier runs had comes again; then the last one again."""
    folder = f"{shared_folder(spark)}/chorusmill-run/state-{uuid.uuid4().hex}"
    every = ingest.checked(captures(spark, d)).withColumn("fingerprint", F.sha2(F.col("ord").cast("string"), 256))
    for upto in (0, 1, 2, 2):
        done = resume.resume_ingest(every.where(F.col("ord") % 3 <= upto), folder, [OWN_ASIN], candidates=candidates(spark, d), buckets=8)
    return done


ARRIVED = KEYED.replace("ORDER BY key, c, pos", "ORDER BY key, c % 3, c, pos")


@query(CAPTURES + ARRIVED + f""" SELECT u.c AS ord, u.pos, u.cid AS comment_id, u.author, md5(coalesce(u.body, '')) AS text_md5,
 (SELECT string_agg(DISTINCT a, ',' ORDER BY a) FROM (SELECT 'B00000000' || (r.c % 3) AS a FROM rws r WHERE r.key = u.key AND r.ok UNION ALL SELECT '{OWN_ASIN}')) AS asins,
 'q' || (u.c % 4) || ',r' || (u.c % 5) || coalesce((SELECT ',' || string_agg(q, ',' ORDER BY first) FROM (SELECT 'q' || (r.c % 4) AS q, min(row(r.c % 3, r.c)) AS first
  FROM rws r WHERE r.key = u.key AND r.ok AND r.c % 4 <> u.c % 4 GROUP BY 1)), '') AS queries FROM uniq u""")
def resumed_rows(spark, d):
    rows = _resumed(spark, d).rows
    text_md5 = F.md5(F.coalesce("comment_text", F.lit("")).cast("binary"))
    return rows.select(
        F.substring_index("ord", "/", -1).cast("long").alias("ord"), F.col("pos").cast("long").alias("pos"), "comment_id", "author", text_md5.alias("text_md5"),
        F.array_join("amazon_asins", ",").alias("asins"), F.array_join("matched_queries", ",").alias("queries"),
    )


@query(CAPTURES + ARRIVED + LISTED.replace("ORDER BY code, c DESC", "ORDER BY code, c % 3 DESC, c DESC") + """ SELECT media_id, tier, audit AS audit_status, mismatches, stop AS stop_reason, routes AS route_attempts, owner, eligible,
 CASE WHEN NOT eligible AND rows_ > 0 THEN 'EXCLUDED_FROM_DELIVERABLE' ELSE status END AS collection_status, (SELECT count(*) FROM deliv WHERE deliv.code = media_id) AS final_rows,
 (SELECT count(*) FROM rws) AS raw_rows, (SELECT count(*) FROM rws WHERE NOT ok) AS invalid_rows, (SELECT count(*) FROM rws WHERE ok) - (SELECT count(*) FROM uniq) AS duplicate_rows FROM fin""")
def resumed_audits(spark, d):
    done = _resumed(spark, d)
    counts = done.manifest.select(F.col("raw_captured_count").alias("raw_rows"), F.col("invalid_row_count").alias("invalid_rows"), F.col("technical_duplicate_count").alias("duplicate_rows"))
    long = lambda c: F.col(c).cast("long")
    audits = done.audits.select(
        "media_id", F.col("relevance_tier").alias("tier"), "audit_status", long("shortcode_mismatch_count").alias("mismatches"), "stop_reason", long("route_fallback_attempt_count").alias("route_attempts"),
        F.col("media_owner").alias("owner"), F.col("deliverable_eligible").alias("eligible"), "collection_status", F.col("final_unique_comment_count").alias("final_rows"),
    )
    return audits.crossJoin(counts)  # one row on that side


@query(CAPTURES + """, ck AS (SELECT cap.*, CASE WHEN c % 21 = 0 THEN 'N' || (c % 50) ELSE code END AS want, CASE WHEN c % 31 = 0 THEN NULL ELSE code END AS own FROM cap),
ls AS (SELECT c, CASE link WHEN 'own' THEN 'M' || m WHEN 'other' THEN 'ZZ' END AS lc FROM com),
es AS (SELECT ck.c, count(lc) FILTER (WHERE lc <> want OR lc <> coalesce(own, '')) AS bad, list(lc) AS codes, count(ls.c) AS said FROM ck LEFT JOIN ls USING (c) GROUP BY 1),
fn AS (SELECT ck.*, own_wrong + (NOT strict)::INT + (own IS NULL OR own <> want)::INT + bad AS wrong, list_sort(list_distinct(list_filter(list_concat(list_concat(CASE WHEN own_wrong > 0 THEN ['OTHER'] ELSE [] END, [own]), codes), lambda x: x IS NOT NULL))) AS seen, said FROM ck JOIN es USING (c))
SELECT c AS ord, wrong AS mismatches, array_to_string(seen, ',') AS observed, CASE WHEN status IS NOT NULL AND status NOT IN ('ready', 'unknown') AND said = 0 THEN 'BLOCKED' WHEN said >= platform THEN 'PASS' ELSE 'PARTIAL' END AS collected,
 CASE WHEN wrong > 0 THEN 0 ELSE said END AS kept, CASE WHEN wrong > 0 THEN 'MEDIA_ID_MISMATCH' ELSE status END AS status FROM fn""")
def collection_identity(spark, d):
    c = captures(spark, d)
    want = F.when(F.col("ord") % 21 == 0, "N").otherwise("M")
    c = c.withColumn("shortcode", F.concat(want, (F.col("ord") % 50).cast("string")))
    check = identity.collection_check(F.col("shortcode"), F.col("media"), F.col("page"), F.col("comments"))
    n = F.size(F.coalesce("comments", F.array()))
    status = audit.collection_status(F.col("page.status"), n, F.col("page.platform_comment_count"))
    first = c.select("ord", check.alias("x"), status.alias("collected")).select("ord", F.col("x.mismatch_count").cast("long").alias("mismatches"), F.array_join("x.observed_shortcodes", ",").alias("observed"), "collected")
    guard = run.identity_guard(c).select("ord", F.size(F.coalesce("comments", F.array())).cast("long").alias("kept"), F.col("page.status").alias("status"))
    return first.join(guard, "ord")


@query(CAPTURES + """, k AS (SELECT com.*, CASE WHEN t % 3 <> 2 THEN 'id:' || cid WHEN true THEN 'id:  ' END AS key FROM com),
each AS (SELECT m, count(DISTINCT key) AS comments FROM k GROUP BY 1), v AS (SELECT c % 50 AS m, count(*) AS tries, max(platform) AS platform, sum(c % 3 + 1)::BIGINT AS ledger, max(c) AS last, max(c) FILTER (WHERE c % 3 <> 0) AS valid FROM cap GROUP BY 1)
SELECT 'M' || v.m AS shortcode, coalesce(comments, 0) AS comments, platform, ledger, tries AS attempts, last, valid AS result_of, CASE WHEN valid IS NOT NULL THEN (SELECT count(*) FROM com WHERE com.c = valid) END AS result_rows,
 CASE WHEN valid IS NOT NULL THEN tries - 1 END AS retries FROM v LEFT JOIN each USING (m)""")
def attempts_merged(spark, d):
    c = captures(spark, d).withColumns({"shortcode": F.concat(F.lit("M"), (F.col("ord") % 50).cast("string")), "attempt": F.col("ord")})
    m = run.merged_captures(c)
    r = run.results(c.withColumns({"valid": F.col("ord") % 3 != 0, "capture_path": F.col("ord").cast("string")}))
    r = r.select("shortcode", F.col("capture_path").cast("long").alias("result_of"), F.col("comment_count").cast("long").alias("result_rows"), F.col("retry_count").cast("long").alias("retries"))
    m = m.select(
        "shortcode", F.size("comments").cast("long").alias("comments"), F.col("page.platform_comment_count").cast("long").alias("platform"), F.size("continuous_scroll.action_ledger").cast("long").alias("ledger"),
        F.col("continuous_scroll.attempt_count").cast("long").alias("attempts"), F.col("attempt").alias("last"),
    )
    return m.join(r, "shortcode", "left")


# ---- candidates and rounds ------------------------------------------------------------------------


@query("""WITH k AS (SELECT DISTINCT doc_id % 70 AS k FROM documents), c AS (SELECT k, 'M' || k AS code, CASE k % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS tier, coalesce(CASE WHEN k % 4 <> 0 THEN k % 3 <> 1 END, false) AS eligible,
 CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 3 = 1 THEN 'AUDIT_ONLY' ELSE 'COLLECT' END END AS decision FROM k),
top AS (SELECT code, row_number() OVER (ORDER BY CASE tier WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, k % 10 DESC, k) AS n FROM c WHERE decision = 'COLLECT' AND k % 7 = 3)
SELECT code AS shortcode, CASE WHEN code IN (SELECT code FROM top WHERE n <= 5) THEN 'priority' ELSE 'other' END AS turn, eligible AND k >= 35 AS fresh, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 2 = 0 THEN 'new' ELSE 'old' END AS caption,
 CASE WHEN k % 2 = 0 THEN 'https://www.instagram.com/reel/M' || k || '/' ELSE 'https://www.instagram.com/p/M' || k || '/' END AS address, (SELECT sum(k2.k)::BIGINT FROM c k2 WHERE k2.eligible) AS total FROM c""")
def candidate_state(spark, d):
    c = candidates(spark, d).withColumn("caption", F.lit("old"))
    k = F.col("ord")
    first = run.priority_subset(c, c.where(k % 7 == 3).select("shortcode")).select("shortcode", F.lit("priority").alias("turn"))
    fresh = run.newly_eligible(c, c.where(k < 35)).select("shortcode", F.lit(True).alias("fresh"))
    seen = c.where(k % 2 == 0).select("shortcode", F.when(k % 6 == 0, None).otherwise("new").alias("caption"), F.array(F.lit("caption")).alias("present"))
    total = run.eligible_total(c.select("shortcode", k.alias("comment_count")), c)
    out = merge.with_inspection(c, seen).join(first, "shortcode", "left").join(fresh, "shortcode", "left").crossJoin(total)  # one row on that side
    address = merge.collection_url(F.col("shortcode"), F.col("working_media_url"), F.col("rendered_media_type"), F.col("media_type"))
    return out.select("shortcode", F.coalesce("turn", F.lit("other")).alias("turn"), F.coalesce("fresh", F.lit(False)).alias("fresh"), "caption", address.alias("address"), "total")


@query("""WITH e AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS done, count(*) FILTER (WHERE event_type = 'signup') AS exp, count(*) FILTER (WHERE event_type = 'purchase') AS streak FROM events GROUP BY 1)
SELECT user_id, CASE WHEN n = 0 THEN 'seed' WHEN done < n - user_id % 3 OR user_id % 10 = 0 THEN 'open' WHEN exp = 0 THEN 'expansion' WHEN user_id % 2 = 0 AND streak < 2 THEN 'evidence' ELSE 'none' END AS round,
 user_id % 4 <> 0 AS soft, n % 3 = 0 OR (done % 2 = 0 AND exp < CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END) AS collect, CASE WHEN n % 3 <> 0 THEN 1 ELSE 3 END AS attempts,
 CASE WHEN user_id % 7 = 0 THEN 'manual_stop' WHEN user_id % 5 = 0 THEN 'captcha' WHEN exp >= 12 THEN 'comment_container_not_ready' WHEN streak >= 2 AND done % 2 = 0 THEN 'visible_comments_exhausted' WHEN streak >= 2 THEN 'idle_rounds' END AS stop FROM e""")
def round_choice(spark, d):
    e = table(spark, d, "events")
    n = lambda test: F.count_if(test).alias
    kind = F.col("event_type")
    u = e.groupBy("user_id").agg(F.count("*").alias("n"), n(kind != "error")("done"), n(kind == "signup")("exp"), n(kind == "purchase")("streak"))
    who, even = F.col("user_id"), F.col("done") % 2 == 0
    known = F.col("n") % 3 != 0
    asked = run.round_kind(F.col("n"), F.col("done") + who % 3, F.col("exp"), F.col("streak"), who % 2 == 0, who % 10 == 0)
    allowed = F.when(who % 2 == 0, run.retry_allowed(known, even, F.col("exp"), 1, True)).otherwise(run.retry_allowed(known, even, F.col("exp"), 1, False))
    goal = F.when(who % 4 == 1, state.MAXIMIZE).when(who % 4 == 0, "target")
    soft = state.soft_target(goal, who % 4 > 1)
    stop = state.round_stop(who % 7 == 0, F.when(who % 5 == 0, "captcha").otherwise("ready"), F.col("exp"), F.when(F.col("streak") >= 2, "idle_rounds"), even)
    return u.select("user_id", asked.alias("round"), soft.alias("soft"), allowed.alias("collect"), run.attempts_allowed(known, 2).alias("attempts"), stop.alias("stop"))


@query("""WITH s AS (SELECT user_id % 40 AS job, event_id, event_type, value, ts FROM events), l AS (SELECT job, event_type, arg_max(event_id, (ts, event_id)) AS v FROM s GROUP BY 1, 2)
SELECT job, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS progress, (SELECT count(*) FROM s WHERE s.job = l.job) AS rounds, (SELECT arg_max(s.event_id, (ts, event_id)) FROM s WHERE s.job = l.job) AS last FROM l GROUP BY job""")
def job_progress(spark, d):
    e = table(spark, d, "events").withColumns({"job": F.col("user_id") % 40, "seq": F.struct("ts", "event_id")})
    p = run.progress(e.select(F.col("job").alias("job_id"), "seq", F.create_map("event_type", F.col("event_id").cast("string")).alias("progress")))
    pairs = F.array_join(F.transform(F.map_entries("progress"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    last = run.snapshots(e.select("job", "event_id", "seq"), ["job"], "seq").select("job", "rounds", F.col("event_id").alias("last"))
    return p.select(F.col("job_id").alias("job"), pairs.alias("progress")).join(last, "job")


@query("""WITH f AS (SELECT source || lang AS code, min(doc_id % 97) AS q FROM documents GROUP BY 1), n AS (SELECT q, count(*) AS n FROM f GROUP BY 1), b AS (SELECT q, coalesce(sum(n) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT DISTINCT doc_id % 97 AS q FROM documents) LEFT JOIN n USING (q))
SELECT q FROM b WHERE before < 6""")
def query_budget(spark, d):
    found = table(spark, d, "documents").select((F.col("doc_id") % 97).alias("q"), F.concat("source", "lang").alias("shortcode"))
    return state.query_prefix(found, "q", 6)


# ---- rules ----------------------------------------------------------------------------------------

#: Two profiles of one brand and category that differ in their problem, so they score alike.
TWINS = [("A", "from"), ("B", "for")]


@query("""WITH t AS (SELECT lower(text) AS x FROM documents), h AS (SELECT contains(x, 'that') AS b, contains(x, 'with') AS c, contains(x, 'from') AS p0, contains(x, 'for') AS p1 FROM t),
s AS (SELECT *, CASE WHEN b THEN 0.35::DOUBLE ELSE 0::DOUBLE END + CASE WHEN c THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS base FROM h),
r AS (SELECT *, base + CASE WHEN p0 THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS s0, base + CASE WHEN p1 THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS s1 FROM s),
v AS (SELECT *, CASE WHEN b AND c THEN greatest(s0, 0.7::DOUBLE) WHEN b AND p0 AND s0 >= 0.5::DOUBLE THEN s0 ELSE least(s0, 0.49::DOUBLE) END AS v0, CASE WHEN b AND c THEN greatest(s1, 0.7::DOUBLE) WHEN b AND p1 AND s1 >= 0.5::DOUBLE THEN s1 ELSE least(s1, 0.49::DOUBLE) END AS v1 FROM r),
w AS (SELECT *, v1 > round(v0, 3) AS second FROM v)
SELECT CASE WHEN second THEN round(v1, 3) ELSE round(v0, 3) END AS score, concat_ws(',', CASE WHEN b THEN 'that' END, CASE WHEN c THEN 'with' END, CASE WHEN NOT second AND p0 THEN 'from' END, CASE WHEN second AND p1 THEN 'for' END) AS terms, count(*) AS n FROM w GROUP BY 1, 2""")
def relevance_twins(spark, d):
    empty = F.array().cast(NO_TEXT)
    p = spark.createDataFrame([(k, a, pain) for k, (a, pain) in enumerate(TWINS)], "profile_ord int, asin string, pain string")
    lists = {c: empty for c in ("core_functions", "use_scenarios", "competitors", "product_aliases", "ingredients", "keywords")}
    p = p.withColumns({"brand": F.lit("that"), "product_name": F.lit("xq"), "category": F.lit("with"), "pain_points": F.array("pain"), **lists})
    m = table(spark, d, "documents").select(F.create_map(F.lit("caption"), "text").alias("evidence"))
    s = relevance.score_media(m, p)
    return s.groupBy(F.col("relevance_score").alias("score"), F.array_join("evidence_terms", ",").alias("terms")).agg(F.count("*").alias("n"))


NOTES = [
    ("HTTP Error 429", ""), ("http429 again", ""), ("captcha: too many requests", "https://x.example/accounts/login/"), ("rate limited", ""), ("rate_limit_count", ""), ("Please try AGAIN later", ""), ("请稍后再试", ""), ("操作过于频繁", ""),
    ("Sorry, this page isn't available.", ""), ("Log in to Instagram", ""), ("登录 Instagram", ""), ("fine", "https://x.example/accounts/login?next=1"), ("fine", ""),
]
_NOTES_SQL = "SELECT text AS x, '' AS u FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(a.replace("'", "''"), b) for a, b in NOTES) + ")"


def _notes(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("text").alias("x"), F.lit("").alias("u")).unionAll(spark.createDataFrame(NOTES, "x string, u string"))


@query(rf"""WITH t AS ({_NOTES_SQL}) SELECT regexp_matches(x, 'http\s*(error\s*)?429|too many requests|try again later|rate[_ -]?limited|操作过于频繁', 'i') AS limited,
 CASE WHEN regexp_matches(x, 'http error 429|too many requests|try again later|操作过于频繁', 'i') THEN 'rate_limited' WHEN regexp_matches(x, 'sorry, this page isn.?t available|page not available|页面不可用', 'i') THEN 'unavailable'
  WHEN regexp_matches(x, 'log in to instagram|登录 instagram', 'i') OR contains(u, '/accounts/login') THEN 'login_required' END AS page_error, count(*) AS n FROM t GROUP BY 1, 2""")
def page_notes(spark, d):
    t = _notes(spark, d).withColumn("record", F.struct(F.lit(7).alias("rate_limit_count"), F.array(F.create_map(F.lit("rate limited"), "x")).alias("seen")))
    limited = text.has_rate_limit(F.col("record"), t.schema["record"].dataType)
    return t.groupBy(limited.alias("limited"), text.visible_error(F.col("x"), F.col("u")).alias("page_error")).agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT p_partkey, p_name || ' 犬 ' || p_size || CASE p_partkey % 3 WHEN 0 THEN ' a/b' WHEN 1 THEN ' ~c* (d)' ELSE '' END AS q FROM part)
SELECT p_partkey, 'https://www.google.com/search?q=' || replace(url_encode('site:instagram.com/p/ OR site:instagram.com/reel/ ' || q), '%2F', '/') AS search, 'https://www.instagram.com/explore/tags/' || lower(regexp_replace(q, '[^A-Za-z0-9]+', '', 'g'))[1:80] || '/' AS tag FROM q""")
def search_addresses(spark, d):
    k = F.col("p_partkey") % 3
    q = F.concat("p_name", F.lit(" 犬 "), F.col("p_size").cast("string"), F.when(k == 0, " a/b").when(k == 1, " ~c* (d)").otherwise(""))
    return table(spark, d, "part").select("p_partkey", text.search_url(q).alias("search"), text.tag_url(q).alias("tag"))


@query("""WITH l AS (SELECT doc_id, n_chars, CASE doc_id % 8 WHEN 0 THEN ' View  all ' || doc_id || ' more comments ' WHEN 1 THEN 'load previous comments (' || n_chars || ')' WHEN 2 THEN 'Show ' || doc_id || ' replies' WHEN 3 THEN '查看全部' || doc_id || '条评论' WHEN 4 THEN 'Open comments' WHEN 5 THEN 'No comments yet.' WHEN 6 THEN n_chars || ' likes' ELSE source END AS x, source FROM documents)
SELECT doc_id, doc_id % 8 < 4 AS expansion, doc_id % 8 = 4 AS trigger_label, doc_id % 8 = 5 AS empty_label, CASE WHEN doc_id % 8 = 6 THEN n_chars::VARCHAR END AS likes, CASE WHEN doc_id % 8 < 7 THEN trim(regexp_replace(x, '\\s+', ' ', 'g')) || ' | ' || source ELSE source END AS combined,
 source || doc_id AS author, '#' || source || ',#t' || doc_id AS tags, 'first ' || doc_id || ' last' AS own_text, doc_id % 3 <> 0 AS truth FROM l""")
def label_rules(spark, d):
    k, name = F.col("doc_id"), F.col("doc_id").cast("string")
    forms = {
        0: F.concat(F.lit(" View  all "), name, F.lit(" more comments ")), 1: F.concat(F.lit("load previous comments ("), F.col("n_chars"), F.lit(")")), 2: F.concat(F.lit("Show "), name, F.lit(" replies")),
        3: F.concat(F.lit("查看全部"), name, F.lit("条评论")), 4: F.lit("Open comments"), 5: F.lit("No comments yet."), 6: F.concat(F.col("n_chars"), F.lit(" likes")), 7: F.col("source"),
    }
    r = table(spark, d, "documents").withColumn("x", _by(k % 8, forms, "string"))
    x = F.col("x")
    card = F.concat(F.lit("ann\nfirst "), name, F.lit("\nReply\n3 likes\nmore\n2d\nlast"))
    tags = F.concat(F.lit("a #"), F.col("source"), F.lit(" #t"), name, F.lit(", #"), F.col("source"))
    return r.select(
        "doc_id", text.is_expansion_label(x).alias("expansion"), text.is_trigger_label(x).alias("trigger_label"), text.is_empty_label(x).alias("empty_label"), text.like_text(x).alias("likes"), text.combined_label(F.array(x, F.col("source"), F.lit(" "))).alias("combined"),
        text.author_name(F.concat(F.lit(" @"), F.col("source"), name, F.lit(" Verified "))).alias("author"), F.array_join(text.hashtags(tags), ",").alias("tags"),
        text.own_text(card, F.lit("ann"), F.array(F.lit("more")), F.lit("2d")).alias("own_text"), text.truth(F.when(k % 3 == 0, " No ").otherwise(name)).alias("truth"),
    )
