"""Media audits, run manifest, stop reasons and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page states that bar a capture, and observed stop reasons by priority.
RESTRICTED = ["login_required", "captcha", "rate_limited", "private", "unavailable", "blocked", "MEDIA_ID_MISMATCH"]
STOP_PRIORITY = ["login_required", "rate_limited", "comment_container_not_ready", "unavailable", "max_rounds", "visible_comments_exhausted", "target_posts_budget", "semantic_low_audit_only", "semantic_saturation"]
REVIEWED = ["relevance_tier", "relevance_score", "evidence_terms", "evidence_sources", "matched_groups", "group_hits", "relevance_reason", "relevance_model_version"]


def _has(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def audit_status(status: Column, coverage: Column, remaining: Column, visible: Column, rows: Column) -> Column:
    """Ingest's rule: complete coverage with nothing left to expand passes."""
    complete = F.coalesce((coverage == "complete") & (remaining == 0), F.lit(False)) & (visible.isNull() | (visible <= rows))
    return F.when(status.isin(RESTRICTED), F.when(rows > 0, "PARTIAL").otherwise("BLOCKED")).when(complete, "PASS").otherwise("PARTIAL")


def collection_status(status: Column, rows: Column, platform_total: Column) -> Column:
    """The collection's rule: any state but none, ready and unknown bars; as many rows as the platform shows pass."""
    barred = F.coalesce(~status.isin("ready", "unknown"), F.lit(False))
    return F.when(barred & (rows == 0), "BLOCKED").when(F.coalesce(rows >= platform_total, F.lit(False)), "PASS").otherwise("PARTIAL")


def audit_reasons(status: Column, audit: Column, coverage: Column, remaining: Column, visible: Column, platform: Column, rows: Column, texts: Column, ids: Column, mismatch: Column) -> Column:
    """The reasons in their fixed order, joined by semicolons."""
    partial, barred = audit == "PARTIAL", status.isin(RESTRICTED)
    said = [
        F.when(audit == "BLOCKED", status), F.when(partial & barred, F.concat(F.lit("access_restricted_after_visible_capture:"), status)),
        F.when(partial & F.coalesce(coverage != "complete", F.lit(True)), F.lit("visible_only_or_unknown_coverage")), F.when(partial & remaining.isNull(), F.lit("expand_frontier_unverified")),
        F.when(partial & (remaining > 0), F.lit("expand_controls_remaining")), F.when(partial & (visible > rows), F.lit("visible_count_gap")), F.when(partial & (platform > rows), F.lit("platform_count_gap")),
        F.when(texts < rows, F.lit("missing_comment_text")), F.when(ids < rows, F.lit("missing_comment_id")), F.when(mismatch > 0, F.lit("MEDIA_ID_MISMATCH")),
    ]
    return F.array_join(F.filter(F.array(*said), lambda r: r.isNotNull()), ";")


def capture_reports(captures: DataFrame) -> DataFrame:
    """One audit per checked, valid capture (ingest.checked); counts by array functions, so nothing is exploded."""
    page, d, nav, scroll = F.col("page"), F.col("media.discovery"), F.col("navigation"), F.col("continuous_scroll")
    c = captures.withColumns({
        "rows": F.size("accepted"), "texts": F.size(F.filter("accepted", lambda x: F.trim(F.coalesce(x["comment_text"], F.lit(""))) != "")),
        "ids": F.size(F.filter("accepted", lambda x: _has(x["comment_id"]))), "replies": F.size(F.filter("accepted", lambda x: _has(x["parent_comment_id"]) | (F.coalesce(x["depth"], F.lit(0)) > 0))),
        "status": F.when(F.col("mismatch") > 0, "MEDIA_ID_MISMATCH").otherwise(F.coalesce(F.nullif(page["status"], F.lit("")), F.lit("unknown"))),
    })
    status, rows = F.col("status"), F.col("rows")
    c = c.withColumn("audit", audit_status(status, page["coverage"], page["remaining_expand_controls"], page["visible_comment_count"], rows))
    reason = audit_reasons(status, F.col("audit"), page["coverage"], page["remaining_expand_controls"], page["visible_comment_count"], page["platform_comment_count"], rows, F.col("texts"), F.col("ids"), F.col("mismatch"))
    zero = F.lit(0)
    return c.select(
        "ord", F.col("ident.media_id").alias("media_id"), F.col("ident.media_type").alias("media_type"), F.col("ident.media_url").alias("media_url"), d["discovery_media_type"].alias("discovery_media_type"), d["discovery_url"].alias("discovery_url"),
        nav["requested_media_type"].alias("requested_media_type"), nav["requested_url"].alias("requested_url"), nav["rendered_media_type"].alias("rendered_media_type"), nav["rendered_url"].alias("rendered_url"), nav["working_media_url"].alias("working_media_url"),
        F.coalesce(nav["route_fallback_attempt_count"], zero).alias("route_fallback_attempt_count"), F.coalesce(nav["route_fallback_success_count"], zero).alias("route_fallback_success_count"), F.col("media.owner").alias("media_owner"),
        F.col("audit").alias("audit_status"), d["relevance_tier"].alias("relevance_tier"), d["relevance_score"].alias("relevance_score"), F.coalesce(d["evidence_terms"], F.array().cast("array<string>")).alias("evidence_terms"),
        F.coalesce(d["deliverable_eligible"], d["relevance_tier"].isin("HIGH", "MEDIUM"), F.lit(False)).alias("deliverable_eligible"), F.lit("COLLECTED").alias("collection_status"), status.alias("page_status"),
        rows.alias("captured_rows"), F.col("texts").alias("text_rows"), (F.col("mismatch") + F.coalesce(d["shortcode_mismatch_count"], zero)).alias("shortcode_mismatch_count"), F.col("ids").alias("stable_id_rows"), F.col("replies").alias("reply_rows"),
        (rows - F.col("replies")).alias("main_comment_rows"), page["visible_comment_count"].alias("visible_comment_count"), page["remaining_expand_controls"].alias("remaining_expand_controls"), page["platform_comment_count"].alias("platform_comment_count"),
        scroll["expand_action_count"].alias("expand_action_count"), scroll["round_count"].alias("scroll_round_count"), scroll["scroll_action_count"].alias("scroll_action_count"), F.coalesce(F.nullif(scroll["stop_reason"], F.lit("")), status).alias("stop_reason"),
        reason.alias("reason"), "captured_at",
    )


def latest_audits(reports: DataFrame) -> DataFrame:
    """The last capture's audit per media."""
    return reports.groupBy("media_id").agg(F.max_by(F.struct(*reports.columns), "ord").alias("r"), F.min("ord").alias("place")).select("r.*", "place")


#: What an audit of a media that was never captured takes from its candidate as it is (fixed values).
CARRIED = [
    "discovery_media_type", "discovery_url", "requested_media_type", "requested_url", "rendered_media_type", "rendered_url",
    "working_media_url", "relevance_tier", "relevance_score", "evidence_terms",
]
CARRIED_COUNTS = ["route_fallback_attempt_count", "route_fallback_success_count", "shortcode_mismatch_count"]
ZERO_COUNTS = ["captured_rows", "text_rows", "stable_id_rows", "main_comment_rows", "reply_rows", "expand_action_count", "scroll_round_count", "scroll_action_count"]


def synthetic_audits(candidates: DataFrame, audits: DataFrame) -> DataFrame:
    """Audits of candidates that were never captured, with the candidate's routes, owner, relevance and mismatches.

    Candidate columns that are absent count as null. A candidate that is listed twice gives one row per listing.
    """
    captured = audits.select(F.col("media_id").alias("shortcode")).distinct()
    left = candidates.where(_has(F.col("shortcode"))).join(captured, "shortcode", "left_anti")
    have = lambda c, kind="string": F.col(c) if c in candidates.columns else F.lit(None).cast(kind)
    kinds = {"relevance_score": "double", "evidence_terms": "array<string>"}
    decision = F.coalesce(F.nullif(have("decision"), F.lit("")), F.lit("AUDIT_ONLY"))
    stop = F.coalesce(F.nullif(have("stop_reason"), F.lit("")), F.when(have("relevance_tier") == "LOW", "semantic_low_audit_only").otherwise("target_posts_budget"))
    values = {"media_id": F.col("shortcode"), "media_type": have("media_type"), "media_url": have("url"), "media_owner": have("owner")}
    values |= {c: have(c, kinds.get(c, "string")) for c in CARRIED}
    values["evidence_terms"] = F.coalesce(values["evidence_terms"], F.array().cast("array<string>"))
    values |= {c: F.coalesce(have(c, "int"), F.lit(0)).cast("int") for c in CARRIED_COUNTS} | {c: F.lit(0) for c in ZERO_COUNTS}
    values |= {c: F.lit(None).cast("int") for c in ("visible_comment_count", "remaining_expand_controls", "platform_comment_count")}
    values |= {"audit_status": F.lit("PARTIAL"), "page_status": F.lit("not_collected"), "stop_reason": stop, "reason": F.lower(decision)}
    values |= {"captured_at": F.lit(None).cast("string"), "collection_status": decision, "deliverable_eligible": F.coalesce(have("deliverable_eligible", "boolean"), F.lit(False))}
    return left.select(*(v.alias(k) for k, v in values.items()))


def reviewed(audits: DataFrame, review: DataFrame) -> DataFrame:
    """Audits with the review's values where its keys are present (`present` lists them); a present null replaces too.

    A listed media without eligibility is not eligible; one that is not listed keeps its own.
    """
    keys = [k for k in REVIEWED if k in review.columns]
    side = review.select(F.col("shortcode").alias("media_id"), F.lit(True).alias("_listed"), F.col("present").alias("_present"), F.coalesce("deliverable_eligible", F.lit(False)).alias("_eligible"), *(F.col(k).alias(f"_r_{k}") for k in keys))
    out = audits.join(side, "media_id", "left")
    for k in keys:
        out = out.withColumn(k, F.when(F.array_contains("_present", k), F.col(f"_r_{k}")).otherwise(F.col(k) if k in audits.columns else F.lit(None)))
    own = F.coalesce("deliverable_eligible", F.col("relevance_tier").isin("HIGH", "MEDIUM"), F.lit(False))
    out = out.withColumn("deliverable_eligible", F.when(F.col("_listed"), F.col("_eligible")).otherwise(own))
    return out.drop("_listed", "_present", "_eligible", *(f"_r_{k}" for k in keys))


def finished(audits: DataFrame, delivery: DataFrame) -> DataFrame:
    """final_unique_comment_count by one grouped join, and the status of captured but excluded media."""
    counts = delivery.groupBy("media_id").agg(F.count("*").alias("_n"))
    out = audits.join(counts, "media_id", "left").withColumn("final_unique_comment_count", F.coalesce("_n", F.lit(0))).drop("_n")
    return out.withColumn("collection_status", F.when(~F.col("deliverable_eligible") & (F.col("captured_rows") > 0), "EXCLUDED_FROM_DELIVERABLE").otherwise(F.col("collection_status")))


def last_restriction(reports: DataFrame) -> DataFrame:
    """One row: the page state of the last capture that was barred (null if none was)."""
    barred = (F.col("audit_status") == "BLOCKED") | (F.col("page_status").isin(RESTRICTED) & (F.col("page_status") != "MEDIA_ID_MISMATCH"))
    return reports.agg(F.max_by("page_status", F.when(barred, F.col("ord"))).alias("_checkpoint"))


def stop_reason(observed: Column, delivered: Column, target: int, soft: bool, automation: str | None = None, checkpoint: Column | str | None = None) -> Column:
    """The run's stop reason from the set of observed ones."""
    first = F.coalesce(*(F.when(F.array_contains(observed, r), F.lit(r)) for r in STOP_PRIORITY), F.lit("captures_exhausted"))
    kept = checkpoint if isinstance(checkpoint, Column) else F.lit(checkpoint).cast("string")
    base = F.lit(automation) if automation in ("rate_limited", "semantic_saturation") else F.coalesce(F.nullif(kept, F.lit("")), first)
    return F.when((delivered >= target) & F.lit(bool(target) and not soft), "target_comments_reached").otherwise(base)


def workflow_status(stop: Column) -> Column:
    return F.when(stop == "rate_limited", "STOPPED_RATE_LIMIT").when(stop == "semantic_saturation", "COMPLETED_SEMANTIC_SATURATION").otherwise("COMPLETED_BATCH")


def coverage_status(reached: Column, soft: bool, stop: Column) -> Column:
    return F.when(reached, "SOFT_TARGET_MET" if soft else "TARGET_MET").when(stop == "semantic_saturation", "SEMANTIC_SATURATION").otherwise("PARTIAL")


def quality_gate(mismatches: Column, medias: Column, passed: Column, invalid: Column) -> Column:
    return F.when(mismatches > 0, "FAIL").when((medias > 0) & (passed == medias) & (invalid == 0), "PASS").otherwise("WARNING")


def manifest(rows: DataFrame, delivery: DataFrame, audits: DataFrame, counters: DataFrame, target: int = 0, soft: bool = False, automation: str | None = None, checkpoint: DataFrame | str | None = None) -> DataFrame:
    """The counts and states of a run in one row: one aggregate per input, joined as single rows."""
    when = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0))
    reply = F.col("parent_comment_id").isNotNull() | (F.col("depth") > 0)
    d = delivery.agg(F.count("*").alias("final_collected_count"), when(~reply).alias("main_comment_count"), when(reply).alias("reply_count"))
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))
    a = audits.agg(
        F.count("*").alias("media_count"), *(when(F.col("audit_status") == s).alias(f"{s.lower()}_media_count") for s in ("PASS", "PARTIAL", "BLOCKED")), when(F.col("relevance_tier").isin("HIGH", "MEDIUM")).alias("qualified_candidate_count"),
        when(F.col("stop_reason") == "semantic_low_audit_only").alias("low_audit_only_count"), total("shortcode_mismatch_count").alias("shortcode_mismatch_count"), total("route_fallback_attempt_count").alias("route_fallback_attempt_count"),
        total("route_fallback_success_count").alias("route_fallback_success_count"), F.collect_set("stop_reason").alias("_stops"),
    )
    out = counters.crossJoin(rows.agg(F.count("*").alias("internal_raw_unique_count"))).crossJoin(d).crossJoin(a)  # single rows
    out = out.crossJoin(checkpoint) if isinstance(checkpoint, DataFrame) else out.withColumn("_checkpoint", F.lit(checkpoint).cast("string"))
    n = F.col("final_collected_count")
    out = out.withColumns({"deliverable_excluded_count": F.col("internal_raw_unique_count") - n, "candidate_media_count": F.col("media_count"), "Valid_Comment_Total": n, "stop_reason": stop_reason(F.col("_stops"), n, target, soft, automation, F.col("_checkpoint")), "target_reached": F.lit(bool(target)) & (n >= target)})
    out = out.withColumns({"Workflow_Status": workflow_status(F.col("stop_reason")), "Coverage_Status": coverage_status(F.col("target_reached"), soft, F.col("stop_reason")), "target_shortfall_reason": F.when(~F.col("target_reached"), F.col("stop_reason"))})
    gate = quality_gate(F.col("shortcode_mismatch_count"), F.col("media_count"), F.col("pass_media_count"), F.col("invalid_row_count"))
    return out.withColumn("quality_gate", gate).drop("_stops", "_checkpoint")


#: Pacing of a live run and its defaults, as the manifest names them (fixed values).
PACING = {
    "navigation_delay_min_seconds": 20.0, "navigation_delay_max_seconds": 35.0, "scroll_delay_min_seconds": 3.0, "scroll_delay_max_seconds": 6.0,
    "post_batch_size": 5, "batch_rest_min_seconds": 120.0, "batch_rest_max_seconds": 300.0, "rate_limit_cooldown_level1_seconds": 3600,
    "rate_limit_cooldown_level2_seconds": 14400, "rate_limit_cooldown_level3_seconds": 43200, "rate_limit_count": 0, "rate_limit_level": 0,
}
#: Access-control states that have no default (fixed values).
ACCESS_STATES = ["cooldown_started_at", "cooldown_until", "cooldown_ended_at", "readonly_preflight_status", "readonly_preflight_at", "recovery_phase"]
MANIFEST_TAG = "instagram_raw_manifest_v1"


def access_columns(access: dict) -> dict[str, Column]:
    """The access-control columns of a manifest from a checkpoint's section; absent values have their defaults, counts that are null are 0."""
    known = access | {k: access.get(k) or 0 for k in ("rate_limit_count", "rate_limit_level")}
    paced = {k: F.lit(known.get(k, v)).cast("double" if isinstance(v, float) else "int") for k, v in PACING.items()}
    return paced | {k: F.lit(access.get(k)).cast("string") for k in ACCESS_STATES}


def manifest_record(counts: DataFrame, asins: list[str], target: int = 0, soft: bool = False, smoke: bool = False, automation: dict | None = None) -> DataFrame:
    """The whole manifest: manifest() with the run's settings and its access control."""
    automation = automation or {}
    goal = automation.get("collection_goal") or automation.get("settings", {}).get("collection_goal") or "target"
    settings = {
        "schema_version": F.lit(MANIFEST_TAG), "generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "run_mode": F.lit("smoke" if smoke else "asin_research"),
        "amazon_asins": F.array(*(F.lit(a) for a in asins)).cast("array<string>"), "standalone_media_records": F.lit(0), "target_comments": F.lit(target or None).cast("int"),
        "collection_goal": F.lit(goal), "soft_target": F.lit(soft),
    }
    return counts.withColumns(settings | access_columns(automation.get("access_control") or {}))


def patched(record: DataFrame, access: dict) -> DataFrame:
    """A manifest with the access control of a later checkpoint; all else stays."""
    return record.withColumns(access_columns(access))


def gate_sheet(run: DataFrame, standalone: int, exported: int) -> DataFrame:
    """(check, value) rows of the gate; the export check compares real counts."""
    checks = {
        "no_standalone_media_rows": F.lit(standalone == 0), "raw_rows_equal_csv_rows": F.col("internal_raw_unique_count") == exported, "invalid_row_count": F.col("invalid_row_count"), "shortcode_mismatch_count": F.col("shortcode_mismatch_count"),
        "partial_media_count": F.col("partial_media_count"), "blocked_media_count": F.col("blocked_media_count"), "decision": F.col("quality_gate"),
    }
    return run.select(F.posexplode(F.array(*(F.struct(F.lit(k).alias("check"), v.cast("string").alias("value")) for k, v in checks.items()))).alias("n", "c")).select("n", "c.*")
