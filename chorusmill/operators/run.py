"""One ingest run from captures to its tables, and a collection's bookkeeping of candidates, results and rounds.

Tables are joined on keys; what is one row (a manifest, a checkpoint, a prefix end) is joined as one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..schemas import CANDIDATE_FIELDS
from ..tables import written
from . import audit, ingest, merge, relevance

# Round sources, the share of candidates that a resumed run takes first, and reasons.
EXPANSION_SOURCE = "grouped_semantic_gate_v2_expansion"
PRIORITY_LIMIT = 5
RECHECK_FAILED = "semantic_gate_recheck_failed"
ACCOUNT_ADDRESS = "https://www.instagram.com/"


@dataclass
class IngestRun:
    """Tables of a run: unique and delivered comment rows, media audits, and the manifest (one row)."""

    rows: DataFrame
    delivery: DataFrame
    audits: DataFrame
    manifest: DataFrame


def ingest_run(
    captures: DataFrame, asins: list[str] | None = None, query: str | None = None, candidates: DataFrame | None = None,
    target: int = 0, soft: bool = False, smoke: bool = False, automation: dict | None = None, known_asins: list[str] | None = None,
) -> IngestRun:
    """Checked captures (ingest.checked) to rows, audits and manifest. Invalid captures are left out.

    Blocked captures give an audit but no rows. A hard target ends the run with the capture that reaches it. candidates
    (schemas.CANDIDATE_FIELDS, some or all; of a shortcode listed twice the last by `ord` counts) decide eligibility, replace
    the audits' relevance and are audited themselves, once for each listing, where they were never captured. The captures are
    read once; checked captures, unique rows and audits are written tables that all results read.
    """
    good = written(ingest.valid(captures), "captures")
    rows = ingest.comment_rows(good, asins, query)
    unique = written(ingest.dedupe(rows.where(ingest.is_valid_row())), "rows")
    if target and not soft:
        end = ingest.prefix_end(unique.groupBy("ord").agg(F.count("*").alias("n")), "ord", "n", target).first()[0]
        if end is not None:
            good = good.where(F.col("ord") <= end)
            rows = ingest.comment_rows(good, asins, query)
            unique = written(ingest.dedupe(rows.where(ingest.is_valid_row())), "rows")
    counted = rows.agg(F.count("*").alias("raw"), F.count_if(~ingest.is_valid_row()).alias("invalid")).first()
    reports = audit.capture_reports(good)
    counts = (counted["raw"], counted["invalid"], counted["raw"] - counted["invalid"] - unique.count())
    named = sorted({*(asins or []), *(known_asins or [])})
    return assembled(unique, audit.latest_audits(reports).drop("place"), counts, candidates, named, target, soft, smoke, automation, audit.last_restriction(reports).first()[0])


def assembled(
    unique: DataFrame, audits: DataFrame, counts: tuple[int, int, int], candidates: DataFrame | None, asins: list[str],
    target: int, soft: bool, smoke: bool, automation: dict | None, stop: str | None,
) -> IngestRun:
    """The tables of a run from its unique rows, its media's last reports (with ord), and its counts of raw, invalid and duplicate rows."""
    automation = automation or {}
    audits = audits.drop("ord")
    if candidates is None:
        listed = audits.select("media_id", F.lit(True).alias("eligible")).where("false")
    else:
        if "deliverable_eligible" not in candidates.columns:
            candidates = candidates.withColumn("deliverable_eligible", F.lit(None).cast("boolean"))
        listing = last_listed(candidates)
        audits = audits.unionByName(audit.synthetic_audits(candidates, audits), allowMissingColumns=True)
        named = listing.withColumn("present", F.array(*(F.lit(c) for c in audit.REVIEWED if c in listing.columns)))
        audits = audit.reviewed(audits, named)
        listed = listing.select(F.col("shortcode").alias("media_id"), F.coalesce("deliverable_eligible", F.lit(False)).alias("eligible"))
    delivery = ingest.delivered(unique, listed)
    audits = written(audit.finished(audits, delivery), "audits")
    counters = unique.sparkSession.createDataFrame([counts], "raw_captured_count long, invalid_row_count long, technical_duplicate_count long")
    manifest = audit.manifest(unique, delivery, audits, counters, target=target, soft=soft, automation=automation.get("stop_reason"), checkpoint=stop)
    return IngestRun(unique, delivery, audits, audit.manifest_record(manifest, asins, target=target, soft=soft, smoke=smoke, automation=automation))


def last_listed(candidates: DataFrame) -> DataFrame:
    """One row per shortcode, the last by `ord`; blank shortcodes go. Without ord a shortcode that is listed twice is an error."""
    named = candidates.where(F.coalesce("shortcode", F.lit("")) != "")
    at = F.col("ord") if "ord" in named.columns else F.lit(0)
    last = named.groupBy("shortcode").agg(F.max_by(F.struct(*named.columns), at).alias("r"), F.count("*").alias("n"))
    if "ord" not in named.columns:
        last = last.where(F.when(F.col("n") > 1, F.raise_error(F.lit("candidates listed twice need an ord"))).otherwise(F.lit(True)))
    return last.select("r.*")


def run_asins(*tables: DataFrame) -> DataFrame:
    """One row: the sorted distinct ASINs of all tables (asin)."""
    every = tables[0].select("asin")
    for t in tables[1:]:
        every = every.unionByName(t.select("asin"))
    return every.agg(F.array_sort(F.collect_set("asin")).alias("amazon_asins"))


# ---- candidates ---------------------------------------------------------------------------------


def candidate_audit(candidates: DataFrame) -> DataFrame:
    """The fixed projection of a candidate; absent columns are null."""
    return candidates.select(*(F.col(c) if c in candidates.columns else F.lit(None).cast("string").alias(c) for c in CANDIDATE_FIELDS))


def priority_subset(candidates: DataFrame, codes: DataFrame, limit: int = PRIORITY_LIMIT) -> DataFrame:
    """The best COLLECT candidates among the codes (shortcode) that a resumed run takes first."""
    first = candidates.where("decision = 'COLLECT'").join(codes.select("shortcode").distinct(), "shortcode", "left_semi")
    return relevance.ranked(first).limit(limit)


def rechecked(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidates scored again just before collection; those that fail are PARTIAL with their reason."""
    old = [c for c in candidates.columns if c not in ("audit_status", "stop_reason")]
    again = relevance.gated(relevance.score_media(candidates, profiles))
    failed = ~F.col("deliverable_eligible")
    keep = lambda c: F.col(c) if c in candidates.columns else F.lit(None).cast("string")
    new = [c for c in again.columns if c not in old and c not in ("audit_status", "stop_reason")]
    return again.select(
        *old, *new, F.when(failed, "PARTIAL").otherwise(keep("audit_status")).alias("audit_status"), F.when(failed, RECHECK_FAILED).otherwise(keep("stop_reason")).alias("stop_reason")
    )


def newly_eligible(now: DataFrame, before: DataFrame) -> DataFrame:
    """Shortcodes that are eligible now and were not before."""
    codes = lambda t: t.where("deliverable_eligible").select("shortcode").distinct()
    return codes(now).join(codes(before), "shortcode", "left_anti")


def unknown_asins(asins: DataFrame, profiles: DataFrame) -> DataFrame:
    """ASINs without a profile, in their order (ord)."""
    return asins.join(profiles.select("asin").distinct(), "asin", "left_anti").orderBy("ord")


def pending_queries(queries: DataFrame) -> DataFrame:
    return queries.where(~F.coalesce("executed", F.lit(False)))


def with_account(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """Queries with their profile's brand (the first profile of an ASIN), and the account address of product queries."""
    brands = profiles.groupBy("asin").agg(F.min_by("brand", "profile_ord").alias("brand"))
    slug = F.regexp_replace(F.lower(F.coalesce("brand", F.lit(""))), "[^a-z0-9._]+", "")
    address = F.when((F.col("query_family") == "product_entity") & (slug != ""), F.concat(F.lit(ACCOUNT_ADDRESS), slug, F.lit("/")))
    return queries.join(brands, "asin", "left").withColumn("account_url", address)


def nearest(items: DataFrame, by: list[str]) -> DataFrame:
    """Per key the item in view (in_viewport) nearest to the middle (distance, then index), expanded ones before all others."""
    at = F.struct(F.when(F.col("expanded"), 0).otherwise(1), "distance", "index")
    return items.where("in_viewport").groupBy(*by).agg(F.min_by(F.struct(*items.columns), at).alias("r")).select("r.*")


# ---- results and attempts -----------------------------------------------------------------------


def merged_captures(attempts: DataFrame) -> DataFrame:
    """Attempts of each media (shortcode, attempt, comments, page, continuous_scroll) as one capture.

    A comment has its last value at its first place; the platform's count is the greatest, the visible count that of the
    merged comments, the ledgers follow one another. The list is one media's comments.
    """
    each = attempts.select("shortcode", "attempt", F.posexplode(F.coalesce("comments", F.array())).alias("pos", "c"))
    author, named = F.col("c.author"), F.coalesce("c.comment_id", F.lit("")) != ""
    key = F.when(named, F.concat(F.lit("id:"), F.col("c.comment_id"))).otherwise(F.to_json(F.struct(author.alias("a"), F.col("c.comment_text").alias("t"))))
    last = each.groupBy("shortcode", key.alias("_key")).agg(F.max_by("c", F.struct("attempt", "pos")).alias("c"), F.min(F.struct("attempt", "pos")).alias("at"))
    comments = last.groupBy("shortcode").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("comments"))
    scroll = F.col("continuous_scroll")
    ledgers = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("attempt", F.coalesce(scroll["action_ledger"], F.array()).alias("l")))), lambda x: x["l"]))
    begun = F.coalesce(F.nullif(F.min_by(scroll["attempt_count"], "attempt"), F.lit(0)), F.lit(1))
    whole = attempts.groupBy("shortcode").agg(
        F.max_by("page", "attempt").alias("page"), F.max_by("continuous_scroll", "attempt").alias("continuous_scroll"), F.max("page.platform_comment_count").alias("platform_comment_count"),
        ledgers.alias("action_ledger"), (begun + F.count("*") - 1).cast("int").alias("attempt_count"), F.max("attempt").alias("attempt"),
    )
    out = whole.join(comments, "shortcode", "left").withColumn("comments", F.coalesce("comments", F.array()))
    page = F.col("page").withField("platform_comment_count", F.col("platform_comment_count")).withField("visible_comment_count", F.size("comments"))
    moved = scroll.withField("action_ledger", F.col("action_ledger")).withField("attempt_count", F.col("attempt_count"))
    return out.select("shortcode", "attempt", "comments", page.alias("page"), moved.alias("continuous_scroll"), F.size("comments").alias("final_visible_unique_count"))


def results(captures: DataFrame) -> DataFrame:
    """The result of each media from its last valid capture (shortcode, attempt, capture_path, valid, comments, page, media, continuous_scroll).

    A failed attempt (valid false) never lowers it; it only counts as a retry.
    """
    ok = F.coalesce("valid", F.lit(True))
    kept = captures.groupBy("shortcode").agg(F.max_by(F.struct(*captures.columns), F.when(ok, F.col("attempt"))).alias("r"), (F.count("*") - 1).cast("int").alias("retry_count"))
    kept = kept.where("r IS NOT NULL").select("r.*", "retry_count")
    page, scroll, comments = F.col("page"), F.col("continuous_scroll"), F.coalesce("comments", F.array())
    ids = F.filter(F.transform(comments, lambda c: F.nullif(c["comment_id"], F.lit(""))), lambda c: c.isNotNull())
    n = F.size(comments)
    return kept.select(
        "shortcode", "capture_path", n.alias("comment_count"), F.coalesce(F.nullif(scroll["stop_reason"], F.lit("")), page["status"]).alias("stop_reason"),
        audit.collection_status(page["status"], n, page["platform_comment_count"]).alias("audit_status"), page["platform_comment_count"].alias("platform_comment_count"), "retry_count",
        F.coalesce(F.nullif(page["actual_shortcode"], F.lit("")), F.col("media.media_id")).alias("actual_shortcode"), F.coalesce(page["shortcode_mismatch_count"], F.lit(0)).alias("shortcode_mismatch_count"),
        ids.alias("collected_comment_ids"), F.coalesce(scroll["expanded_thread_signatures"], F.array().cast("array<string>")).alias("expanded_thread_signatures"),
        F.coalesce(scroll["scroll_frontier"], F.create_map().cast("map<string,string>")).alias("scroll_frontier"),
    )


def eligible_total(media_results: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: comments collected of eligible media."""
    codes = candidates.where("deliverable_eligible").select("shortcode").distinct()
    return media_results.join(codes, "shortcode", "left_semi").agg(F.coalesce(F.sum("comment_count"), F.lit(0)).alias("total"))


def identity_guard(captures: DataFrame) -> DataFrame:
    """Captures (shortcode expected) whose identity fails lose their comments and carry the mismatch in page and stop reason."""
    checked = captures.withColumn("_id", identity.collection_check(F.col("shortcode"), F.col("media"), F.col("page"), F.col("comments")))
    bad = ~F.col("_id.ok")
    page = F.col("page").withField("status", F.lit("MEDIA_ID_MISMATCH")).withField("identity_verified", F.lit(False))
    page = page.withField("actual_shortcode", F.col("_id.actual_shortcode")).withField("observed_shortcodes", F.col("_id.observed_shortcodes"))
    page = page.withField("shortcode_mismatch_count", F.col("_id.mismatch_count"))
    scroll = F.col("continuous_scroll").withField("stop_reason", F.lit("MEDIA_ID_MISMATCH"))
    return checked.withColumns({
        "comments": F.when(bad, F.slice(F.coalesce("comments", F.array()), 1, 0)).otherwise(F.col("comments")), "page": F.when(bad, page).otherwise(F.col("page")),
        "continuous_scroll": F.when(bad, scroll).otherwise(F.col("continuous_scroll")), "valid": ~bad,
    }).drop("_id")


# ---- rounds and attempts as expressions -----------------------------------------------------------


def round_kind(queries: Column, executed: Column, expansions: Column, streak: Column, soft: Column, resuming: Column) -> Column:
    """What a run asks next from counts of its queries: its open ones, expansion once, then evidence rounds until saturated."""
    spent = (queries > 0) & (executed >= queries) & ~resuming
    return F.when(queries == 0, "seed").when(~spent, "open").when(expansions == 0, "expansion").when(soft & (streak < 2), "evidence").otherwise("none")


def attempts_allowed(exists: Column, max_retries: int) -> Column:
    return F.when(exists, 1).otherwise(1 + max_retries)


def retry_allowed(exists: Column, needs: Column, retry_count: Column, max_retries: int, soft: bool) -> Column:
    """Whether a media is collected now: a new one always, another one while it needs it and has retries left (two at least if soft)."""
    limit = max(max_retries, 2) if soft else max_retries
    return ~exists | (needs & (retry_count < limit))


# ---- jobs -----------------------------------------------------------------------------------------


def claim_order(jobs: DataFrame) -> DataFrame:
    """Pending jobs in the order they are claimed: requeued ones (queue 0) first, the last one claimed before the others, then first come."""
    return jobs.where("status = 'pending'").orderBy("queue", F.when(F.col("queue") == 0, -F.col("last_seq")), "first_seq")


def progress(events: DataFrame) -> DataFrame:
    """The merged progress of each job: of events (job_id, seq, progress map) the last value of every key."""
    each = events.select("job_id", "seq", F.explode("progress").alias("key", "value"))
    last = each.groupBy("job_id", "key").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("progress"))


def snapshots(rounds: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last round of each key, as a progress table shows it, with the number of rounds."""
    last = rounds.groupBy(*by).agg(F.max_by(F.struct(*rounds.columns), order).alias("r"), F.count("*").alias("rounds"))
    return last.select("r.*", "rounds")


def numbered(attempts: DataFrame, by: list[str], order: str) -> DataFrame:
    """attempt (0, 1, ..) of each row of a key."""
    return attempts.withColumn("attempt", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
