"""Discovery in rounds: plan, ask, score, and plan again from what was found, until nothing grows.

What a query finds is a table of links, so a run is a fixed-point iteration of tables. Each round ends in written tables:
the plan, everything found so far, and the scores of candidates. Only single rows (counts, the next kind of round) reach
the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from . import ingest, merge, profiles, relevance, run

#: Candidates that end a round, as a multiple of the wanted posts; rounds without growth after which meaning is saturated.
ENOUGH, SATURATED = 3, 2
#: The number of the first evidence round.
FIRST_EVIDENCE_ROUND = 3
_VERDICT = ["relevance_tier", "relevance_score", "evidence_terms", "deliverable_eligible", "decision", "caption", "hashtags"]


@dataclass
class Discovery:
    """A run's tables: the plan, its scored candidates, and a row for each round."""

    plan: DataFrame
    candidates: DataFrame
    rounds: DataFrame


def _planned(queries: DataFrame, number: int, order: list[Column]) -> DataFrame:
    """New queries with their round and their place in the plan."""
    place = F.struct(F.lit(number).alias("round"), *(c.cast("long").alias(f"k{i}") for i, c in enumerate(order)), *(F.lit(0).cast("long").alias(f"k{i}") for i in range(len(order), 3)))
    none = F.lit(None).cast("int")
    return queries.select(
        F.lit(number).alias("round"), place.alias("place"), "asin", "query", "query_family", "generation_source", F.col("priority").cast("int").alias("priority"),
        F.lit(False).alias("executed"), F.lit(0).cast("long").alias("posts_found"), F.lit(0).cast("long").alias("qualified_posts"), none.alias("executed_round"),
    )


def new_queries(kind: str, number: int, products: DataFrame, plan: DataFrame | None, candidates: DataFrame | None, comments: DataFrame | None, evidence_round: int) -> DataFrame | None:
    """The queries that a round of this kind adds to the plan."""
    if kind == "seed":
        return _planned(profiles.seed_queries(products), number, [-F.col("priority"), F.col("profile_ord"), F.col("slot")])
    if kind == "expansion":
        return _planned(profiles.expansion_queries(products, plan), number, [F.col("profile_ord"), F.col("slot")])
    if kind == "evidence":
        said = comments if comments is not None else products.sparkSession.createDataFrame([], "ord int, media_id string, comment_id string, comment_relevance_tier string, comment_evidence_terms array<string>")
        zero = F.lit(0).cast("long")  # comments are in their own order, shaped like that of candidates
        place = F.struct(F.lit(0).alias("round"), F.col("ord").cast("long").alias("k0"), zero.alias("k1"), zero.alias("k2"))
        said = said.withColumn("ord", F.struct(place.alias("place"), zero.alias("at")))
        return _planned(profiles.evidence_queries(products, candidates, said, plan, evidence_round), number, [-F.col("priority")])
    return None


def asked_now(plan: DataFrame, links: DataFrame, known: DataFrame, enough: int) -> DataFrame:
    """The open queries that a round asks, in plan order: up to the one that brings the candidates to `enough`.

    A query is asked even if there are enough already, as the check follows it. known: shortcode of candidates so far.
    """
    open_ = run.pending_queries(plan)
    missing = enough - known.count()
    if missing > 0:
        found = open_.select("place", "query").join(links.where("shortcode IS NOT NULL").select("query", "shortcode"), "query")
        first = found.join(known, "shortcode", "left_anti").groupBy("shortcode").agg(F.min("place").alias("place"))
        end = ingest.prefix_end(first.groupBy("place").agg(F.count("*").alias("n")), "place", "n", missing)
    else:
        end = open_.agg(F.min("place").alias("_end"))
    return open_.crossJoin(end).where(F.col("_end").isNull() | (F.col("place") <= F.col("_end"))).drop("_end")  # one row on that side


def discover(
    products: DataFrame, links: DataFrame, media: DataFrame, comments: DataFrame | None = None, collected: DataFrame | None = None,
    target_posts: int = 30, soft: bool = True, most_rounds: int = 50,
) -> Discovery:
    """Seed, expansion and, with a soft target, evidence rounds.

    products: profiles (with profile_ord); links: (query, place, url) that asking a query shows, matched on the whole query;
    media: (shortcode, evidence, caption, hashtags) as inspected; a candidate that is not there has no evidence. comments as
    in profiles.evidence_queries; collected: (shortcode, comment_count). A round first asks what is open, else adds queries.
    It grows if media become eligible or comments of eligible media are added; after two rounds without growth no evidence
    round follows. Without a soft target the run ends when all queries of seed and expansion are asked.
    """
    spark = products.sparkSession
    shown = written(links.select("query", F.col("place").cast("long").alias("at"), "url", merge.identity.canonical_media(F.col("url"))["media_id"].alias("shortcode")), "round-links")
    plan = found = candidates = None
    log, streak, evidence_round, comments_before = [], 0, FIRST_EVIDENCE_ROUND, 0
    for number in range(1, most_rounds + 1):
        kind = _kind(plan, streak, soft, spark)
        if kind == "none":
            break
        added = new_queries(kind, number, products, plan, candidates, comments, evidence_round)
        if added is not None:
            before = plan
            plan = written(added if before is None else before.unionByName(added), "round-plan")
        count = plan.where(F.col("round") == number).count()
        evidence_round += kind == "evidence" and count > 0
        known = candidates.select("shortcode") if candidates is not None else spark.createDataFrame([], "shortcode string")
        asked = written(asked_now(plan, shown, known, ENOUGH * target_posts).select("place", "asin", "query"), "round-asked")
        new = asked.join(shown, "query").select(
            F.struct("place", "at").alias("ord"), "url", F.col("query").alias("source_query"), F.lit(None).cast("array<string>").alias("matched_queries"), F.array("asin").alias("matched_asins")
        )
        found = written(new if found is None else found.unionByName(new), "round-found")
        now = _scored(found, candidates, media, products)
        fresh = run.newly_eligible(now, candidates).count() if candidates is not None else now.where("deliverable_eligible").select("shortcode").distinct().count()
        total = run.eligible_total(collected, now).first()[0] if collected is not None else 0
        grown = fresh > 0 or total > comments_before
        streak = 0 if grown else streak + 1
        plan = written(_asked(plan, asked, new, now, number), "round-plan")
        log.append((number, kind, count, asked.count(), now.count(), fresh, max(0, total - comments_before), streak))
        candidates, comments_before = now, total
    columns = "round int, kind string, new_queries long, asked_queries long, candidates long, newly_eligible long, new_comments long, streak int"
    return Discovery(plan, candidates, spark.createDataFrame(log, columns))


def _kind(plan: DataFrame | None, streak: int, soft: bool, spark) -> str:
    if plan is None:
        return "seed"
    counts = plan.agg(F.count("*").alias("n"), F.count_if("executed").alias("done"), F.count_if(F.col("generation_source") == run.EXPANSION_SOURCE).alias("expansions"))
    return counts.select(run.round_kind(F.col("n"), F.col("done"), F.col("expansions"), F.lit(streak), F.lit(soft), F.lit(False))).first()[0]


def _scored(found: DataFrame, before: DataFrame | None, media: DataFrame, products: DataFrame) -> DataFrame:
    """All candidates found so far with their provenance; those that are new are scored, the others keep their verdict."""
    base = merge.dedupe_candidates(found)
    old = base.join(before.select("shortcode", *_VERDICT), "shortcode") if before is not None else None
    new = base.join(before.select("shortcode"), "shortcode", "left_anti") if before is not None else base
    none = F.create_map().cast("map<string,string>")
    inspected = new.join(media.select("shortcode", F.coalesce("evidence", none).alias("evidence"), "caption", "hashtags"), "shortcode", "left").withColumn("evidence", F.coalesce("evidence", none))
    verdict = relevance.gated(relevance.score_media(inspected, products)).select(*base.columns, *_VERDICT)
    return written(verdict if old is None else old.select(*verdict.columns).unionByName(verdict), "round-candidates")


def _asked(plan: DataFrame, asked: DataFrame, new: DataFrame, candidates: DataFrame, number: int) -> DataFrame:
    """The plan after a round: what was asked is executed with all that it showed, and every query has its qualified posts."""
    counts = asked.select("place", "query").join(new.groupBy(F.col("source_query").alias("query")).agg(F.count("*").alias("_n")), "query", "left").select("place", F.coalesce("_n", F.lit(0)).alias("_n"))
    done = plan.join(counts, "place", "left")
    hit = F.col("_n").isNotNull()
    done = done.withColumns({
        "executed": hit | F.col("executed"), "executed_round": F.when(hit, F.lit(number)).otherwise(F.col("executed_round")), "posts_found": F.when(hit, F.col("_n")).otherwise(F.col("posts_found")),
    }).drop("_n")
    sourced = candidates.select("shortcode", "decision", F.try_element_at("matched_queries", F.lit(1)).alias("source_query"), "matched_queries")
    return profiles.query_stats(done.drop("qualified_posts"), sourced).select(*plan.columns)
