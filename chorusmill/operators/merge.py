"""Merge policies. They differ on purpose and are not unified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.text import clean_text


def last_wins_first_place(rows: DataFrame, key: list[Column | str], order: list[str]) -> DataFrame:
    """Per key the last row by order, at the place (`place`) of the first."""
    at = F.struct(*order)
    out = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), at).alias("r"), F.min(at).alias("place"))
    return out.select("r.*", "place")


def retry_key() -> Column:
    """A comment's key in retries: its id, else shortcode, author or username, and text."""
    return F.when(F.coalesce("comment_id", F.lit("")) != "", F.concat(F.lit("id:"), "comment_id")).otherwise(F.to_json(F.struct("shortcode", F.coalesce(F.nullif("author", F.lit("")), F.col("username")).alias("a"), "comment_text")))


def retry_merge(rows: DataFrame) -> DataFrame:
    """Comments of several attempts of a capture: last value, first place. rows carry attempt and pos."""
    return last_wins_first_place(rows, [retry_key().alias("_key")], ["attempt", "pos"])


def retry_totals(captures: DataFrame) -> DataFrame:
    """Per shortcode: attempts, the greatest platform count, and the ledgers one after another."""
    ledgers = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "ledger"))), lambda x: x["ledger"]))
    return captures.groupBy("shortcode").agg(F.count("*").alias("attempt_count"), F.max("platform_comment_count").alias("platform_comment_count"), ledgers.alias("action_ledger"))


def first_wins(rows: DataFrame, key: list[Column | str], order: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def keep_known_by_id(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By id only: rows without one go; among existing rows the last wins, an incoming one never replaces it. Rows carry ord."""
    both = existing.withColumn("_rank", F.col("ord")).unionByName(incoming.withColumn("_rank", -F.col("ord") - 1))
    named = both.where(F.coalesce("comment_id", F.lit("")) != "")
    return named.groupBy("comment_id").agg(F.max_by(F.struct(*existing.columns), "_rank").alias("r")).select("r.*")


def dedupe_candidates(rows: DataFrame, hosts: list[str] = identity.HOSTS) -> DataFrame:
    """One row per shortcode of (ord, url, source_query, matched_queries, matched_asins): first wins, provenance is united in order.

    Provenance is combined per (shortcode, value) with its first place before it becomes a list, so a list holds
    distinct values only, however often a media was found.
    """
    found = rows.withColumn("m", identity.canonical_media(F.col("url"), hosts)).where("m IS NOT NULL")
    no_text = F.array().cast("array<string>")
    said = lambda kind, values: F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), clean_text(v).alias("v"), i.alias("i")))
    own = F.concat(F.array("source_query"), F.coalesce("matched_queries", no_text))
    first = F.struct("ord", "m", "url").alias("first")
    each = found.select(F.col("m.media_id").alias("shortcode"), first, F.explode(F.concat(said("q", own), said("a", F.coalesce("matched_asins", no_text)))).alias("s"))
    folded = each.groupBy("shortcode", "s.kind", F.lower("s.v").alias("low")).agg(
        F.min_by("first", "first.ord").alias("first"), F.min(F.struct("first.ord", "s.i", "s.v")).alias("at")
    )
    listed = lambda kind: F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("low") != ""), F.col("at"))))
    out = folded.groupBy("shortcode").agg(F.min_by("first", "first.ord").alias("f"), listed("q").alias("q"), listed("a").alias("a"))
    values = lambda c: F.transform(c, lambda x: x["v"])
    return out.select(
        "shortcode", F.col("f.ord").alias("ord"), F.col("f.m.media_type").alias("media_type"), F.col("f.m.owner").alias("owner"), F.col("f.m.media_url").alias("url"),
        F.col("f.m.media_url").alias("discovery_url"), F.col("f.m.media_type").alias("discovery_media_type"), values("q").alias("matched_queries"), values("a").alias("matched_asins"),
    )


def longest_context(links: DataFrame) -> DataFrame:
    """Per shortcode the longest text, the first of equally long ones. links: shortcode, ord, text."""
    return links.groupBy("shortcode").agg(F.min("ord").alias("ord"), F.max_by("text", F.struct(F.length("text"), -F.col("ord"))).alias("text"))


def with_inspection(candidates: DataFrame, inspected: DataFrame) -> DataFrame:
    """Inspection columns over candidates, for the candidates that were inspected.

    `present` (optional, array) names the keys that an inspection holds: a present null replaces, an absent key does not.
    Without it every column of inspected is present. Discovery url and type never change once set.
    """
    new = [c for c in inspected.columns if c not in ("shortcode", "present")]
    named = F.col("present") if "present" in inspected.columns else F.lit(None).cast("array<string>")
    side = inspected.select("shortcode", F.lit(True).alias("_found"), named.alias("_present"), *(F.col(c).alias(f"_new_{c}") for c in new))
    out = candidates.join(side, "shortcode", "left")
    for c in new:
        old = F.col(c) if c in candidates.columns else F.lit(None)
        holds = F.col("_found") & (F.col("_present").isNull() | F.array_contains("_present", c))
        pick = F.coalesce(old, F.col(f"_new_{c}")) if c in ("discovery_url", "discovery_media_type") else F.when(holds, F.col(f"_new_{c}")).otherwise(old)
        out = out.withColumn(c, pick)
    return out.drop("_found", "_present", *(f"_new_{c}" for c in new))


def collection_url(shortcode: Column, working_url: Column, *types: Column) -> Column:
    """The working address, else the route of the first known type (reel or p)."""
    kind = F.coalesce(*types, F.lit("p"))
    built = F.concat(F.lit("https://www.instagram.com/"), F.when(kind == "reel", "reel").otherwise("p"), F.lit("/"), shortcode, F.lit("/"))
    return F.coalesce(F.nullif(working_url, F.lit("")), built)
