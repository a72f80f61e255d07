"""Captures to comment rows: validation, normalisation, technical dedupe with provenance, counters, target prefix.

Arrival order is explicit: `ord` is a capture's ordinal (given by the caller) and `pos` a comment's place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..schemas import CAPTURE_TAG, COMMENT_TAG, RAW_FIELDS


def _blank_null(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def checked(captures: DataFrame) -> DataFrame:
    """Adds ident, mismatch, accepted (all comments or none; a capture without comments has none) and error (null for a valid capture)."""
    ident = identity.media_identity(F.col("media.media_url"))
    error = F.when(F.coalesce(F.col("schema_version") != CAPTURE_TAG, F.lit(True)), "schema_version").when(ident.isNull(), "media_url")
    out = captures.withColumns({"ident": ident, "error": error, "comments": F.coalesce("comments", F.array())})
    out = out.withColumn("mismatch", identity.mismatch_count(F.col("ident.media_id"), F.col("page"), F.col("comments")))
    return out.withColumn("accepted", F.when(F.col("mismatch") == 0, F.col("comments")).otherwise(F.slice("comments", 1, 0)))


def strict(captures: DataFrame) -> DataFrame:
    """The checked captures as they are; the first invalid one fails the query."""
    told = F.concat(F.lit("invalid capture: "), F.col("error"))
    return captures.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(told)).otherwise(F.col("error"))).where("error IS NULL")


def valid(captures: DataFrame) -> DataFrame:
    return captures.where("error IS NULL")


def rejected(captures: DataFrame) -> DataFrame:
    return captures.where("error IS NOT NULL")


def comment_rows(captures: DataFrame, asins: list[str] | None = None, query: str | None = None) -> DataFrame:
    """Normalised rows (the raw comment columns, with ord and pos) of checked, valid captures that are not blocked."""
    c, d = F.col("c"), F.col("media.discovery")
    own_asins = F.array(*(F.lit(a) for a in asins or [])).cast("array<string>")
    no_text = F.array().cast("array<string>")
    found = F.coalesce(d["matched_queries"], no_text)
    asked = F.lit(query).cast("string")
    queries = F.when(asked.isNull() | (asked == "") | F.array_contains(found, asked), found).otherwise(F.concat(found, F.array(asked)))
    parent, ident = _blank_null(c["parent_comment_id"]), F.col("ident")
    depth = F.coalesce(F.nullif(c["depth"], F.lit(0)), F.when(parent.isNotNull(), 1).otherwise(0))
    cid, author = _blank_null(c["comment_id"]), _blank_null(c["author"])
    missing = lambda v, name: F.when(F.coalesce(v.cast("string"), F.lit("")) == "", F.lit(f"missing_{name}"))
    warnings = F.array(missing(cid, "comment_id"), missing(author, "author"), missing(c["comment_text"], "comment_text"), missing(c["published_at"], "published_at"), F.when((depth > 0) & parent.isNull(), F.lit("reply_parent_unresolved")))
    values = {
        "schema_version": F.lit(COMMENT_TAG), "platform": F.lit("instagram"), "record_type": F.lit("comment"),
        "amazon_asins": F.array_sort(F.array_distinct(F.concat(own_asins, F.coalesce(d["matched_asins"], no_text)))),
        "matched_query": F.coalesce(F.nullif(asked, F.lit("")), F.try_element_at(queries, F.lit(1))), "matched_queries": queries,
        "media_id": ident["media_id"], "shortcode": ident["media_id"], "media_type": ident["media_type"], "media_url": ident["media_url"], "post_url": ident["media_url"],
        "media_owner": F.col("media.owner"), "comment_id": cid,
        "media_relevance_tier": d["relevance_tier"], "media_relevance_score": d["relevance_score"], "media_evidence_terms": F.coalesce(d["evidence_terms"], no_text),
        "parent_comment_id": parent, "source_parent_id": F.when(parent.isNotNull(), F.concat(F.lit("comment:"), parent)).otherwise(F.concat(F.lit("media:"), ident["media_id"])),
        "depth": depth, "author": author, "username": author, "comment_text": c["comment_text"],
        "comment_relevance_tier": c["semantic"]["tier"], "comment_relevance_score": c["semantic"]["score"], "comment_evidence_terms": F.coalesce(c["semantic"]["evidence_terms"], no_text),
        "published_at": c["published_at"], "timestamp": c["published_at"], "published_label": c["published_label"], "like_count": c["like_count"], "likes": c["like_count"],
        "comment_url": c["comment_url"], "captured_at": F.coalesce("captured_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")),
        "field_warnings": F.filter(warnings, lambda w: w.isNotNull()),
    }
    rows = captures.select("ord", "ident", "media", "captured_at", F.posexplode("accepted").alias("pos", "c"))
    return rows.select("ord", "pos", *(values[name].alias(name) for name in RAW_FIELDS))


def is_valid_row() -> Column:
    """A row has an id, or both an author and a text."""
    return F.col("comment_id").isNotNull() | (F.col("author").isNotNull() & (F.coalesce("comment_text", F.lit("")) != ""))


def technical_key() -> Column:
    """The comment id, else the exact media, author and text; there is no fuzzy merge."""
    named = F.col("comment_id").isNotNull()
    empty = F.lit(None).cast("string")
    return F.struct(
        F.when(named, "id").otherwise("exact").alias("kind"), F.when(named, F.col("comment_id")).otherwise(F.col("media_id")).alias("a"),
        F.when(named, empty).otherwise(F.col("author")).alias("b"), F.when(named, empty).otherwise(F.col("comment_text")).alias("c"),
    )


def key_digest() -> Column:
    """The technical key as one short string: the id, or a digest of media, author and text."""
    exact = F.sha2(F.to_json(F.struct("media_id", "author", "comment_text")), 256)
    return F.when(F.col("comment_id").isNotNull(), F.concat(F.lit("id:"), F.col("comment_id"))).otherwise(F.concat(F.lit("exact:"), exact))


def dedupe(rows: DataFrame) -> DataFrame:
    """First row of each technical key by (ord, pos), with the union of ASINs and the scalar queries of all its rows in order.

    Rows are combined per key and query first, so a key with very many copies reaches the second aggregation as one
    row per distinct query, whatever the skew; no list is longer than a key's distinct queries or ASIN sets.
    """
    at = F.struct("ord", "pos")
    per_query = rows.groupBy(key_digest().alias("_key"), F.col("matched_query").alias("_query")).agg(
        F.min(at).alias("_at"), F.min_by(F.struct(*rows.columns), at).alias("_row"), F.array_distinct(F.flatten(F.collect_set("amazon_asins"))).alias("_asins")
    )
    merged = per_query.groupBy("_key").agg(
        F.min_by("_row", "_at").alias("_row"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_asins")))).alias("_asins"),
        F.array_sort(F.collect_list(F.when(F.col("_query").isNotNull(), F.struct("_at", "_query")))).alias("_asked"),
    )
    out = merged.select("_row.*", "_asins", "_asked")
    queries = F.array_distinct(F.concat(F.coalesce("matched_queries", F.array().cast("array<string>")), F.transform("_asked", lambda q: q["_query"])))
    return out.withColumns({"amazon_asins": F.col("_asins"), "matched_queries": queries}).select(*rows.columns)


def counters(rows: DataFrame) -> DataFrame:
    """raw_captured_count (before the validity check), invalid_row_count, technical_duplicate_count in one pass."""
    flagged = rows.select(is_valid_row().alias("ok"), key_digest().alias("key"))
    by_key = flagged.groupBy("ok", "key").agg(F.count("*").alias("n"))
    kept = F.when(F.col("ok"), 1).otherwise(0)
    return by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_captured_count"),
        F.coalesce(F.sum(F.when(F.col("ok"), 0).otherwise(F.col("n"))), F.lit(0)).alias("invalid_row_count"),
        F.coalesce(F.sum(kept * (F.col("n") - 1)), F.lit(0)).alias("technical_duplicate_count"),
    )


def prefix_end(counts: DataFrame, order: str, n: str, target: int) -> DataFrame:
    """One row: the least `order` value at which the running sum of n reaches target, null if it never does.

    Every value counted adds at least 1, so the first `target` values decide, and no more than those are ever in one place.
    """
    first = counts.where(F.col(n) > 0).orderBy(order).limit(max(1, target))
    reached = first.withColumn("_sum", F.sum(n).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return reached.where(F.col("_sum") >= target).agg(F.min(order).alias("_end"))


def target_prefix(rows: DataFrame, target: int) -> DataFrame:
    """Rows of the captures up to and including the one whose new unique rows reach the target."""
    fresh = rows.where(is_valid_row()).groupBy(key_digest().alias("key")).agg(F.min("ord").alias("ord")).groupBy("ord").agg(F.count("*").alias("n"))
    kept = rows.crossJoin(prefix_end(fresh, "ord", "n", target))  # one row on that side
    return kept.where(F.col("_end").isNull() | (F.col("ord") <= F.col("_end"))).drop("_end")


def unseen(captures: DataFrame, processed: DataFrame) -> DataFrame:
    """Captures (with `fingerprint`) whose content was not processed before; of equal contents the first by ord."""
    first = captures.groupBy("fingerprint").agg(F.min("ord").alias("ord"))
    return captures.join(first, ["fingerprint", "ord"], "left_semi").join(processed.select("fingerprint"), "fingerprint", "left_anti")


def delivered(rows: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Rows of media that are eligible; media not listed are."""
    listed = eligibility.select("media_id", F.col("eligible").alias("_eligible"))
    return rows.join(listed, "media_id", "left").where(F.coalesce("_eligible", F.lit(True))).drop("_eligible")


def lineage(rows: DataFrame) -> DataFrame:
    """Rows with parent_author where the parent is a row of the same media; of rows that share an id the first is the parent."""
    named = rows.where("comment_id IS NOT NULL").groupBy("media_id", F.col("comment_id").alias("parent_comment_id"))
    parents = named.agg(F.min_by("author", F.struct("ord", "pos")).alias("parent_author"))
    return rows.join(parents, ["media_id", "parent_comment_id"], "left")
