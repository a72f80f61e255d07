"""Explainable relevance: rendered evidence, grouped gate, argmax over profiles, comment labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UI_LABELS, clean, compact, distinct_folded, found_terms, words

MODEL_VERSION = "grouped-semantic-gate-v2"
# Group weights, phrases too generic for an alias, and the conflict vocabularies.
WEIGHTS = {"entity": 0.35, "category_function": 0.20, "problem": 0.15, "usage_context": 0.12, "competitor": 0.35}
WEAK_ALIASES = ["non-slip", "slow feeder", "slow feeders", "dog bowl"]
OTHER_SPECIES = r"(?Ui)\b(?:cat|cats|feline|horse|equine|human|men|women)\b"
DOGS = r"(?Ui)\b(?:dog|dogs|puppy|puppies|pup|pups|canine)\b"
OTHER_PRODUCTS = r"(?Ui)\b(?:toy|treats?|dispenser|shelter|rescue)\b"
FEEDING = r"(?Ui)\b(?:slow\s*feed|feeder|bowl|eating|mealtime)\b"

_EMPTY = "array<string>"


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_EMPTY))


def rendered_evidence(caption: Column, accounts: Column, owner: Column, tags: Column, alt: Column, visible: Column, alts: Column) -> Column:
    """Map of what the page itself shows; queries and other provenance are never part of it."""
    text = F.trim(F.coalesce(caption, F.lit("")))
    shown = F.trim(F.regexp_replace(F.coalesce(visible, F.lit("")), r"(?U)\s+", " "))
    near = F.filter(F.transform(_list(alts), lambda a: F.trim(F.regexp_replace(F.coalesce(a, F.lit("")), r"(?U)\s+", " "))), lambda a: (F.length(a) >= 20) & F.contains(F.lower(shown), F.lower(a)))
    longest = F.aggregate(near, F.lit(""), lambda best, a: F.when(F.length(a) > F.length(best), a).otherwise(best))
    image = F.when((text == "") & (shown != "") & (F.size(near) > 0), longest).otherwise(F.trim(F.coalesce(alt, F.lit(""))))
    account = F.array_join(clean(F.concat(_list(accounts), F.array(owner))), " ")
    whole = F.create_map(F.lit("caption"), text, F.lit("account"), account, F.lit("hashtags"), F.array_join(_list(tags), " "), F.lit("alt_text"), image)
    return F.map_filter(whole, lambda _, v: (v != "") & ~v.isin(UI_LABELS))


def _singular(values: Column) -> Column:
    return F.concat(values, F.transform(F.filter(values, lambda v: F.lower(v).endswith("s")), lambda v: F.substring(v, F.lit(1), F.length(v) - 1)))


def _profile_terms(p: DataFrame) -> DataFrame:
    """profile_ord, the profile's terms with their group and folded forms, and what it is about."""
    brand = clean(F.array("brand"))
    named = clean(F.concat(F.array("product_name"), _list(F.col("product_aliases"))))
    alias = F.filter(named, lambda v: ((F.size(words(v)) >= 2) | (F.length(compact(v)) >= 6)) & ~F.lower(v).isin(WEAK_ALIASES))
    category = _singular(clean(F.concat(F.array("category"), _list(F.col("core_functions")), _list(F.col("ingredients")))))
    base = p.withColumns({"_brand": brand, "_alias": alias})
    groups = [clean(F.concat("_brand", "_alias")), clean(category), clean(F.col("pain_points")), clean(F.col("use_scenarios")), clean(F.col("competitors"))]

    def entry(g: int):
        return lambda t: F.struct(F.lit(g).alias("g"), t.alias("term"), F.lower(t).alias("low"), compact(t).alias("packed"), F.array_contains("_brand", t).alias("brand"), F.array_contains("_alias", t).alias("alias"))

    about = F.concat(F.array("product_name", "category"), _list(F.col("use_scenarios")), _list(F.col("keywords")))
    dog = F.exists(about, lambda v: F.contains(F.lower(F.coalesce(v, F.lit(""))), F.lit("dog")))
    kind = F.lower(F.coalesce("category", F.lit("")))
    return base.select("profile_ord", F.concat(*(F.transform(terms, entry(g)) for g, terms in enumerate(groups))).alias("terms"), dog.alias("dog"), (F.contains(kind, F.lit("feed")) | F.contains(kind, F.lit("bowl"))).alias("feeder"))


def _verdict(f: Column) -> Column:
    """Tier, score and reason from a profile's flags."""
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + F.when(f[name], F.lit(weight)).otherwise(F.lit(0.0))
    score = F.least(F.lit(1.0), score)
    matched = sum((F.when(f[name], 1).otherwise(0) for name in WEIGHTS), F.lit(0))
    out = lambda tier, value, reason: F.struct(F.lit(tier).alias("tier"), value.alias("score"), F.lit(reason).alias("reason"))
    return (
        F.when(f["conflict"], out("LOW", F.lit(0.0), "species_or_category_conflict"))
        .when(f["alias"], out("HIGH", F.greatest(score, F.lit(0.85)), "specific product alias/model match"))
        .when(f["brand"] & f["category_function"] & (matched >= 2), out("HIGH", F.greatest(score, F.lit(0.70)), "brand plus category/function groups"))
        .when((matched >= 2) & (score >= 0.5) & (f["entity"] | f["competitor"]), out("MEDIUM", score, "two semantic groups with entity/competitor anchor"))
        .otherwise(out("LOW", F.least(score, F.lit(0.49)), "insufficient grouped semantic gate"))
    )


def score_media(media: DataFrame, profiles: DataFrame) -> DataFrame:
    """media (with `evidence`) and its best profile's verdict. A later profile wins if its score exceeds the best one rounded.

    The profiles are one row: an array in profile order, one entry per product of a run. The media side is never
    shuffled. Each step is a column of its own, so a text is folded once and a term looked up once.
    """
    packed = _profile_terms(profiles).agg(F.array_sort(F.collect_list(F.struct("profile_ord", "terms", "dog", "feeder"))).alias("_profiles"))
    entries = F.transform(F.map_entries("evidence"), lambda e: F.struct(e["key"].alias("source"), F.lower(e["value"]).alias("low"), compact(e["value"]).alias("packed")))
    folded = media.withColumn("_e", entries).withColumn("_page", F.array_join(F.transform("_e", lambda e: e["low"]), " "))
    page = F.col("_page")
    scored = folded.crossJoin(packed)  # one row on that side
    # a page is searched for other species and products only where some profile asks for it
    asked = lambda flag: F.exists("_profiles", lambda p: p[flag])
    searched = {"_species": asked("dog") & page.rlike(OTHER_SPECIES) & ~page.rlike(DOGS), "_product": asked("feeder") & page.rlike(OTHER_PRODUCTS) & ~page.rlike(FEEDING)}
    scored = scored.withColumns(searched).drop("_page")

    def holds(t: Column):
        return lambda e: (t["low"] != "") & (F.contains(e["low"], t["low"]) | ((F.length(t["packed"]) >= 6) & F.contains(e["packed"], t["packed"])))

    def hit(t: Column) -> Column:
        return F.struct(t["g"].alias("g"), t["term"].alias("term"), t["brand"].alias("brand"), t["alias"].alias("alias"), F.transform(F.filter("_e", holds(t)), lambda e: e["source"]).alias("sources"))

    scored = scored.withColumn("_hits", F.transform("_profiles", lambda p: F.filter(F.transform(p["terms"], hit), lambda h: F.size(h["sources"]) > 0)))

    def of_group(g: int):
        return lambda x: x["g"] == g

    def flags(p: Column, h: Column) -> Column:
        group = [F.exists(h, of_group(g)).alias(name) for g, name in enumerate(WEIGHTS)]
        conflict = (p["dog"] & F.col("_species")) | (p["feeder"] & F.col("_product"))
        return F.struct(*group, F.exists(h, lambda x: (x["g"] == 0) & x["brand"]).alias("brand"), F.exists(h, lambda x: (x["g"] == 0) & x["alias"]).alias("alias"), conflict.alias("conflict"))

    scored = scored.withColumn("_flags", F.zip_with("_profiles", "_hits", flags)).withColumn("_verdicts", F.transform("_flags", _verdict))
    # the best score is kept rounded, so an equal later profile whose sum lies above its own rounding replaces it
    better = lambda b, s: F.when(s["score"] > b["score"], F.struct(F.round(s["score"], 3).alias("score"), s["at"].alias("at"))).otherwise(b)
    top = F.aggregate(F.transform("_verdicts", lambda v, i: F.struct(v["score"].alias("score"), i.alias("at"))), F.struct(F.lit(-1.0).alias("score"), F.lit(-1).alias("at")), better)
    scored = scored.withColumn("_at", top["at"])
    at = F.col("_at")
    scored = scored.withColumns({"_v": F.when(at >= 0, F.get("_verdicts", at)), "_h": F.when(at >= 0, F.get("_hits", at)).otherwise(F.slice(F.coalesce(F.get("_hits", F.lit(0)), F.array()), 1, 0))})
    v, h = F.col("_v"), F.col("_h")
    bare = lambda x: F.struct(x["term"].alias("term"), x["sources"].alias("sources"))
    by_group = F.create_map(*(x for g, name in enumerate(WEIGHTS) for x in (F.lit(name), F.transform(F.filter(h, of_group(g)), bare))))
    return scored.withColumns({
        "relevance_tier": F.coalesce(v["tier"], F.lit("LOW")), "relevance_score": F.round(F.coalesce(v["score"], F.lit(-1.0)), 3), "relevance_reason": F.coalesce(v["reason"], F.lit("insufficient rendered semantic groups")),
        "matched_groups": F.filter(F.array(*(F.when(F.exists(h, of_group(g)), F.lit(name)) for g, name in enumerate(WEIGHTS))), lambda x: x.isNotNull()),
        "evidence_terms": clean(F.transform(h, lambda x: x["term"])), "evidence_sources": F.array_sort(F.array_distinct(F.flatten(F.transform(h, lambda x: x["sources"])))), "group_hits": by_group,
        "deliverable_eligible": F.coalesce(v["tier"].isin("HIGH", "MEDIUM"), F.lit(False)), "relevance_model_version": F.lit(MODEL_VERSION),
    }).drop("_e", "_species", "_product", "_profiles", "_hits", "_flags", "_verdicts", "_at", "_v", "_h")


def gated(scored: DataFrame) -> DataFrame:
    """The decision of a scored candidate."""
    return scored.withColumn("decision", F.when(F.col("deliverable_eligible"), "COLLECT").otherwise("AUDIT_ONLY"))


def stale(candidates: DataFrame) -> DataFrame:
    """Candidates that the current model version has not scored."""
    return candidates.where(F.coalesce(F.col("relevance_model_version") != MODEL_VERSION, F.lit(True)))


def semantic_terms(profiles: DataFrame) -> DataFrame:
    """One row: direct and medium terms of all profiles in profile order."""
    direct = F.concat(F.array("brand", "product_name"), _list(F.col("product_aliases")))
    medium = F.concat(F.array("category"), *(_list(F.col(c)) for c in ("core_functions", "use_scenarios", "pain_points", "ingredients")))
    rows = profiles.select(F.struct("profile_ord", direct.alias("d"), medium.alias("m")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    part = lambda k: clean(F.flatten(F.transform("x", lambda s: s[k])))
    return rows.select(part("d").alias("direct"), part("m").alias("medium"))


def labelled(rows: DataFrame, text: str, direct: list[str], medium: list[str], into: str = "semantic") -> DataFrame:
    """rows with a label of a text column: HIGH for direct terms, MEDIUM for context terms, else LOW; never a filter.

    The terms are constants (of a run's profiles: semantic_terms), so each is a plain test on the text folded once.
    """
    found = {"_direct": (direct, "_folded"), "_medium": (medium, "_folded")}
    folded = rows.withColumn("_folded", F.lower(F.coalesce(F.col(text), F.lit(""))))
    folded = folded.withColumns({name: found_terms(F.col(c), terms) for name, (terms, c) in found.items()})
    d, m = F.col("_direct"), F.col("_medium")
    tier = F.when(F.size(d) > 0, "HIGH").when(F.size(m) > 0, "MEDIUM").otherwise("LOW")
    high, some = F.least(F.lit(1.0), F.lit(0.72) + F.lit(0.06) * F.size(d)), F.least(F.lit(0.79), F.lit(0.46) + F.lit(0.08) * F.size(m))
    score = F.round(F.when(F.size(d) > 0, high).when(F.size(m) > 0, some).otherwise(F.lit(0.0)), 3)
    reason = F.lit("comment semantic label; never a delivery filter")
    label = F.struct(tier.alias("tier"), score.alias("score"), distinct_folded(F.concat(d, m)).alias("evidence_terms"), reason.alias("reason"))
    return folded.withColumn(into, label).drop("_folded", "_direct", "_medium")


def ranked(candidates: DataFrame) -> DataFrame:
    """HIGH, MEDIUM, LOW, others; then score; then arrival (ord)."""
    rank = F.when(F.col("relevance_tier") == "HIGH", 0).when(F.col("relevance_tier") == "MEDIUM", 1).when(F.col("relevance_tier") == "LOW", 2).otherwise(3)
    return candidates.orderBy(rank, F.desc("relevance_score"), "ord")


def selected(candidates: DataFrame, k: int) -> DataFrame:
    """The k best COLLECT candidates."""
    return ranked(candidates.where("decision = 'COLLECT'")).limit(k)
