"""Product profiles from product facts, and query plans from profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, words
from ..tables import written

# Fixed values of the profile rules.
FUNCTIONS = ["joint mobility", "joint health", "pain relief", "skin care", "oral care", "slow down eating", "slower eating", "longer mealtime", "puzzle enrichment", "non-slip feeding", "easy to clean"]
SCENARIOS = ["senior dog", "large breed dog", "daily use", "post surgery", "small to medium dogs", "wet or dry dog food", "daily mealtime"]
PAINS = ["stiffness", "arthritis", "limping", "struggling to get up", "side effects", "eating too fast", "fast eating", "gulping food"]
INGREDIENTS = ["glucosamine", "chondroitin", "MSM", "omega 3", "food-safe", "BPA-free"]
GENERIC = [
    "joint", "mobility", "health", "support", "supplement", "supplements", "product", "products", "senior", "adult", "dogs", "dog",
    "cats", "cat", "with", "plus", "advanced", "formula", "daily", "care", "medium", "capacity", "feeder", "bowl", "slow", "feeding",
    "small", "notch", "pattern",
]
PHRASES = ["Fun Feeder Slo Bowl", "Outward Hound Fun Feeder", "Cosequin", "Dasuquin"]
CAPTION_PHRASES = ["slow feeding", "eat fast", "eating too fast", "longer mealtime", "improve digestion", "mental stimulation", "puzzle enrichment", "wet food", "dry food", "small snout", "gobbles"]



def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _known(corpus: Column, phrases: list[str], by_word: bool = True) -> Column:
    """Phrases the corpus holds, or (by_word) all of whose words it holds."""

    def has(p: str) -> Column:
        whole = F.contains(corpus, F.lit(p.lower()))
        every = F.lit(by_word)
        for w in p.split(" "):
            every = every & F.contains(corpus, F.lit(w))
        return whole | every

    return F.array_compact(F.array(*(F.when(has(p), F.lit(p)) for p in phrases)))


def build_profiles(products: DataFrame) -> DataFrame:
    """Profiles of product facts (schemas.PRODUCT columns)."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("product_title"), F.lit(""))

    def given_list(*names: str) -> Column:
        """The first of the columns that is there and not empty."""
        lists = [F.when(F.size(n) > 0, F.col(n)) for n in names if n in products.columns]
        return F.coalesce(*lists, F.array().cast("array<string>"))

    base = products.withColumns({"_title": title, "_bullets": clean(given_list("bullets", "core_attributes"))})
    base = base.withColumn("_corpus", F.lower(F.array_join(F.concat(F.array("_title"), "_bullets"), " ")))
    first_word = F.filter(F.split(F.trim("_title"), r"\s+"), lambda w: w != "")
    brand = F.coalesce(F.nullif("brand", F.lit("")), F.try_element_at(first_word, F.lit(1)))
    given = F.coalesce(F.nullif("category", F.lit("")), F.nullif("product_type", F.lit("")))
    given = F.when(F.contains(F.lower(given), F.lit("a+")) | F.contains(given, F.lit("拼图")), None).otherwise(given)
    corpus = F.col("_corpus")
    derived = F.when(corpus.rlike(r"(?:slow|slo|puzzle)\s+(?:feeder|feeding|bowl)"), "slow feeder dog bowl").when(F.contains(corpus, F.lit("dog bowl")), "dog bowl")
    derived = derived.when(F.contains(corpus, F.lit("joint")) & (F.contains(corpus, F.lit("dog")) | F.contains(corpus, F.lit("pet"))), "dog joint supplement")
    concise = F.trim(F.split("_title", r"\s+[–—-]\s+|,", 2)[0])
    base = base.withColumns({"_brand": brand, "_category": F.coalesce(given, derived), "_name": F.coalesce(F.nullif("product_name", F.lit("")), F.nullif(concise, F.lit("")), F.nullif("_title", F.lit("")), F.col("asin"))})
    tokens = F.regexp_extract_all("_title", F.lit("[A-Za-z0-9+.-]+"), F.lit(0))
    brand_words = words(F.col("_brand"))
    own = F.filter(tokens, lambda t: (F.length(t) >= 5) & ~F.array_contains(brand_words, F.lower(t)) & ~F.lower(t).isin(GENERIC))
    base = base.withColumns({
        "core_functions": clean(F.concat(given_list("functions", "primary_functions"), _known(corpus, FUNCTIONS))), "_scenarios": clean(F.concat(given_list("use_scenarios", "use_cases"), _known(corpus, SCENARIOS))),
        "_pains": clean(F.concat(given_list("pain_points", "problems"), _known(corpus, PAINS))), "_ingredients": clean(F.concat(given_list("ingredients", "ingredients_or_components"), _known(corpus, INGREDIENTS, by_word=False))),
        "product_aliases": F.slice(clean(F.concat(given_list("aliases", "common_names"), _known(corpus, PHRASES, by_word=False), own)), 1, 5),
    })
    keywords = clean(F.concat(F.array("_brand", "_name", "_category"), "core_functions", "_scenarios", "_pains", "_ingredients", F.slice(words(F.col("_title")), 1, 10)))
    return base.select(
        "asin", F.col("_brand").alias("brand"), F.col("_name").alias("product_name"), F.col("_category").alias("category"), "product_aliases", "core_functions",
        F.col("_scenarios").alias("use_scenarios"), F.col("_pains").alias("pain_points"), F.col("_ingredients").alias("ingredients"), clean(given_list("competitors", "competitor_products")).alias("competitors"),
        keywords.alias("keywords"), F.coalesce(F.nullif("source_status", F.lit("")), F.when(F.col("_title") != "", "available").otherwise("asin_only")).alias("source_status"),
        F.coalesce(F.nullif("source_url", F.lit("")), F.concat(F.lit("https://www.amazon.com/dp/"), "asin")).alias("source_url"),
    )


def _first(column: str, otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col(column), F.lit(1)), otherwise)


def _squeeze(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def _plan(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"executed": F.lit(False), "posts_found": F.lit(0), "qualified_posts": F.lit(0)})


def _entry(query: Column, family: str, priority: int, slot: int) -> Column:
    return F.struct(F.lit(slot).alias("slot"), _squeeze(query).alias("query"), F.lit(family).alias("query_family"), F.lit(priority).alias("priority"))


def _first_per_query(rows: DataFrame) -> DataFrame:
    """Of equal queries (case folded) the one of highest priority, then earliest."""
    best = rows.groupBy(F.lower("query").alias("_q")).agg(F.min_by(F.struct(*rows.columns), F.struct(-F.col("priority"), "profile_ord", "slot")).alias("r"))
    return best.where("_q <> ''").select("r.*")


def seed_queries(profiles: DataFrame) -> DataFrame:
    """Seven query families per profile (with profile_ord), one row per distinct query."""
    empty = F.lit("")
    category, name = F.col("category"), F.coalesce("product_name", "asin")
    function, scenario, pain = _first("core_functions", F.lit("product review")), _first("use_scenarios", F.lit("daily use")), _first("pain_points", F.lit("problem solution"))
    ingredient = _first("ingredients", F.coalesce(category, F.lit("product")))
    what, brand = F.coalesce(category, ingredient), F.coalesce("brand", empty)
    entity = F.when((brand != "") & ~F.contains(F.lower(name), F.lower(brand)), F.concat_ws(" ", brand, name)).otherwise(name)
    plan = F.array(
        _entry(entity, "product_entity", 100, 0), _entry(F.concat(name, F.lit(" review")), "decision_intent", 95, 1), _entry(F.concat(brand, F.lit(" "), F.coalesce(category, name)), "brand_category", 90, 2),
        _entry(F.concat(what, F.lit(" "), function), "category_solution", 85, 3), _entry(F.concat(pain, F.lit(" "), what), "problem_pain", 82, 4),
        _entry(F.concat(scenario, F.lit(" "), function), "use_scenario", 78, 5), _entry(F.concat(what, F.lit(" review")), "category_review", 76, 6),
    )
    terms = clean(F.array("brand", "product_name", "category", function, scenario, pain, ingredient))
    rows = profiles.select("profile_ord", "asin", terms.alias("source_terms"), F.explode(plan).alias("p")).select("profile_ord", "asin", "source_terms", "p.*")
    return _plan(_first_per_query(rows).withColumn("generation_source", F.lit("asin_product_profile")))


def _anchor(fallback: list[Column]) -> Column:
    long = F.filter("product_aliases", lambda a: F.size(words(a)) >= 2)
    return F.coalesce(F.try_element_at(long, F.lit(1)), *fallback)


def expansion_queries(profiles: DataFrame, existing: DataFrame) -> DataFrame:
    """Four further families per profile, without queries that exist."""
    brand, alias = F.coalesce("brand", F.lit("")), _anchor([F.col("product_name"), F.col("asin")])
    function, scenario, pain = _first("core_functions", F.lit("product experience")), _first("use_scenarios", F.lit("daily use")), _first("pain_points", F.lit("eating too fast"))
    plan = F.array(
        _entry(F.concat(alias, F.lit(" dog review")), "decision_intent", 74, 0), _entry(F.concat(alias, F.lit(" "), function), "category_solution", 72, 1),
        _entry(F.concat(brand, F.lit(" "), alias, F.lit(" "), scenario), "usage_context", 70, 2), _entry(F.concat(alias, F.lit(" "), pain), "problem_pain", 68, 3),
    )
    terms = clean(F.array(brand, alias, function, scenario, pain))
    rows = profiles.select("profile_ord", "asin", terms.alias("source_terms"), F.explode(plan).alias("p")).select("profile_ord", "asin", "source_terms", "p.*")
    # arrival order, not priority, decides between equal expansions
    first = rows.groupBy(F.lower("query").alias("_q")).agg(F.min_by(F.struct(*rows.columns), F.struct("profile_ord", "slot")).alias("r"))
    new = first.join(existing.select(F.lower("query").alias("_q")).distinct(), "_q", "left_anti").select("r.*")
    return _plan(new.withColumn("generation_source", F.lit("grouped_semantic_gate_v2_expansion")))


def evidence_queries(profiles: DataFrame, media: DataFrame, comments: DataFrame, existing: DataFrame, round_number: int = 1, limit: int = 4) -> DataFrame:
    """Follow-up queries from qualified media (ord, shortcode, caption, evidence_terms, hashtags, matched_asins, tier, eligible)
    and comments (ord, media_id, comment_id, tier, terms). The cap holds over all profiles, in profile order."""
    anchor = _anchor([F.col("brand"), F.col("product_name"), F.col("asin")])
    own = F.array_except(F.array_distinct(words(F.array_join(clean(F.concat(F.array("brand", "product_name", "category"), "product_aliases", "core_functions")), " "))), _strings(["dogs", "dog", "pets", "pet", "review", "daily"]))
    p = profiles.select("profile_ord", "asin", anchor.alias("anchor"), own.alias("tokens"))
    good = media.where(F.col("relevance_tier").isin("HIGH", "MEDIUM") & F.col("deliverable_eligible"))
    asins = F.coalesce("matched_asins", F.array().cast("array<string>"))
    # media without ASINs go with every profile: the profiles' ASINs come along as one row, an array of a run's products
    every = p.agg(F.collect_set("asin").alias("_every"))
    named = F.when(F.size(asins) > 0, F.array_distinct(asins)).otherwise(F.col("_every"))
    pairs = good.crossJoin(every).select(*(c for c in media.columns if c != "matched_asins"), F.explode(named).alias("asin"))  # one row on that side
    pairs = written(pairs.join(p, "asin"), "evidence")  # both kinds of evidence read it
    caption = F.lower(F.coalesce("caption", F.lit("")))
    phrases = F.filter(_strings(CAPTION_PHRASES), lambda t: F.contains(caption, t))
    tags = F.filter(F.coalesce("hashtags", F.array().cast("array<string>")), lambda t: F.exists("tokens", lambda k: F.contains(F.regexp_replace(F.lower(t), "[^a-z0-9]+", ""), k)))
    kind = lambda n, name, values: F.transform(values, lambda v, i: F.struct(F.lit(n).alias("kind"), F.lit(name).alias("evidence_kind"), i.alias("place"), v.alias("signal")))
    signals = F.concat(kind(0, "rendered_caption", phrases), kind(1, "rendered_media", F.coalesce("evidence_terms", F.array().cast("array<string>"))), kind(2, "rendered_hashtag", F.transform(tags, lambda t: F.regexp_replace(t, "^#+", ""))))
    none = F.lit(None).cast("string")
    from_media = pairs.select("profile_ord", "asin", "anchor", "shortcode", none.alias("comment_id"), F.col("ord"), F.explode(signals).alias("s"))
    said = comments.where(F.col("comment_relevance_tier").isin("HIGH", "MEDIUM")).join(pairs.select("profile_ord", "asin", "anchor", F.col("shortcode").alias("media_id")).distinct(), "media_id")
    from_comments = said.select("profile_ord", "asin", "anchor", F.col("media_id").alias("shortcode"), "comment_id", "ord", F.explode(kind(3, "verified_comment", F.col("comment_evidence_terms"))).alias("s"))
    rows = from_media.unionByName(from_comments).select("profile_ord", "asin", "anchor", "shortcode", "comment_id", "ord", "s.kind", "s.evidence_kind", "s.place", F.trim(F.regexp_replace("s.signal", "[_#]+", " ")).alias("signal"))
    key, fold = F.lower("signal"), F.lower("anchor")
    rows = rows.where((F.length("signal") >= 4) & ~F.contains(fold, key) & ~F.contains(key, fold)).withColumn("query", _squeeze(F.concat_ws(" ", "anchor", "signal")))
    rows = rows.withColumn("signature", F.array_join(F.array_sort(words(F.col("query"))), " "))
    order = F.struct("profile_ord", "kind", "ord", "place")
    once = rows.groupBy("signature").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "signature"]), order).alias("r")).select("signature", "r.*")
    once = once.groupBy(F.lower("query").alias("_q")).agg(F.min_by(F.struct(*once.columns), order).alias("r")).select("_q", "r.*")
    known = existing.select(F.lower("query").alias("_q"), F.array_join(F.array_sort(words(F.col("query"))), " ").alias("signature"))
    new = once.join(known.select("_q").distinct(), "_q", "left_anti").join(known.select("signature").distinct(), "signature", "left_anti")
    capped = new.orderBy("profile_ord", "kind", "ord", "place").limit(limit)
    from pyspark.sql import Window

    ranked = capped.withColumn("n", F.row_number().over(Window.orderBy("profile_ord", "kind", "ord", "place")) - 1)  # at most `limit` rows
    return _plan(ranked.select("asin", "query", F.lit("verified_evidence_expansion").alias("query_family"), F.lit(f"verified_high_media_evidence_round_{round_number}").alias("generation_source"), F.col("anchor").alias("strong_anchor"), clean(F.array("anchor", "signal")).alias("source_terms"), "evidence_kind", clean(F.array("shortcode")).alias("evidence_shortcodes"), clean(F.array("comment_id")).alias("evidence_comment_ids"), (66 - F.col("n")).alias("priority")))


def query_stats(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """executed (null: false), posts_found (kept once set, 0 for a query that was never executed) and qualified_posts per query.

    candidates: shortcode, source_query, matched_queries, decision. Without the column nothing was executed.
    """
    named = F.array_distinct(F.concat(F.array("source_query"), F.coalesce("matched_queries", F.array().cast("array<string>"))))
    each = candidates.select("shortcode", "decision", F.explode(named).alias("query")).where("query IS NOT NULL")
    stats = each.groupBy("query").agg(F.count_distinct("shortcode").alias("_found"), F.count_distinct(F.when(F.col("decision") == "COLLECT", F.col("shortcode"))).alias("_good"))
    executed = F.coalesce("executed", F.lit(False)) if "executed" in queries.columns else F.lit(False)
    out = queries.join(stats, "query", "left").withColumn("executed", executed)
    found = F.when(F.col("executed"), F.coalesce("_found", F.lit(0))).otherwise(F.lit(0))
    return out.withColumns({"posts_found": F.coalesce("posts_found", found), "qualified_posts": F.coalesce("_good", F.lit(0))}).drop("_found", "_good")
