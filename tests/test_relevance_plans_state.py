from __future__ import annotations

from pyspark.sql import functions as F

from chorusmill.operators import profiles, relevance, run, state, threads
from chorusmill.schemas import PRODUCT
from chorusmill.sources import captures as sources


def product(spark, **values):
    names = [c.strip().split(" ")[0] for c in PRODUCT.split(", ")]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], PRODUCT)


def feeder(spark):
    p = product(spark, asin="B00TEST000", title="Outward Hound Fun Feeder Slo Bowl, Large", brand="Outward Hound", bullets=["Slow down eating", "longer mealtime for your dog"], competitors=["Rival Bowl"])
    return profiles.build_profiles(p).withColumn("profile_ord", F.lit(0))


def test_profile(spark):
    p = feeder(spark).first()
    assert p["category"] == "slow feeder dog bowl"
    other = profiles.build_profiles(product(spark, asin="B1", title="X", core_attributes=["Easy to clean"], primary_functions=["f"], use_cases=["u"], problems=["p"], ingredients_or_components=["i"], common_names=["n n"], competitor_products=["c"])).first()
    assert other["core_functions"] == ["f", "easy to clean"] and other["use_scenarios"] == ["u"] and other["pain_points"] == ["p"] and other["ingredients"] == ["i"] and other["product_aliases"] == ["n n"] and other["competitors"] == ["c"]
    assert p["product_name"] == "Outward Hound Fun Feeder Slo Bowl" and "slow down eating" in p["core_functions"] and "Fun Feeder Slo Bowl" in p["product_aliases"]
    empty = profiles.build_profiles(product(spark, asin="B00TEST000")).first()
    assert empty["product_name"] == "B00TEST000" and empty["source_status"] == "asin_only" and empty["brand"] is None


def scored(spark, *captions):
    none, lists = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    media = spark.createDataFrame([(k, c) for k, c in enumerate(captions)], "ord int, caption string")
    media = media.withColumn("evidence", relevance.rendered_evidence(F.col("caption"), lists, none, lists, none, none, lists))
    return relevance.score_media(media, feeder(spark)).orderBy("ord").collect()


def test_tiers(spark):
    high, low, conflict, brand, none = scored(spark, "My Fun Feeder Slo Bowl dog", "nothing here", "Outward Hound for cats", "Outward Hound", None)
    assert (high["relevance_tier"], high["deliverable_eligible"]) == ("HIGH", True) and high["relevance_score"] >= 0.85 and "caption" in high["evidence_sources"]
    assert low["relevance_tier"] == "LOW" and conflict["relevance_score"] == 0.0 and conflict["relevance_reason"] == "species_or_category_conflict"
    assert none["relevance_tier"] == "LOW" and none["relevance_score"] == 0.0


def test_no_profile(spark):
    media = spark.createDataFrame([("x",)], "caption string").withColumn("evidence", F.create_map(F.lit("caption"), "caption"))
    got = relevance.score_media(media, feeder(spark).where("false")).first()
    assert got["relevance_tier"] == "LOW" and got["relevance_score"] == -1.0 and got["evidence_terms"] == []


def test_comment_labels(spark):
    said = spark.createDataFrame([(0, "love FUN feeder"), (1, "a slow dog bowl"), (2, "hi"), (3, None)], "n int, said string")
    got = [r["semantic"] for r in relevance.labelled(said, "said", ["Fun Feeder", " fun  feeder"], ["dog bowl", "slow"]).orderBy("n").collect()]
    assert got[1]["evidence_terms"] == ["dog bowl", "slow"]
    assert [(g["tier"], g["score"]) for g in got] == [("HIGH", 0.78), ("MEDIUM", 0.62), ("LOW", 0.0), ("LOW", 0.0)]


def test_query_plans(spark):
    p = feeder(spark)
    seeds = profiles.seed_queries(p)
    rows = {r["query_family"]: r["query"] for r in seeds.collect()}
    assert rows["product_entity"] == "Outward Hound Fun Feeder Slo Bowl" and rows["decision_intent"].endswith(" review")
    more = profiles.expansion_queries(p, seeds.select("query"))
    assert more.count() == 4 and profiles.expansion_queries(p, more.select("query")).count() == 0
    media = spark.createDataFrame([(0, "A", "My dog is EATING TOO FAST; dry food", ["mealtime"], ["#slowbowl"], None, "HIGH", True), (1, "B", "dry food", [], [], None, "LOW", False)], "ord int, shortcode string, caption string, evidence_terms array<string>, hashtags array<string>, matched_asins array<string>, relevance_tier string, deliverable_eligible boolean")
    said = spark.createDataFrame([(0, "A", "c1", "MEDIUM", ["gobbling"])], "ord int, media_id string, comment_id string, comment_relevance_tier string, comment_evidence_terms array<string>")
    got = profiles.evidence_queries(p, media, said, seeds.select("query"), limit=4).orderBy(F.desc("priority")).collect()
    assert [r["priority"] for r in got] == [66, 65, 64, 63] and got[0]["evidence_kind"] == "rendered_caption" and got[0]["evidence_shortcodes"] == ["A"]


def test_query_stats_keep_first_found(spark):
    q = spark.createDataFrame([("a", 7, False), ("b", None, True), ("c", None, None), ("d", None, False)], "query string, posts_found int, executed boolean")
    c = spark.createDataFrame([("1", "a", ["a", "b"], "COLLECT"), ("2", "b", None, "AUDIT_ONLY"), ("3", "c", ["d"], "COLLECT")], "shortcode string, source_query string, matched_queries array<string>, decision string")
    got = profiles.query_stats(q, c).orderBy("query").select("query", "executed", "posts_found", "qualified_posts").collect()
    assert [tuple(r) for r in got] == [("a", False, 7, 1), ("b", True, 2, 1), ("c", False, 0, 1), ("d", False, 0, 1)]
    assert {r["posts_found"] for r in profiles.query_stats(q.select("query", F.lit(None).cast("int").alias("posts_found")), c).collect()} == {0}


def test_reply_trees(spark):
    chain = [("t", str(k), str(k - 1) if k else None) for k in range(3000)]
    odd = [("u", "a", "gone"), ("u", "b", "a"), ("u", "c", "d"), ("u", "d", "e"), ("u", "e", "c"), ("u", "f", "c"), ("u", "g", "g"), ("u", None, "a"), (None, "a", None), (None, "b", "a"), ("v", "b", "0")]
    got = {(r["tree"], r["node"]): (r["depth"], r["root"]) for r in threads.reply_trees(spark.createDataFrame(chain + odd, "tree string, node string, parent string")).collect()}
    want = {("t", str(k)): (k, "0") for k in range(3000)} | {("u", "a"): (0, "a"), ("u", "b"): (1, "a"), (None, "a"): (0, "a"), (None, "b"): (1, "a"), ("v", "b"): (0, "b")}
    assert got == want | {("u", k): (None, None) for k in "cdefg"}
    assert threads.reply_trees(spark.createDataFrame([], "tree string, node string, parent string")).count() == 0


def test_cooldown_saturation_retry(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(state.cooldown_seconds(F.lit(n))) for n in (0, 1, 2, 3, 8)] == [0, 3600, 14400, 43200, 43200]
    rounds = spark.createDataFrame([(0, k, g) for k, g in enumerate([3, 0, 0, 2, 0])], "run int, n int, added int")
    got = state.streaks(rounds, ["run"], ["n"], F.col("added") > 0).orderBy("n").select("streak", state.saturation(F.col("streak"))).collect()
    assert [tuple(r) for r in got] == [(0, "ACTIVE"), (1, "ACTIVE"), (2, "semantic_saturation"), (0, "ACTIVE"), (1, "ACTIVE")]
    retry = lambda rows, status, platform, partial=True, force=False: one(state.needs_retry(F.lit(rows).cast("int"), F.lit(status), F.lit(platform), F.lit(1000), F.lit(partial), F.lit(force)))
    assert [retry(0, "PASS", 9), retry(5, "PARTIAL", 9), retry(4, "PASS", 40), retry(40, "PASS", 40), retry(4, "PARTIAL", 40, partial=False), retry(None, "PASS", 1), retry(40, "PASS", 40, force=True)] == [True, True, True, False, False, True, True]


def test_stop_reasons_jobs_and_idle(spark):
    limits = {"target_comments": 5, "max_rounds": 3, "max_expand_actions": 2, "idle_rounds": 2, "max_runtime_ms": 100}
    stop = lambda *v, limits=limits: spark.range(1).select(state.continuous_stop(*map(F.lit, v), limits)).first()[0]
    assert [stop(5, 9, 9, 9, 999), stop(0, 3, 2, 2, 100), stop(0, 0, 2, 2, 100), stop(0, 0, 0, 2, 100), stop(0, 0, 0, 0, 100), stop(0, 0, 0, 0, 0)] == ["target_comments", "max_rounds", "max_expand_actions", "idle_rounds", "max_runtime", None]
    assert stop(99, 0, 0, 0, 0, limits={}) is None
    log = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "active"), ("b", 3, "pending"), ("c", 4, "active"), ("c", 5, "completed")], "job_id string, seq int, status string")
    assert [(r["job_id"], r["status"]) for r in state.jobs(log).orderBy("queue", "first_seq").collect()] == [("a", "pending"), ("b", "pending"), ("c", "completed")]
    t, f, z = F.lit(True), F.lit(False), F.lit(0)
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(state.visible_exhausted(t, f, z, f, F.lit(3), F.lit(95), F.lit(100), F.lit(200))) and not one(state.visible_exhausted(t, t, z, t, z, z, z, z))


def test_saved_pages(spark):
    page = '<html><head><title>T</title></head><body><span id="productTitle"> Slow  Bowl </span><a id="bylineInfo">Visit the Acme Store</a><div id="availability">In Stock</div></body></html>'
    got = sources.product_facts(spark.createDataFrame([("B0", page), ("B1", None)], "asin string, html string")).orderBy("asin").collect()
    assert (got[0]["title"], got[0]["brand"], got[0]["available"]) == ("Slow Bowl", "Acme", True) and got[1]["title"] is None
    media = '<html><head><link rel="canonical" href="https://www.instagram.com/p/A/"><meta property="og:description" content="x"></head><body>hello <img alt="a dog with a bowl"></body></html>'
    m = sources.media_metadata(spark.createDataFrame([("https://www.instagram.com/p/A/", media)], "url string, html string")).first()
    assert m["identity"]["reason"] == "verified" and m["media_alt_text"] == "a dog with a bowl" and m["visible_text"] == "hello"
    links = spark.createDataFrame([("q", 0, "https://r.example/url?q=https%3A%2F%2Fwww.instagram.com%2Fp%2FA%2F", "short"), ("q", 1, "https://www.instagram.com/reel/A/", "longer #tag")], "query string, ord int, url string, text string")
    got = sources.search_links(links).collect()
    assert len(got) == 1 and got[0]["text"] == "longer #tag" and got[0]["media_type"] == "p"


def test_candidate_operators(spark):
    none, lists = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    c = spark.createDataFrame([(0, "A", "My Fun Feeder Slo Bowl"), (1, "B", "nothing")], "ord int, shortcode string, caption string")
    c = c.withColumns({"evidence": relevance.rendered_evidence(F.col("caption"), lists, none, lists, none, none, lists), "stop_reason": none, "audit_status": F.lit("DISCOVERED")})
    got = {r["shortcode"]: r for r in run.rechecked(c, feeder(spark)).collect()}
    assert (got["A"]["audit_status"], got["B"]["audit_status"], got["B"]["stop_reason"], got["B"]["decision"]) == ("DISCOVERED", "PARTIAL", "semantic_gate_recheck_failed", "AUDIT_ONLY")
    assert len(run.candidate_audit(c).columns) == 39 and run.candidate_audit(c).where("shortcode = 'A'").first()["owner"] is None
    known = spark.createDataFrame([("P1", "Acme Pets!", 1), ("P1", "Later", 2)], "asin string, brand string, profile_ord int")
    asked = spark.createDataFrame([("P1", "product_entity", True), ("P2", "product_entity", None), ("P1", "x", False)], "asin string, query_family string, executed boolean")
    assert {(r["asin"], r["query_family"]): r["account_url"] for r in run.with_account(asked, known).collect()} == {("P1", "product_entity"): "https://www.instagram.com/acmepets/", ("P2", "product_entity"): None, ("P1", "x"): None}
    assert run.pending_queries(asked).count() == 2
    assert [r["asin"] for r in run.unknown_asins(spark.createDataFrame([(1, "P2"), (0, "P3"), (2, "P1")], "ord int, asin string"), known).collect()] == ["P3", "P2"]
    assert run.run_asins(known, asked).first()[0] == ["P1", "P2"]


def test_claims_and_nearest(spark):
    log = spark.createDataFrame([("a", 1, "pending"), ("b", 2, "pending"), ("c", 3, "pending"), ("b", 4, "active"), ("a", 5, "active"), ("d", 6, "pending"), ("d", 7, "failed")], "job_id string, seq int, status string")
    assert [r["job_id"] for r in run.claim_order(state.jobs(log)).collect()] == ["a", "b", "c"]
    items = spark.createDataFrame([("v", 0, True, False, 1.0), ("v", 1, True, True, 9.0), ("v", 2, True, True, 9.0), ("v", 3, False, True, 0.0), ("w", 0, True, False, 5.0)], "view string, index int, in_viewport boolean, expanded boolean, distance double")
    assert {r["view"]: r["index"] for r in run.nearest(items, ["view"]).collect()} == {"v": 1, "w": 0}
