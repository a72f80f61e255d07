from __future__ import annotations

import json

from pyspark.sql import functions as F

from chorusmill.operators import profiles, rounds
from chorusmill.sources import sinks

from .test_relevance_plans_state import feeder

MEDIA = "shortcode string, evidence map<string,string>, caption string, hashtags array<string>"


def media(spark, *rows):
    return spark.createDataFrame([(code, {"caption": text} if text else {}, text, tags) for code, text, tags in rows], MEDIA)


def address(code):
    return f"https://www.instagram.com/p/{code}/"


def plan_of(found):
    return {r["query"]: r for r in found.plan.collect()}


def test_rounds_until_nothing_grows(spark, tmp_path):
    p = feeder(spark)
    seeds = [r["query"] for r in profiles.seed_queries(p).orderBy(F.desc("priority")).collect()]
    more = [r["query"] for r in profiles.expansion_queries(p, profiles.seed_queries(p)).collect()]
    good = "My dog loves the Outward Hound Fun Feeder Slo Bowl, no more eating too fast"
    links = [(seeds[0], 0, address("A")), (seeds[0], 1, address("B")), (seeds[1], 0, address("A")), (seeds[1], 1, "https://example.com/"), (more[0], 0, address("C"))]
    table = spark.createDataFrame(links, "query string, place int, url string")
    shown = media(spark, ("A", good, ["#slowbowl"]), ("B", "a cat", []), ("C", good, []), ("D", good, []))
    first = rounds.discover(p, table, shown, soft=False)
    assert [(r["kind"], r["newly_eligible"], r["streak"]) for r in first.rounds.orderBy("round").collect()] == [("seed", 1, 0), ("expansion", 1, 0)]
    rows = plan_of(first)
    assert all(r["executed"] for r in rows.values()) and (rows[seeds[0]]["posts_found"], rows[seeds[0]]["qualified_posts"]) == (2, 1)
    assert (rows[seeds[1]]["posts_found"], rows[seeds[1]]["qualified_posts"], rows[seeds[2]]["posts_found"]) == (2, 1, 0)
    assert {r["shortcode"]: list(r["matched_queries"]) for r in first.candidates.collect()} == {"A": seeds[:2], "B": [seeds[0]], "C": [more[0]]}

    plan = sinks.write_discovery(first, p, str(tmp_path), 30, 1000)
    assert [q["query"] for q in plan["queries"]][: len(seeds)] == seeds and plan["product_profiles"][0]["asin"] == plan["amazon_asins"][0]
    back = {name: json.loads((tmp_path / f"{name}.json").read_text(encoding="utf-8")) for name in ("media_candidates", "conversation_map", "query_plan")}
    assert {c["shortcode"]: c["decision"] for c in back["media_candidates"]} == {"A": "COLLECT", "B": "AUDIT_ONLY", "C": "COLLECT"} and back["query_plan"]["queries"][0]["posts_found"] == 2 and len(back["conversation_map"]["product_profiles"]) == 1

    asked = [r["query"] for r in rounds.new_queries("evidence", 3, p, first.plan, first.candidates, None, 3).collect()]
    assert asked  # evidence of A and C
    grown = spark.createDataFrame([*links, (asked[-1], 0, address("D"))], "query string, place int, url string")
    soft = rounds.discover(p, grown, shown, most_rounds=3)
    log = [(r["kind"], r["newly_eligible"], r["streak"]) for r in soft.rounds.orderBy("round").collect()]
    assert log == [("seed", 1, 0), ("expansion", 1, 0), ("evidence", 1, 0)]
    assert soft.candidates.where("deliverable_eligible").count() == 3
    queries = [r["query"].lower() for r in soft.plan.collect()]
    assert len(queries) == len(set(queries))


def test_a_round_ends_with_enough_candidates(spark):
    p = feeder(spark)
    seeds = [r["query"] for r in profiles.seed_queries(p).orderBy(F.desc("priority")).collect()]
    links = [(q, k, address(f"M{n}x{k}")) for n, q in enumerate(seeds) for k in range(2)] + [(seeds[1], 2, address("M0x0"))]
    found = rounds.discover(p, spark.createDataFrame(links, "query string, place int, url string"), media(spark), target_posts=1, soft=False, most_rounds=3)
    # the second query brings the third media; then each round asks one query, as there are enough
    asked = {r["query"]: r["executed_round"] for r in found.plan.collect()}
    assert [asked[q] for q in seeds] == [1, 1, 2, 3] + [None] * (len(seeds) - 4)
    assert [r["asked_queries"] for r in found.rounds.orderBy("round").collect()] == [2, 1, 1]


def test_comments_count_as_growth(spark):
    p = feeder(spark)
    seed = profiles.seed_queries(p).orderBy(F.desc("priority")).first()["query"]
    links = spark.createDataFrame([(seed, 0, address("A"))], "query string, place int, url string")
    shown = media(spark, ("A", "Outward Hound Fun Feeder Slo Bowl for dogs", []))
    got = rounds.discover(p, links, shown, collected=spark.createDataFrame([("A", 5), ("B", 7)], "shortcode string, comment_count long"), most_rounds=2)
    assert [(r["new_comments"], r["streak"]) for r in got.rounds.orderBy("round").collect()] == [(5, 0), (0, 1)]
    nothing = rounds.discover(p, links.where("false"), shown)
    assert [r["streak"] for r in nothing.rounds.orderBy("round").collect()] == [1, 2] and nothing.candidates.count() == 0
