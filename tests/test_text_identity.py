from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorusmill.functions import identity, text


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return row.asDict(recursive=True)


def test_clean_and_words(spark):
    got = one(spark, c=text.clean(F.array(F.lit("  A  b ,"), F.lit("a b"), F.lit(None), F.lit(" - "))), w=text.words(F.lit("The Slow-Feeder for dogs, a+b 12 it")))
    assert got == {"c": ["A b"], "w": ["slow-feeder", "dogs", "a+b"]}
    assert one(spark, c=text.clean(F.lit(None).cast("array<string>")))["c"] == []


def test_counts(spark):
    for label, want in (("6,565 comments", 6565), ("评论 6.6万", 66000), ("6,566", 6566), ("none", None), (None, None)):
        assert one(spark, n=text.visible_count(F.lit(label).cast("string")))["n"] == want


def test_labels_and_restrictions(spark):
    got = one(
        spark, a=text.is_expansion_label(F.lit(" View all  12 more comments ")), b=text.is_expansion_label(F.lit("查看更多评论")), c=text.is_expansion_label(F.lit("comment")), d=text.is_trigger_label(F.lit("Open comments")), e=text.is_empty_label(F.lit("No comments yet.")),
        f=text.combined_label(F.array(F.lit(" a "), F.lit("a"), F.lit("b"))), g=text.restriction(F.lit("Please Try again later")), h=text.restriction(F.lit("fine")), i=text.visible_error(F.lit(""), F.lit("https://x/accounts/login/")),
        j=text.author_name(F.lit("@ann Verified")), k=text.like_text(F.lit("1,204 likes")), l=text.tag_slug(F.lit("Slow Feeder!")), m=text.tag_slug(F.lit("!!")), n=text.truth(F.lit(" Off ")), o=text.hashtags(F.lit("x #a_b #狗 #a_b")),
        p=text.own_text(F.lit("ann\nnice bowl\nReply\n3 likes\n2d"), F.lit("ann"), F.array(F.lit("Reply")), F.lit("2d")), q=text.has_rate_limit(F.struct(F.array(F.lit("Too many requests")).alias("x")), T.StructType([T.StructField("x", T.ArrayType(T.StringType()))])),
    )
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": True, "f": "a | b", "g": "rate_limited", "h": "ready", "i": "login_required", "j": "ann", "k": "1,204", "l": "slowfeeder", "m": None, "n": False, "o": ["#a_b", "#狗"], "p": "nice bowl", "q": True}


def test_media_addresses(spark):
    owned = F.lit("https://instagram.com/own.er/reels/Ab_1?x=1")
    got = one(spark, a=identity.canonical_media(owned), b=identity.media_identity(owned), c=identity.alternate_url(owned), d=identity.canonical_media(F.lit("http://instagram.com/p/A/")), e=identity.canonical_media(F.lit(None).cast("string")), f=identity.comment_id(F.lit("https://www.instagram.com/p/A/c/17/")), g=identity.comment_id(F.lit("https://x.y/?commentId=5")), h=identity.shortcode_in(F.lit("see /reel/Zz-9 now")))
    assert got["a"] == {"media_id": "Ab_1", "media_type": "reel", "owner": "own.er", "media_url": "https://www.instagram.com/reel/Ab_1/"}
    assert got["b"] is None and got["d"] is None and got["e"] is None
    assert (got["c"], got["f"], got["g"], got["h"]) == ("https://www.instagram.com/p/Ab_1/", "17", "5", "Zz-9")


def test_identity_checks(spark):
    page = F.from_json(F.lit('{"identity_verified": true, "shortcode_mismatch_count": 1, "observed_shortcodes": ["X"]}'), "struct<identity_verified:boolean,shortcode_mismatch_count:int,observed_shortcodes:array<string>>")
    media = F.from_json(F.lit('{"media_url": "https://www.instagram.com/p/A/"}'), "struct<media_id:string,media_url:string>")
    comments = F.from_json(F.lit('[{"comment_url": null}, {"comment_url": "https://www.instagram.com/p/A/c/1/"}, {"comment_url": "https://www.instagram.com/p/B/"}]'), "array<struct<comment_url:string>>")
    got = one(spark, strict=identity.mismatch_count(F.lit("A"), page, comments), loose=identity.collection_check(F.lit("A"), media, page, comments))
    assert got == {"strict": 3, "loose": {"ok": False, "actual_shortcode": "A", "mismatch_count": 2, "observed_shortcodes": ["A", "B", "X"]}}
    p = lambda c: F.lit(f"https://www.instagram.com/p/{c}/")
    none = F.lit(None).cast("string")
    lists = F.array().cast("array<string>")
    v = lambda *a: one(spark, v=identity.verify_identity(*a))["v"]["reason"]
    assert v(p("A"), p("A"), none, lists, none) == "verified"
    assert v(p("A"), none, none, lists, none) == "identity_evidence_not_ready"
    assert v(p("A"), p("A"), none, F.array(p("B")), none) == "MEDIA_ID_MISMATCH"
    assert v(p("A"), p("A"), none, lists, F.lit("C")) == "MEDIA_ID_MISMATCH"
    r = one(spark, r=identity.route_evidence(p("A"), p("A"), p("A"), F.lit("https://www.instagram.com/reel/A/"), none, lists, F.lit(""), F.lit(True)))["r"]
    assert r["ok"] and r["evidence_conflicts"] == ["canonical_route_type"]
