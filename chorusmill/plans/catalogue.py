"""The registered queries of the engine's own operators over the driver tables, each with its SQL.

Stand-ins: conversations are threads (conv_id a media, turn a comment), documents are captions with their
source as provenance, labels are the candidates' review, pages are addresses, part is product facts, events
are action logs, orders and lineitem are volume. Results are scalars only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import audit, ingest, merge, profiles, relevance, run, state, threads
from . import captures, rules  # noqa: F401 (registers its queries)
from .registry import ORACLE_SQL, QUERIES, query
from .registry import table as _t

__all__ = ["ORACLE_SQL", "QUERIES"]


def _q(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---- dedupe, provenance, delivery -------------------------------------------------------------


def _document_rows(spark, d) -> DataFrame:
    """Documents as comment rows: some with an id that several share, some without author or text, ord = doc_id."""
    k = F.col("doc_id")
    return _t(spark, d, "documents").select(
        k.alias("ord"), F.lit(0).alias("pos"), F.col("lang").alias("media_id"), F.when(k % 4 == 0, F.concat(F.lit("d"), (k % 48).cast("string"))).alias("comment_id"), F.when(k % 9 != 0, F.col("source")).alias("author"),
        F.when(k % 14 != 1, F.col("text")).alias("comment_text"), F.array("source").alias("amazon_asins"), F.when(k % 5 != 0, F.concat(F.lit("q"), (k % 7).cast("string"))).alias("matched_query"), F.lit(None).cast("array<string>").alias("matched_queries"),
    )


DOCUMENT_ROWS = """WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 5 <> 0 THEN 'q' || (doc_id % 7) END AS q, lang AS media, CASE WHEN doc_id % 4 = 0 THEN 'd' || (doc_id % 48) END AS id, CASE WHEN doc_id % 9 <> 0 THEN source END AS author, CASE WHEN doc_id % 14 <> 1 THEN text END AS body FROM documents),
k AS (SELECT *, id IS NOT NULL OR (author IS NOT NULL AND coalesce(body, '') <> '') AS ok, row(id, CASE WHEN id IS NULL THEN media END, CASE WHEN id IS NULL THEN author END, CASE WHEN id IS NULL THEN body END) AS key FROM d)
"""


@query(DOCUMENT_ROWS + "SELECT count(*) AS raw_rows, count(*) FILTER (WHERE NOT ok) AS invalid_rows, count(*) FILTER (WHERE ok) - count(DISTINCT key) FILTER (WHERE ok) AS duplicate_rows FROM k")
def tech_dedupe_counts(spark, d):
    c = ingest.counters(_document_rows(spark, d))
    return c.select(F.col("raw_captured_count").alias("raw_rows"), F.col("invalid_row_count").alias("invalid_rows"), F.col("technical_duplicate_count").alias("duplicate_rows"))


@query(DOCUMENT_ROWS + """, qs AS (SELECT key, q, min(doc_id) AS first FROM k WHERE ok AND q IS NOT NULL GROUP BY 1, 2), ql AS (SELECT key, string_agg(q, '|' ORDER BY first) AS queries FROM qs GROUP BY 1)
SELECT min(doc_id) AS first_doc, arg_min(md5(coalesce(body, '')), doc_id) AS text_md5, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, any_value(coalesce(queries, '')) AS queries FROM k LEFT JOIN ql USING (key) WHERE ok GROUP BY key""")
def dedupe_provenance_merge(spark, d):
    u = ingest.dedupe(_document_rows(spark, d).where(ingest.is_valid_row()))
    body = F.md5(F.coalesce("comment_text", F.lit("")).cast("binary"))
    return u.select(F.col("ord").alias("first_doc"), body.alias("text_md5"), F.array_join("amazon_asins", "|").alias("sources"), F.array_join("matched_queries", "|").alias("queries"))


@query("""
SELECT coalesce(l.toxic = 0, true) AS eligible, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def eligibility_default_true(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("media_id"))
    listed = _t(spark, d, "labels").select(F.col("doc_id").alias("media_id"), (F.col("toxic") == 0).alias("eligible"))
    kept = ingest.delivered(rows, listed).agg(F.count("*").alias("n")).select(F.lit(True).alias("eligible"), "n")
    left = rows.join(ingest.delivered(rows, listed), "media_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(False).alias("eligible"), "n")
    return kept.unionByName(left).where("n > 0")


def _thread_rows(spark, d) -> DataFrame:
    """Conversations as comment rows: the first turn is a main comment, each later one replies to the one before."""
    c = _t(spark, d, "conversations")
    media = F.col("conv_id").cast("string")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("before", before).select(
        media.alias("media_id"), F.concat(media, F.lit(":"), F.col("turn")).alias("comment_id"), F.when(F.col("before").isNotNull(), F.concat(media, F.lit(":"), F.col("before"))).alias("parent_comment_id"),
        F.when(F.col("before").isNotNull(), 1).otherwise(0).alias("depth"), F.col("role").alias("author"), F.col("text").alias("comment_text"), F.col("conv_id").alias("ord"), F.col("turn").alias("pos"),
    )


THREADS = """WITH turns AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
threads AS (SELECT conv_id, conv_id::VARCHAR AS media_id, conv_id || ':' || turn AS comment_id, CASE WHEN before IS NOT NULL THEN conv_id || ':' || before END AS parent_id, role AS author, text, turn FROM turns)
"""


@query(captures.CAPTURES + """ SELECT code AS media_id, sum(rows_)::BIGINT AS captured_rows, sum(texts)::BIGINT AS text_rows, sum(rows_ - replies)::BIGINT AS main_rows, sum(replies)::BIGINT AS reply_rows, arg_max(audit, c) AS last_status FROM aud GROUP BY 1""")
def media_audit_counts(spark, d):
    r = audit.capture_reports(ingest.valid(ingest.checked(captures.captures(spark, d))))
    sums = {"captured_rows": "captured_rows", "text_rows": "text_rows", "main_rows": "main_comment_rows", "reply_rows": "reply_rows"}
    counts = r.groupBy("media_id").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    return counts.join(audit.latest_audits(r).select("media_id", F.col("audit_status").alias("last_status")), "media_id")


@query(THREADS + """
SELECT coalesce(p.author, 'none') AS parent_author, t.author AS author, count(*) AS n
FROM threads t LEFT JOIN threads p ON p.media_id = t.media_id AND p.comment_id = t.parent_id GROUP BY 1, 2""")
def reply_lineage(spark, d):
    rows = ingest.lineage(_thread_rows(spark, d))
    return rows.groupBy(F.coalesce("parent_author", F.lit("none")).alias("parent_author"), "author").agg(F.count("*").alias("n"))


@query(captures.CAPTURES + captures.KEYED + """, fin AS (SELECT DISTINCT ON (code) *, mismatch + found_wrong AS wrong FROM aud ORDER BY code, c DESC)
SELECT (SELECT count(*) FROM rws) AS raw_rows, (SELECT count(*) FROM uniq) AS unique_rows, (SELECT count(*) FROM rws WHERE NOT ok) AS invalid_rows, (SELECT count(*) FROM uniq WHERE parent IS NOT NULL OR t % 7 = 6) AS replies, count(*) AS media_count,
 count(*) FILTER (WHERE audit = 'PASS') AS pass_count, count(*) FILTER (WHERE audit = 'PARTIAL') AS partial_count, sum(wrong)::BIGINT AS mismatches,
 CASE WHEN sum(wrong) > 0 THEN 'FAIL' WHEN count(*) > 0 AND bool_and(audit = 'PASS') AND (SELECT count(*) FROM rws WHERE NOT ok) = 0 THEN 'PASS' ELSE 'WARNING' END AS quality_gate FROM fin""")
def quality_gate(spark, d):
    m = run.ingest_run(ingest.checked(captures.captures(spark, d))).manifest
    return m.select(
        F.col("raw_captured_count").alias("raw_rows"), F.col("internal_raw_unique_count").alias("unique_rows"), F.col("invalid_row_count").alias("invalid_rows"), F.col("reply_count").alias("replies"), "media_count",
        F.col("pass_media_count").alias("pass_count"), F.col("partial_media_count").alias("partial_count"), F.col("shortcode_mismatch_count").alias("mismatches"), "quality_gate",
    )


# ---- addresses --------------------------------------------------------------------------------

MEDIA_URLS = """WITH urls AS (SELECT page_id, url AS page_url, CASE page_id % 4
  WHEN 0 THEN 'https://instagram.com/own.er/p/C' || (page_id // 8) || '/?utm=1'
  WHEN 1 THEN 'https://www.instagram.com/reels/R' || (page_id // 8) || '/'
  WHEN 2 THEN 'http://www.instagram.com/p/C' || page_id || '/' ELSE url END AS url FROM pages),
media AS (SELECT *, regexp_extract(url, '^https://(?:www\\.)?instagram\\.com/(?:([A-Za-z0-9._]+)/)?(p|reels?)/([A-Za-z0-9_-]+)(?:/|$)', 3) AS code,
  CASE WHEN regexp_extract(url, '^https://(?:www\\.)?instagram\\.com/(?:([A-Za-z0-9._]+)/)?(p|reels?)/', 2) = 'p' THEN 'p' ELSE 'reel' END AS kind FROM urls)
"""


def _media_urls(spark, d) -> DataFrame:
    p, eighth = _t(spark, d, "pages"), F.floor(F.col("page_id") / 8).cast("string")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://instagram.com/own.er/p/C"), eighth, F.lit("/?utm=1"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://www.instagram.com/reels/R"), eighth, F.lit("/")))
    url = url.when(F.col("page_id") % 4 == 2, F.concat(F.lit("http://www.instagram.com/p/C"), F.col("page_id").cast("string"), F.lit("/"))).otherwise(F.col("url"))
    return p.select("page_id", F.col("url").alias("page_url"), url.alias("url"))


@query(MEDIA_URLS + "SELECT kind AS media_type, code AS shortcode, 'https://www.instagram.com/' || kind || '/' || code || '/' AS media_url, count(*) AS n FROM media WHERE code <> '' GROUP BY ALL")
def media_identity_canonical(spark, d):
    m = _media_urls(spark, d).select(identity.canonical_media(F.col("url")).alias("m")).where("m IS NOT NULL")
    return m.groupBy(F.col("m.media_type").alias("media_type"), F.col("m.media_id").alias("shortcode"), F.col("m.media_url").alias("media_url")).agg(F.count("*").alias("n"))


@query(MEDIA_URLS + """, each AS (SELECT code, page_id AS ord, kind, lower(split_part(page_url, '/', 3)) AS q FROM media WHERE code <> ''),
qs AS (SELECT code, q, min(ord) AS ord FROM each GROUP BY 1, 2)
SELECT code AS shortcode, min(qs.ord) AS ord, string_agg(q, '|' ORDER BY qs.ord) AS queries, (SELECT arg_min(kind, e.ord) FROM each e WHERE e.code = qs.code) AS media_type FROM qs GROUP BY code""")
def candidate_dedupe_provenance(spark, d):
    rows = _media_urls(spark, d).select(F.col("page_id").alias("ord"), "url", F.lower(F.split("page_url", "/")[2]).alias("source_query"), F.lit(None).cast("array<string>").alias("matched_queries"), F.lit(None).cast("array<string>").alias("matched_asins"))
    return merge.dedupe_candidates(rows).select("shortcode", "ord", F.array_join("matched_queries", "|").alias("queries"), "media_type")


@query(MEDIA_URLS + """SELECT CASE WHEN code <> '' THEN 'ok' WHEN NOT starts_with(url, 'https://') THEN 'scheme' WHEN NOT regexp_matches(url, '^https://(?:www\\.)?instagram\\.com(?:/|$)') THEN 'host' ELSE 'path' END AS reason, count(*) AS n FROM media GROUP BY 1""")
def url_reject_reasons(spark, d):
    url = F.col("url")
    host = F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(identity.HOSTS)
    reason = F.when(identity.canonical_media(url).isNotNull(), "ok").when(F.try_parse_url(url, F.lit("PROTOCOL")) != "https", "scheme").when(~host, "host").otherwise("path")
    return _media_urls(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_param, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref_param,
  'https://www.instagram.com/p/C' || page_id || '/' AS unwrapped, page_id::VARCHAR AS comment_id FROM pages""")
def redirect_param_extract(spark, d):
    target = F.concat(F.lit("https://www.instagram.com/p/C"), F.col("page_id").cast("string"), F.lit("/"))
    wrapped = F.concat(F.lit("https://search.example.com/url?sa=t&q="), F.url_encode(target))
    comment = F.concat(target, F.lit("c/"), F.col("page_id").cast("string"), F.lit("/"))
    param = lambda k: F.nullif(F.try_parse_url("url", F.lit("QUERY"), F.lit(k)), F.lit(""))
    return _t(spark, d, "pages").select("page_id", param("page").alias("page_param"), param("ref").alias("ref_param"), identity.unwrap_redirect(wrapped).alias("unwrapped"), identity.comment_id(comment).alias("comment_id"))


# ---- relevance --------------------------------------------------------------------------------

PROFILES = [
    {"asin": "A", "brand": "Licensed", "product_name": "Apache License", "category": "trash", "core_functions": ["thin"], "pain_points": ["worthless"], "use_scenarios": ["moron"], "competitors": ["disgusting"], "product_aliases": [], "ingredients": [], "keywords": []},
    {"asin": "B", "brand": "clown", "product_name": "than", "category": "stupid", "core_functions": [], "pain_points": ["idiot", "loser"], "use_scenarios": ["pathetic"], "competitors": ["token"], "product_aliases": [], "ingredients": [], "keywords": []},
    {"asin": "C", "brand": "that", "product_name": "oui", "category": "scum", "core_functions": ["hate"], "pain_points": ["trash"], "use_scenarios": ["from"], "competitors": ["clown"], "product_aliases": ["read more terms"], "ingredients": [], "keywords": []},
]
PROFILE_SCHEMA = "profile_ord int, asin string, brand string, product_name string, category string, core_functions array<string>, pain_points array<string>, use_scenarios array<string>, competitors array<string>, product_aliases array<string>, ingredients array<string>, keywords array<string>"


def _profiles(spark, n: int = len(PROFILES)) -> DataFrame:
    names = [c.split(" ")[0] for c in PROFILE_SCHEMA.split(", ")][1:]
    return spark.createDataFrame([(k, *(p[c] for c in names)) for k, p in enumerate(PROFILES[:n])], PROFILE_SCHEMA)


def _has_sql(terms: list[str]) -> str:
    tests = []
    for t in terms:
        short = "".join(c for c in t.lower() if c.isascii() and c.isalnum())
        plain = f"contains(low, '{t.lower()}')"
        tests.append(f"({plain} OR contains(packed, '{short}'))" if len(short) >= 6 else plain)
    return "(" + " OR ".join(tests or ["false"]) + ")"


def _score_sql(p: dict, n: int) -> str:
    aliases = [a for a in [p["product_name"], *p["product_aliases"]] if len(a.split()) >= 2 or len(a) >= 6]
    category = [p["category"], *p["core_functions"]]
    category += [c[:-1] for c in category if c.endswith("s")]
    g = {"e": [p["brand"], *aliases], "c": category, "p": p["pain_points"], "u": p["use_scenarios"], "k": p["competitors"], "b": [p["brand"]], "a": aliases}
    return ", ".join(f"{_has_sql(v)} AS {k}{n}" for k, v in g.items())


def _ladder_sql(n: int) -> tuple[str, str]:
    w = {"e": 0.35, "c": 0.2, "p": 0.15, "u": 0.12, "k": 0.35}
    s = "least(1::DOUBLE, " + " + ".join(f"CASE WHEN {k}{n} THEN {v}::DOUBLE ELSE 0::DOUBLE END" for k, v in w.items()) + ")"
    m = " + ".join(f"{k}{n}::INT" for k in w)
    tier = f"CASE WHEN a{n} THEN 'HIGH' WHEN b{n} AND c{n} AND {m} >= 2 THEN 'HIGH' WHEN {m} >= 2 AND {s} >= 0.5::DOUBLE AND (e{n} OR k{n}) THEN 'MEDIUM' ELSE 'LOW' END"
    score = f"CASE WHEN a{n} THEN greatest({s}, 0.85::DOUBLE) WHEN b{n} AND c{n} AND {m} >= 2 THEN greatest({s}, 0.7::DOUBLE) WHEN {m} >= 2 AND {s} >= 0.5::DOUBLE AND (e{n} OR k{n}) THEN {s} ELSE least({s}, 0.49::DOUBLE) END"
    return tier, score


_DOC_TEXT = "SELECT doc_id, n_chars, lower(text) AS low, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS packed FROM documents"


def _evidence_documents(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    lists = F.lit(None).cast("array<string>")
    evidence = relevance.rendered_evidence(F.col("text"), lists, none, lists, none, none, lists)
    return _t(spark, d, "documents").withColumn("evidence", evidence)


@query(f"WITH t AS ({_DOC_TEXT}), h AS (SELECT *, {_score_sql(PROFILES[0], 0)} FROM t) SELECT doc_id, {_ladder_sql(0)[0]} AS tier, round({_ladder_sql(0)[1]}, 3) AS score FROM h")
def relevance_tiers(spark, d):
    return relevance.score_media(_evidence_documents(spark, d), _profiles(spark, 1)).select("doc_id", F.col("relevance_tier").alias("tier"), F.col("relevance_score").alias("score"))


_ARGMAX = f"WITH t AS ({_DOC_TEXT}), h AS (SELECT *, {', '.join(_score_sql(p, k) for k, p in enumerate(PROFILES))} FROM t), s AS (SELECT doc_id, {', '.join(f'{_ladder_sql(k)[0]} AS t{k}, {_ladder_sql(k)[1]} AS s{k}' for k in range(3))} FROM h)"
# the best score so far is kept rounded, so a later one above that rounding replaces it
_ARGMAX += ", f AS (SELECT *, s1 > round(s0, 3) AS w1 FROM s), g AS (SELECT *, s2 > round(CASE WHEN w1 THEN s1 ELSE s0 END, 3) AS w2 FROM f)"
_BEST = "CASE WHEN w2 THEN {0}2 WHEN w1 THEN {0}1 ELSE {0}0 END"


@query(f"{_ARGMAX} SELECT {_BEST.format('t')} AS tier, round({_BEST.format('s')}, 3) AS score, count(*) AS n FROM g GROUP BY 1, 2")
def relevance_argmax(spark, d):
    s = relevance.score_media(_evidence_documents(spark, d), _profiles(spark))
    return s.groupBy(F.col("relevance_tier").alias("tier"), F.col("relevance_score").alias("score")).agg(F.count("*").alias("n"))


@query(f"{_ARGMAX} SELECT CASE WHEN {_BEST.format('t')} IN ('HIGH', 'MEDIUM') THEN 'COLLECT' ELSE 'AUDIT_ONLY' END AS decision, doc_id FROM g ORDER BY CASE {_BEST.format('t')} WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, round({_BEST.format('s')}, 3) DESC, doc_id LIMIT 30")
def topk_candidates(spark, d):
    s = relevance.gated(relevance.score_media(_evidence_documents(spark, d), _profiles(spark))).withColumn("ord", F.col("doc_id"))
    return relevance.ranked(s).limit(30).select("decision", "doc_id")  # a report of the best, whatever their decision


_DIRECT, _MEDIUM = ["license", "apache license"], ["than", "for", "trash", "with"]


@query(f"""WITH t AS (SELECT doc_id, lower(text) AS low FROM documents),
c AS (SELECT doc_id, {' + '.join(f"contains(low, '{x}')::INT" for x in _DIRECT)} AS dn, {' + '.join(f"contains(low, '{x}')::INT" for x in _MEDIUM)} AS mn FROM t)
SELECT doc_id, CASE WHEN dn > 0 THEN 'HIGH' WHEN mn > 0 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
  round(CASE WHEN dn > 0 THEN least(1::DOUBLE, 0.72::DOUBLE + 0.06::DOUBLE * dn) WHEN mn > 0 THEN least(0.79::DOUBLE, 0.46::DOUBLE + 0.08::DOUBLE * mn) ELSE 0::DOUBLE END, 3) AS score FROM c""")
def comment_semantics(spark, d):
    return relevance.labelled(_t(spark, d, "documents"), "text", _DIRECT, _MEDIUM, "x").select("doc_id", "x.tier", "x.score")


@query(f"WITH t AS ({_DOC_TEXT}) SELECT contains(low, 'apache-license') AS plain, contains(packed, 'apachelicense') AS compacted, count(*) AS n FROM t GROUP BY 1, 2")
def term_sources(spark, d):
    e = F.create_map(F.lit("caption"), F.col("text"))
    sources = text.term_sources(F.lit("apache-license"), e)
    plain = F.contains(F.lower("text"), F.lit("apache-license"))
    return _t(spark, d, "documents").groupBy(plain.alias("plain"), F.array_contains(sources, "caption").alias("compacted")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN ' cats' WHEN 1 THEN ' cat dog' WHEN 2 THEN ' toy' WHEN 3 THEN ' toy bowl' ELSE '' END) AS x FROM documents)
SELECT regexp_matches(x, '\\b(?:cat|cats|feline|horse|equine|human|men|women)\\b') AND NOT regexp_matches(x, '\\b(?:dog|dogs|puppy|puppies|pup|pups|canine)\\b') AS species,
 regexp_matches(x, '\\b(?:toy|treats?|dispenser|shelter|rescue)\\b') AND NOT regexp_matches(x, '\\b(?:slow\\s*feed|feeder|bowl|eating|mealtime)\\b') AS product, count(*) AS n FROM t GROUP BY 1, 2""")
def species_conflict(spark, d):
    tail = F.element_at(F.array(F.lit(" cats"), F.lit(" cat dog"), F.lit(" toy"), F.lit(" toy bowl"), F.lit("")), (F.col("doc_id") % 5 + 1).cast("int"))
    x = F.concat("text", tail)
    species, product = x.rlike(relevance.OTHER_SPECIES) & ~x.rlike(relevance.DOGS), x.rlike(relevance.OTHER_PRODUCTS) & ~x.rlike(relevance.FEEDING)
    return _t(spark, d, "documents").groupBy(species.alias("species"), product.alias("product")).agg(F.count("*").alias("n"))


# ---- text rules -------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9][A-Za-z0-9+.-]*'), lambda x: len(x) > 2 AND NOT list_contains({_q(text.STOP_WORDS)}, x)) AS ws FROM documents)
SELECT doc_id, len(ws) AS n_words, len(list_distinct(ws)) AS n_distinct, ws[1] AS first_word FROM w""")
def word_tokens(spark, d):
    w = _t(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("ws"))
    return w.select("doc_id", F.size("ws").alias("n_words"), F.size(F.array_distinct("ws")).alias("n_distinct"), F.try_element_at("ws", F.lit(1)).alias("first_word"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace('  ' || coalesce(text, '') || E' \t;. ', '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ,;|-.')) AS cleaned_md5 FROM documents""")
def clean_text(spark, d):
    cleaned = text.clean_text(F.concat(F.lit("  "), F.coalesce("text", F.lit("")), F.lit(" \t;. ")))
    return _t(spark, d, "documents").select("doc_id", F.md5(cleaned.cast("binary")).alias("cleaned_md5"))


#: Rendered counts by doc_id: with commas, in ten thousands, thousands and millions, with words around, and none.
@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 10000 WHEN 2 THEN n_chars * 1000 + 500 WHEN 3 THEN n_chars WHEN 4 THEN n_chars * 1000000 WHEN 5 THEN NULL ELSE n_chars * 10000 + 2500 END AS count_value FROM documents""")
def compact_counts(spark, d):
    n, k = F.col("n_chars").cast("string"), F.col("doc_id") % 7
    label = F.when(k == 0, F.concat(F.format_number("n_chars", 0), F.lit(" comments"))).when(k == 1, F.concat(F.lit("评论 "), n, F.lit("万"))).when(k == 2, F.concat(n, F.lit(".5k comments")))
    label = label.when(k == 3, F.concat(F.lit("View all\u00a0"), n, F.lit("\u00a0comments"))).when(k == 4, F.concat(n, F.lit("M"))).when(k == 5, F.lit("none")).otherwise(F.concat(n, F.lit(".25万条评论")))
    return _t(spark, d, "documents").select("doc_id", text.visible_count(label).alias("count_value"))


_NOTES = ["Please confirm you're human", "Too many requests today", "This account is private", "Sorry, this page isn't available.", "Log in to Instagram to continue", "操作过于频繁", "all is well"]


@query("WITH t AS (SELECT text AS x FROM documents UNION ALL SELECT unnest(" + _q(_NOTES) + ")) SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(x), '{p}') THEN '{n}'" for n, p in text.RESTRICTIONS) + " ELSE 'ready' END AS restriction, count(*) AS n FROM t GROUP BY 1")
def restriction_classify(spark, d):
    notes = spark.createDataFrame([(x,) for x in _NOTES], "x string")
    return _t(spark, d, "documents").select(F.col("text").alias("x")).unionAll(notes).groupBy(text.restriction(F.col("x")).alias("restriction")).agg(F.count("*").alias("n"))


# ---- profiles and query plans -----------------------------------------------------------------


def _products(spark, d) -> DataFrame:
    p = _t(spark, d, "part")
    empty = F.lit(None).cast("array<string>")
    return p.select(
        F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("asin"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("product_title"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("brand"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).otherwise("A+ Content").alias("category"), F.lit(None).cast("string").alias("product_type"), F.lit(None).cast("string").alias("product_name"),
        *(empty.alias(c) for c in ("bullets", "functions", "use_scenarios", "pain_points", "ingredients", "aliases", "competitors")), F.lit(None).cast("string").alias("source_status"), F.lit(None).cast("string").alias("source_url"), F.col("p_partkey").alias("profile_ord"),
    )


def _part_profiles(spark, d) -> DataFrame:
    p = _products(spark, d)
    return profiles.build_profiles(p).join(p.select("asin", "profile_ord"), "asin")


PARTS = r"""WITH prof AS (SELECT 'P' || lpad(p_partkey::VARCHAR, 9, '0') AS asin, p_partkey AS ord,
  CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE regexp_extract(p_name, '^\s*(\S+)', 1) END AS brand, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS category,
  trim(regexp_replace(p_name, '(?:\s+[–—-]\s+|,).*$', '')) AS name FROM part)
"""


@query(PARTS + "SELECT asin, brand, category, name AS product_name, 'available' AS source_status, 'https://www.amazon.com/dp/' || asin AS source_url FROM prof")
def profile_categories(spark, d):
    return profiles.build_profiles(_products(spark, d)).select("asin", "brand", "category", "product_name", "source_status", "source_url")


def _held(values: list[str], by_word: bool = True) -> str:
    """SQL: which of the phrases the corpus holds, as a whole or word by word."""
    every = " OR len(list_filter(string_split(p, ' '), lambda w: NOT contains(corpus, w))) = 0" if by_word else ""
    return f"list_filter({_q(values)}, lambda p: contains(corpus, lower(p)){every})"


#: SQL: a list without the values that equal an earlier one in lower case.
_ONCE = "list_filter({0}, lambda x, i: x IS NOT NULL AND x <> '' AND list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"


@query(f"""WITH t AS (SELECT 'P' || lpad(p_partkey::VARCHAR, 9, '0') AS asin, p_partkey AS k, p_brand AS brand, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS category,
 p_name || CASE p_partkey % 6 WHEN 0 THEN ' with glucosamine and MSM' WHEN 1 THEN ' Fun Feeder Slo Bowl' WHEN 2 THEN ' non-slip feeding' WHEN 3 THEN ' Senior dog mobility joint' WHEN 4 THEN ' clean to easy' ELSE '' END AS title,
 CASE p_partkey % 4 WHEN 0 THEN ['Longer mealtime', 'eating too fast'] WHEN 1 THEN ['Omega 3 oil', 'BPA-Free'] ELSE [] END AS bullets FROM part),
c AS (SELECT *, lower(title || CASE WHEN len(bullets) > 0 THEN ' ' || array_to_string(bullets, ' ') ELSE '' END) AS corpus FROM t),
own AS (SELECT *, CASE WHEN regexp_matches(corpus, '(slow|slo|puzzle)\\s+(feeder|feeding|bowl)') THEN 'slow feeder dog bowl' WHEN contains(corpus, 'dog bowl') THEN 'dog bowl' WHEN contains(corpus, 'joint') AND (contains(corpus, 'dog') OR contains(corpus, 'pet')) THEN 'dog joint supplement' END AS derived,
 list_filter(regexp_extract_all(title, '[A-Za-z0-9+.-]+'), lambda w: length(w) >= 5 AND NOT list_contains({_q(profiles.GENERIC)}, lower(w)) AND NOT list_contains(list_filter(regexp_extract_all(lower(brand), '[A-Za-z0-9][A-Za-z0-9+.-]*'), lambda b: length(b) > 2), lower(w))) AS names,
 list_filter(regexp_extract_all(lower(title), '[A-Za-z0-9][A-Za-z0-9+.-]*'), lambda w: length(w) > 2 AND NOT list_contains({_q(text.STOP_WORDS)}, w)) AS tokens FROM c),
f AS (SELECT *, list_concat(CASE WHEN k % 5 = 0 THEN ['joint health', 'Own use'] ELSE [] END, {_held(profiles.FUNCTIONS)}) AS functions, list_concat(CASE WHEN k % 3 = 0 THEN ['Daily USE'] ELSE [] END, {_held(profiles.SCENARIOS)}) AS scenarios,
 {_held(profiles.PAINS)} AS pains, {_held(profiles.INGREDIENTS, False)} AS ingredients, list_concat(list_concat(CASE WHEN k % 7 = 0 THEN ['Known Name', 'known name'] ELSE [] END, {_held(profiles.PHRASES, False)}), names) AS named FROM own),
o AS (SELECT *, {_ONCE.format('functions')} AS fs, {_ONCE.format('scenarios')} AS ss, {_ONCE.format('named')} AS aliases FROM f),
w AS (SELECT *, list_concat(list_concat(list_concat([brand, title, coalesce(category, derived)], fs), ss), list_concat(list_concat(pains, ingredients), tokens[1:10])) AS every FROM o)
SELECT asin, array_to_string(fs, '|') AS functions, array_to_string(ss, '|') AS scenarios, array_to_string(pains, '|') AS pains, array_to_string(ingredients, '|') AS ingredients, array_to_string(aliases[1:5], '|') AS aliases, array_to_string({_ONCE.format('every')}, '|') AS keywords FROM w""")
def profile_terms(spark, d):
    """The lists of a profile: what products say of themselves, then what the dictionaries find in title and bullets."""
    k, none = F.col("p_partkey"), F.lit(None).cast("array<string>")
    words = lambda *values: F.array(*(F.lit(v) for v in values))
    more = {0: " with glucosamine and MSM", 1: " Fun Feeder Slo Bowl", 2: " non-slip feeding", 3: " Senior dog mobility joint", 4: " clean to easy"}
    title = F.col("p_name")
    for rest, said in more.items():
        title = F.when(k % 6 == rest, F.concat("p_name", F.lit(said))).otherwise(title)
    p = _t(spark, d, "part").select(
        F.concat(F.lit("P"), F.lpad(k.cast("string"), 9, "0")).alias("asin"), F.lit("").alias("title"), title.alias("product_title"), F.col("p_brand").alias("brand"), F.when(k % 5 != 0, F.col("p_type")).alias("category"),
        F.lit(None).cast("string").alias("product_type"), title.alias("product_name"), F.when(k % 4 == 0, words("Longer  mealtime.", " eating too fast")).alias("bullets"), F.when(k % 4 == 1, words("Omega 3 oil", "", "BPA-Free;")).alias("core_attributes"),
        F.when(k % 5 == 0, words("joint health", "Own use")).alias("functions"), F.when(k % 3 == 0, words("Daily USE")).alias("use_cases"), F.when(k % 7 == 0, words("Known Name", "known name")).alias("common_names"), none.alias("aliases"),
        F.lit(None).cast("string").alias("source_status"), F.lit(None).cast("string").alias("source_url"),
    )
    listed = {"functions": "core_functions", "scenarios": "use_scenarios", "pains": "pain_points", "ingredients": "ingredients", "aliases": "product_aliases", "keywords": "keywords"}
    return profiles.build_profiles(p).select("asin", *(F.array_join(c, "|").alias(n) for n, c in listed.items()))


SEEDS = PARTS + r""", plan AS (
SELECT asin, ord, 0 AS slot, 'product_entity' AS family, 100 AS priority, CASE WHEN NOT contains(lower(name), lower(brand)) THEN brand || ' ' || name ELSE name END AS q FROM prof
UNION ALL SELECT asin, ord, 1, 'decision_intent', 95, name || ' review' FROM prof
UNION ALL SELECT asin, ord, 2, 'brand_category', 90, brand || ' ' || coalesce(category, name) FROM prof
UNION ALL SELECT asin, ord, 3, 'category_solution', 85, coalesce(category, 'product') || ' product review' FROM prof
UNION ALL SELECT asin, ord, 4, 'problem_pain', 82, 'problem solution ' || coalesce(category, 'product') FROM prof
UNION ALL SELECT asin, ord, 5, 'use_scenario', 78, 'daily use product review' FROM prof
UNION ALL SELECT asin, ord, 6, 'category_review', 76, coalesce(category, 'product') || ' review' FROM prof),
seed AS (SELECT DISTINCT ON (lower(q)) asin, trim(regexp_replace(q, '\s+', ' ', 'g')) AS query, family AS query_family, priority FROM plan ORDER BY lower(q), priority DESC, ord, slot)
"""


@query(SEEDS + "SELECT asin, query, query_family, priority FROM seed")
def query_plan_seed(spark, d):
    return profiles.seed_queries(_part_profiles(spark, d)).select("asin", "query", "query_family", "priority")


@query(PARTS.replace("WITH prof", "WITH all_prof") + r""", prof AS (SELECT *, CASE WHEN len(list_filter(regexp_extract_all(lower(name), '[a-z0-9][a-z0-9+.-]*'), lambda x: len(x) > 2)) >= 0 THEN name END AS alias FROM all_prof),
plan AS (SELECT asin, ord, 0 AS slot, 'decision_intent' AS family, 74 AS priority, alias || ' dog review' AS q FROM prof
UNION ALL SELECT asin, ord, 1, 'category_solution', 72, alias || ' product experience' FROM prof
UNION ALL SELECT asin, ord, 2, 'usage_context', 70, brand || ' ' || alias || ' daily use' FROM prof
UNION ALL SELECT asin, ord, 3, 'problem_pain', 68, alias || ' eating too fast' FROM prof),
known AS (SELECT lower(name || ' dog review') AS q FROM prof WHERE ord % 2 = 0)
SELECT DISTINCT ON (lower(q)) asin, q AS query, family AS query_family, priority FROM plan WHERE lower(q) NOT IN (SELECT q FROM known) ORDER BY lower(q), ord, slot""")
def query_plan_expansion(spark, d):
    p = _part_profiles(spark, d).withColumn("product_aliases", F.array().cast("array<string>"))
    known = p.where(F.col("profile_ord") % 2 == 0).select(F.concat("product_name", F.lit(" dog review")).alias("query"))
    return profiles.expansion_queries(p, known).select("asin", "query", "query_family", "priority")


@query("""WITH cand AS (SELECT doc_id, source, lang, CASE WHEN l.quality = 1 THEN 'COLLECT' ELSE 'AUDIT_ONLY' END AS decision FROM documents d LEFT JOIN labels l USING (doc_id)),
named AS (SELECT doc_id, decision, source AS q FROM cand UNION SELECT doc_id, decision, lang FROM cand),
asked AS (SELECT DISTINCT source AS q FROM documents UNION SELECT DISTINCT lang FROM documents UNION SELECT 'nothing'),
spent AS (SELECT q, CASE length(q) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS executed, CASE WHEN q LIKE '%7' THEN 77 END AS kept FROM asked)
SELECT a.q AS query, coalesce(executed, false) AS executed, coalesce(any_value(kept), CASE WHEN executed THEN count(DISTINCT n.doc_id) ELSE 0 END) AS posts_found,
 count(DISTINCT CASE WHEN n.decision = 'COLLECT' THEN n.doc_id END) AS qualified_posts FROM spent a LEFT JOIN named n USING (q) GROUP BY 1, executed""")
def query_stats(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels").select("doc_id", "quality")
    cand = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("shortcode"), F.col("source").alias("source_query"), F.array("lang").alias("matched_queries"), F.when(F.col("quality") == 1, "COLLECT").otherwise("AUDIT_ONLY").alias("decision"))
    asked = docs.select(F.col("source").alias("query")).union(docs.select("lang")).union(spark.createDataFrame([("nothing",)], "query string")).distinct()
    size = F.length("query") % 3
    asked = asked.withColumns({"executed": F.when(size == 0, True).when(size == 1, False), "posts_found": F.when(F.col("query").endswith("7"), 77).cast("long")})
    return profiles.query_stats(asked, cand).select("query", "executed", "posts_found", "qualified_posts")


@query("""WITH m AS (SELECT d.doc_id, lower(text) AS low FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
s AS (SELECT doc_id, unnest(['licensed under', 'worthless', 'trash']) AS term, low FROM m), h AS (SELECT term, min(doc_id) AS first_doc FROM s WHERE contains(low, term) GROUP BY term)
SELECT 'Anchor Bowl ' || term AS query, first_doc, 66 - (row_number() OVER (ORDER BY first_doc, CASE term WHEN 'licensed under' THEN 0 WHEN 'worthless' THEN 1 ELSE 2 END) - 1) AS priority FROM h ORDER BY first_doc LIMIT 4""")
def evidence_queries(spark, d):
    labels = _t(spark, d, "labels").where("quality = 1").select("doc_id")
    terms = F.array(F.lit("licensed under"), F.lit("worthless"), F.lit("trash"))
    media = _t(spark, d, "documents").join(labels, "doc_id", "left_semi").select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("shortcode"), F.lit(None).cast("string").alias("caption"), text.contains_terms(F.col("text"), terms).alias("evidence_terms"), F.lit(None).cast("array<string>").alias("hashtags"),
        F.lit(None).cast("array<string>").alias("matched_asins"), F.lit("HIGH").alias("relevance_tier"), F.lit(True).alias("deliverable_eligible"),
    )
    p = spark.createDataFrame([(0, "X", None, None, None, ["Anchor Bowl"], [])], "profile_ord int, asin string, brand string, product_name string, category string, product_aliases array<string>, core_functions array<string>")
    comments = spark.createDataFrame([], "ord long, media_id string, comment_id string, comment_relevance_tier string, comment_evidence_terms array<string>")
    q = profiles.evidence_queries(p, media, comments, spark.createDataFrame([], "query string"))
    return q.select("query", F.col("evidence_shortcodes")[0].cast("long").alias("first_doc"), "priority")


ASKED_BEFORE = ["Anchor Bowl DRY food", "worthless bowl anchor"]


@query(f"""WITH p(po, asin, anchor) AS (VALUES (0, 'X', 'Anchor Bowl'), (1, 'Y', 'Other Dish')),
pair AS (SELECT doc_id, lower(coalesce(text, '')) AS low, p.* FROM documents JOIN p ON CASE doc_id % 3 WHEN 0 THEN asin = 'X' WHEN 1 THEN asin = 'Y' ELSE true END WHERE doc_id % 5 < 4 AND doc_id % 7 <> 0),
terms AS (SELECT *, list_filter(['licensed under', 'worthless', 'trash'], lambda t: contains(low, t)) AS found, CASE doc_id % 4 WHEN 0 THEN ['wet food', 'dry food'] WHEN 1 THEN ['gobbles'] ELSE [] END AS said FROM pair),
sig AS (SELECT po, asin, anchor, doc_id, doc_id AS ord, 0 AS kind, 'rendered_caption' AS name, unnest(said) AS signal, generate_subscripts(said, 1) AS place, NULL AS cid FROM terms
 UNION ALL SELECT po, asin, anchor, doc_id, doc_id, 1, 'rendered_media', unnest(found), generate_subscripts(found, 1), NULL FROM terms
 UNION ALL SELECT po, asin, anchor, doc_id, doc_id, 2, 'rendered_hashtag', 'anchor fan' || doc_id % 3, 1, NULL FROM terms WHERE po = 0
 UNION ALL SELECT po, asin, anchor, doc_id, doc_id, 3, 'verified_comment', unnest(['chew marks ' || doc_id % 2, 'ok', 'bowl']), generate_subscripts([1, 2, 3], 1), 'c' || doc_id FROM terms WHERE doc_id % 6 IN (0, 1)),
q AS (SELECT *, anchor || ' ' || signal AS query FROM sig WHERE length(signal) >= 4 AND NOT contains(lower(anchor), signal) AND NOT contains(signal, lower(anchor))),
g AS (SELECT *, list_sort(list_filter(regexp_extract_all(lower(query), '[A-Za-z0-9][A-Za-z0-9+.-]*'), lambda w: length(w) > 2 AND NOT list_contains({_q(text.STOP_WORDS)}, w))) AS sign FROM q),
one AS (SELECT DISTINCT ON (sign) * FROM g ORDER BY sign, po, kind, ord, place),
new AS (SELECT * FROM one WHERE lower(query) NOT IN ('anchor bowl dry food', 'worthless bowl anchor') AND sign NOT IN (['anchor', 'bowl', 'dry', 'food'], ['anchor', 'bowl', 'worthless']))
SELECT query, asin, name AS evidence_kind, doc_id::VARCHAR AS shortcode, coalesce(cid, '') AS comment_id, 67 - row_number() OVER (ORDER BY po, kind, ord, place) AS priority FROM new ORDER BY po, kind, ord, place LIMIT 12""")
def evidence_signals(spark, d):
    """All four kinds of evidence for two products, with comments and with queries that were asked before."""
    k, none = F.col("doc_id"), F.lit(None).cast("array<string>")
    terms = F.array(F.lit("licensed under"), F.lit("worthless"), F.lit("trash"))
    media = _t(spark, d, "documents").select(
        k.alias("ord"), k.cast("string").alias("shortcode"), F.when(k % 4 == 0, "Dry food and WET food").when(k % 4 == 1, "Gobbles it").alias("caption"), text.contains_terms(F.col("text"), terms).alias("evidence_terms"),
        F.array(F.concat(F.lit("#anchor_fan"), (k % 3).cast("string")), F.lit("#unknown")).alias("hashtags"), F.when(k % 3 == 0, F.array(F.lit("X"))).when(k % 3 == 1, F.array(F.lit("Y"))).otherwise(none).alias("matched_asins"),
        F.when(k % 5 < 3, "HIGH").when(k % 5 == 3, "MEDIUM").otherwise("LOW").alias("relevance_tier"), (k % 7 != 0).alias("deliverable_eligible"),
    )
    said = _t(spark, d, "documents").select(
        k.alias("ord"), k.cast("string").alias("media_id"), F.concat(F.lit("c"), k.cast("string")).alias("comment_id"), F.when(k % 6 == 0, "HIGH").when(k % 6 == 1, "MEDIUM").otherwise("LOW").alias("comment_relevance_tier"),
        F.array(F.concat(F.lit("chew marks "), (k % 2).cast("string")), F.lit("ok"), F.lit("bowl")).alias("comment_evidence_terms"),
    )
    rows = [(0, "X", None, None, None, ["Anchor Bowl"], ["slow chew"]), (1, "Y", None, None, None, ["Other Dish"], [])]
    p = spark.createDataFrame(rows, "profile_ord int, asin string, brand string, product_name string, category string, product_aliases array<string>, core_functions array<string>")
    q = profiles.evidence_queries(p, media, said, spark.createDataFrame([(x,) for x in ASKED_BEFORE], "query string"), limit=12)
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    return q.select("query", "asin", "evidence_kind", first("evidence_shortcodes").alias("shortcode"), first("evidence_comment_ids").alias("comment_id"), F.col("priority").cast("long").alias("priority"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS shown, coalesce(source, '') AS src FROM documents),
v AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN src END AS caption, CASE WHEN doc_id % 4 <> 3 THEN shown ELSE '' END AS visible, regexp_extract(shown, '^\\S+(?: \\S+){0,5}') AS head, regexp_extract(shown, '\\S+(?: \\S+){0,7}$') AS foot FROM t),
n AS (SELECT *, list_filter([lower(head), foot, 'words that stand on no page at all', 'short'], lambda a: length(a) >= 20 AND contains(lower(visible), lower(a))) AS near FROM v),
l AS (SELECT *, list_reduce(list_prepend('', near), lambda b, a: CASE WHEN length(a) > length(b) THEN a ELSE b END) AS longest FROM n),
e AS (SELECT doc_id, coalesce(caption, '') AS caption, CASE WHEN doc_id % 2 = 0 THEN 'own.er ' || 'acc' || doc_id % 5 ELSE 'own.er' END AS account, CASE doc_id % 5 WHEN 0 THEN 'Reels' WHEN 1 THEN '' ELSE '#a #b' || doc_id % 5 END AS hashtags,
 CASE WHEN coalesce(caption, '') = '' AND visible <> '' AND len(near) > 0 THEN longest WHEN doc_id % 6 = 0 THEN 'alt ' || doc_id ELSE '' END AS image FROM l)
SELECT doc_id, nullif(caption, '') AS caption, account, CASE WHEN hashtags NOT IN ('', 'Reels') THEN hashtags END AS hashtags, md5(nullif(image, '')) AS alt_md5 FROM e""")
def rendered_parts(spark, d):
    """Every part of what a page shows: captions, accounts, tags, and the longest image text that the page repeats."""
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    shown = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    alts = F.array(F.lower(F.regexp_extract(shown, r"^\S+(?: \S+){0,5}", 0)), F.regexp_extract(shown, r"\S+(?: \S+){0,7}$", 0), F.lit("words that stand on no page at all"), F.lit("short"), none)
    tags = F.when(k % 5 == 0, F.array(F.lit("Reels"))).when(k % 5 > 1, F.array(F.lit("#a"), F.concat(F.lit("#b"), (k % 5).cast("string"))))
    accounts = F.when(k % 2 == 0, F.array(F.lit("own.er"), F.concat(F.lit("acc"), (k % 5).cast("string"))))
    e = relevance.rendered_evidence(F.when(k % 3 == 0, F.col("source")), accounts, F.lit("own.er"), tags, F.when(k % 6 == 0, F.concat(F.lit(" alt "), k.cast("string"))), F.when(k % 4 != 3, F.col("text")), alts)
    m = _t(spark, d, "documents").select("doc_id", e.alias("e"))
    return m.select("doc_id", F.col("e")["caption"].alias("caption"), F.col("e")["account"].alias("account"), F.col("e")["hashtags"].alias("hashtags"), F.md5(F.col("e")["alt_text"].cast("binary")).alias("alt_md5"))


# ---- audits -----------------------------------------------------------------------------------


def _candidates(spark, d) -> DataFrame:
    tier = F.when(F.col("n_chars") > 3000, "HIGH").when(F.col("n_chars") > 1000, "MEDIUM").otherwise("LOW")
    return _t(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("shortcode"), F.lit("p").alias("media_type"), F.lit(None).cast("string").alias("url"), tier.alias("relevance_tier"), (F.col("n_chars") / 10000.0).alias("relevance_score"), F.array().cast("array<string>").alias("evidence_terms"),
        F.when(tier == "LOW", F.lit(None).cast("string")).otherwise("COLLECT").alias("decision"), F.lit(None).cast("string").alias("stop_reason"), (tier != "LOW").alias("deliverable_eligible"),
    )


CANDIDATES = "WITH cand AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'HIGH' WHEN n_chars > 1000 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM documents)"


@query(CANDIDATES + """ SELECT CASE WHEN tier = 'LOW' THEN 'semantic_low_audit_only' ELSE 'target_posts_budget' END AS stop_reason, CASE WHEN tier = 'LOW' THEN 'AUDIT_ONLY' ELSE 'COLLECT' END AS collection_status, count(*) AS n
FROM cand WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1, 2""")
def uncollected_anti(spark, d):
    audits = _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("media_id"))
    return audit.synthetic_audits(_candidates(spark, d), audits).groupBy("stop_reason", "collection_status").agg(F.count("*").alias("n"))


@query(CANDIDATES + """ SELECT CASE WHEN l.doc_id IS NULL THEN tier WHEN l.quality = 1 THEN 'HIGH' END AS relevance_tier, CASE WHEN l.doc_id IS NULL THEN tier <> 'LOW' ELSE l.toxic = 0 END AS eligible, count(*) AS n
FROM cand LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2""")
def audit_review_overlay(spark, d):
    audits = _candidates(spark, d).select(F.col("shortcode").alias("media_id"), "relevance_tier", "deliverable_eligible")
    review = _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("shortcode"), F.array(F.lit("relevance_tier")).alias("present"), F.when(F.col("quality") == 1, "HIGH").alias("relevance_tier"), (F.col("toxic") == 0).alias("deliverable_eligible"))
    out = audit.reviewed(audits, review)
    return out.groupBy("relevance_tier", F.col("deliverable_eligible").alias("eligible")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, ts::DATE::VARCHAR AS day, CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'view' THEN 'max_rounds' WHEN 'click' THEN 'semantic_low_audit_only' ELSE 'other' END AS r FROM events)
SELECT user_id, day, CASE WHEN bool_or(r = 'rate_limited') THEN 'rate_limited' WHEN bool_or(r = 'max_rounds') THEN 'max_rounds' WHEN bool_or(r = 'semantic_low_audit_only') THEN 'semantic_low_audit_only' ELSE 'captures_exhausted' END AS stop_reason FROM s GROUP BY 1, 2""")
def stop_reason_priority(spark, d):
    reason = F.when(F.col("event_type") == "error", "rate_limited").when(F.col("event_type") == "view", "max_rounds").when(F.col("event_type") == "click", "semantic_low_audit_only").otherwise("other")
    seen = _t(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.collect_set(reason).alias("seen"))
    return seen.select("user_id", "day", audit.stop_reason(F.col("seen"), F.lit(0), 0, False).alias("stop_reason"))


@query("""WITH r AS (SELECT user_id % 50 AS run, count(*) AS rows_, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS err FROM events GROUP BY 1),
s AS (SELECT run, rows_, CASE WHEN err = 1 AND run % 2 = 0 THEN 'rate_limited' WHEN run % 3 = 0 THEN 'semantic_saturation' ELSE 'captures_exhausted' END AS stop FROM r)
SELECT run, CASE stop WHEN 'rate_limited' THEN 'STOPPED_RATE_LIMIT' WHEN 'semantic_saturation' THEN 'COMPLETED_SEMANTIC_SATURATION' ELSE 'COMPLETED_BATCH' END AS workflow,
 CASE WHEN rows_ >= 200 THEN 'SOFT_TARGET_MET' WHEN stop = 'semantic_saturation' THEN 'SEMANTIC_SATURATION' ELSE 'PARTIAL' END AS coverage FROM s""")
def coverage_status(spark, d):
    r = _t(spark, d, "events").groupBy((F.col("user_id") % 50).alias("run")).agg(F.count("*").alias("rows"), F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("err"))
    r = r.withColumn("stop", F.when((F.col("err") == 1) & (F.col("run") % 2 == 0), "rate_limited").when(F.col("run") % 3 == 0, "semantic_saturation").otherwise("captures_exhausted"))
    return r.select("run", audit.workflow_status(F.col("stop")).alias("workflow"), audit.coverage_status(F.col("rows") >= 200, True, F.col("stop")).alias("coverage"))


@query(THREADS + """, uniq AS (SELECT * FROM threads), elig AS (SELECT doc_id::VARCHAR AS media_id, max(toxic) = 0 AS ok FROM labels GROUP BY 1),
del AS (SELECT u.* FROM uniq u LEFT JOIN elig e USING (media_id) WHERE coalesce(e.ok, true)), m AS (SELECT media_id, count(*) AS n FROM uniq GROUP BY 1)
SELECT (SELECT count(*) + count(*) FILTER (WHERE conv_id % 3 = 0) FROM uniq) AS raw_rows, (SELECT count(*) FILTER (WHERE conv_id % 3 = 0) FROM uniq) AS duplicate_rows, 0 AS invalid_rows, (SELECT count(*) FROM uniq) AS internal_rows, (SELECT count(*) FROM del) AS delivered_rows,
 (SELECT count(*) FROM uniq) - (SELECT count(*) FROM del) AS excluded_rows, (SELECT count(*) FROM del WHERE parent_id IS NULL) AS main_rows, (SELECT count(*) FROM del WHERE parent_id IS NOT NULL) AS reply_rows, (SELECT count(*) FROM m) AS media_count,
 (SELECT count(*) FROM m WHERE n % 2 = 0) AS pass_count, 'captures_exhausted' AS stop_reason, CASE WHEN (SELECT bool_and(n % 2 = 0) FROM m) THEN 'PASS' ELSE 'WARNING' END AS gate""")
def manifest_rollup(spark, d):
    threads = _thread_rows(spark, d).withColumns({"amazon_asins": F.array().cast("array<string>"), "matched_query": F.lit(None).cast("string"), "matched_queries": F.array().cast("array<string>")})
    again = threads.where(F.col("ord") % 3 == 0).withColumn("ord", F.col("ord") + 1_000_000)  # captured twice
    rows = threads.unionByName(again)
    unique = ingest.dedupe(rows.where(ingest.is_valid_row()))
    listed = _t(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("media_id")).agg((F.max("toxic") == 0).alias("eligible"))
    zero = F.lit(0)
    audits = unique.groupBy("media_id").agg(F.count("*").alias("n")).select(
        "media_id", F.when(F.col("n") % 2 == 0, "PASS").otherwise("PARTIAL").alias("audit_status"), F.lit(None).cast("string").alias("relevance_tier"), F.lit(None).cast("string").alias("stop_reason"),
        zero.alias("shortcode_mismatch_count"), zero.alias("route_fallback_attempt_count"), zero.alias("route_fallback_success_count"),
    )
    m = audit.manifest(unique, ingest.delivered(unique, listed), audits, ingest.counters(rows))
    return m.select(
        F.col("raw_captured_count").alias("raw_rows"), F.col("technical_duplicate_count").alias("duplicate_rows"), F.col("invalid_row_count").alias("invalid_rows"),
        F.col("internal_raw_unique_count").alias("internal_rows"), F.col("final_collected_count").alias("delivered_rows"), F.col("deliverable_excluded_count").alias("excluded_rows"), F.col("main_comment_count").alias("main_rows"), F.col("reply_count").alias("reply_rows"),
        "media_count", F.col("pass_media_count").alias("pass_count"), "stop_reason", F.col("quality_gate").alias("gate"),
    )


@query(CANDIDATES + """ SELECT CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 1 THEN CASE WHEN tier = 'LOW' THEN 'semantic_low_audit_only' WHEN doc_id >= 500 THEN 'target_comments_reached' ELSE 'target_posts_budget' END END AS label, count(*) AS n FROM cand GROUP BY 1""")
def residual_label(spark, d):
    c = _candidates(spark, d).withColumn("id", F.col("shortcode").cast("long"))
    decision = F.when(F.col("id") % 3 != 0, F.lit("COLLECT"))
    status = F.when(F.col("id") % 4 == 1, "DISCOVERED").otherwise("COLLECTED")
    return c.groupBy(state.residual_label(decision, status, F.col("relevance_tier"), F.col("id"), 500).alias("label")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN lines = 0 THEN 'BLOCKED' WHEN returned = 0 THEN 'PASS' ELSE 'PARTIAL' END AS status FROM o)
SELECT o_custkey % 100 AS bucket, count(*) AS media_count, sum(lines)::BIGINT AS row_count, count(*) FILTER (WHERE status = 'PASS') AS pass_count, count(*) FILTER (WHERE status = 'PARTIAL') AS partial_count,
 CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'WARNING' END AS gate FROM s GROUP BY 1""")
def lineitem_capture_rollup(spark, d):
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").withColumns({"lines": F.coalesce("lines", F.lit(0)), "returned": F.coalesce("returned", F.lit(0))})
    barred = F.when(F.col("lines") == 0, "unavailable").otherwise("ready")
    o = o.withColumn("status", audit.audit_status(barred, F.lit("complete"), F.col("returned"), F.lit(None).cast("int"), F.col("lines")))
    g = o.groupBy((F.col("o_custkey") % 100).alias("bucket")).agg(F.count("*").alias("media_count"), F.sum("lines").alias("row_count"), F.count_if(F.col("status") == "PASS").alias("pass_count"), F.count_if(F.col("status") == "PARTIAL").alias("partial_count"))
    return g.withColumn("gate", audit.quality_gate(F.lit(0), F.col("media_count"), F.col("pass_count"), F.lit(0)))


# ---- state over event logs --------------------------------------------------------------------


def _events(spark, d) -> DataFrame:
    return _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS last_event, arg_max(value, (ts, event_id)) AS value, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY 1, 2")
def retry_last_wins(spark, d):
    m = merge.last_wins_first_place(_events(spark, d).select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"])
    return m.select("user_id", "event_type", F.col("event_id").alias("last_event"), "value", F.col("place.event_id").alias("first_event"))


@query("WITH f AS (SELECT user_id, event_type, min(date_trunc('day', ts)::DATE) AS day FROM events GROUP BY 1, 2) SELECT user_id, day::VARCHAR AS day, count(*) AS added FROM f GROUP BY 1, 2")
def first_wins_round(spark, d):
    e = _events(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    return state.new_keys_per_round(e, ["user_id"], "event_type", "day").select("user_id", "day", "added")


@query("""WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n, bool_or(event_type = 'error') AS err, count(*) AS total FROM events GROUP BY 1)
SELECT user_id, CASE WHEN user_id % 11 = 0 THEN true WHEN n = 0 THEN true WHEN user_id % 4 = 0 THEN false WHEN err THEN true ELSE n < least(total, 40) END AS retry FROM u""")
def retry_decision(spark, d):
    u = _events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n"), F.bool_or(F.col("event_type") == "error").alias("err"), F.count("*").alias("total"))
    retry = state.needs_retry(F.col("n"), F.when(F.col("err"), "PARTIAL").otherwise("PASS"), F.col("total"), F.lit(40), F.col("user_id") % 4 != 0, F.col("user_id") % 11 == 0)
    return u.select("user_id", retry.alias("retry"))


LIMITS = "WITH l AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM events)"


@query(LIMITS + " SELECT least(3, c)::INT AS level, count(*) AS n FROM l GROUP BY 1")
def rate_limit_levels(spark, d):
    e = state.levels(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return e.groupBy(F.col("level").cast("int").alias("level")).agg(F.count("*").alias("n"))


@query(LIMITS + """ SELECT event_id, strftime(ts + to_seconds(CASE WHEN c >= 3 THEN 43200 WHEN c = 2 THEN 14400 WHEN c = 1 THEN 3600 ELSE 0 END), '%Y-%m-%d %H:%M:%S') AS until FROM l WHERE event_type = 'error'""")
def cooldown_until(spark, d):
    e = state.levels(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").where("event_type = 'error'")
    return e.select("event_id", F.date_format(state.extended(F.col("ts"), F.col("ts"), F.col("rate_limit_count")), "yyyy-MM-dd HH:mm:ss").alias("until"))


@query("""WITH g AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS grew FROM events),
i AS (SELECT *, sum(grew) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
s AS (SELECT sum(1 - grew) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT streak::BIGINT AS streak, CASE WHEN streak >= 2 THEN 'semantic_saturation' ELSE 'ACTIVE' END AS status, count(*) AS n FROM s GROUP BY 1, 2""")
def no_growth_streaks(spark, d):
    s = state.streaks(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("purchase", "signup"))
    return s.groupBy("streak", state.saturation(F.col("streak")).alias("status")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) SELECT event_id, (n // 5)::INT AS batch, (n % 5)::INT AS place FROM r")
def batch_of_five(spark, d):
    return state.batches(_events(spark, d), ["user_id"], ["ts", "event_id"]).select("event_id", "batch", "place")


@query("""WITH g AS (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
SELECT event_id, greatest(0::DOUBLE, 3600::DOUBLE - coalesce(gap, 3600)) AS delay FROM g""")
def access_gap_delay(spark, d):
    return state.access_delay(_events(spark, d), ["user_id"], "ts", ["ts", "event_id"], 3600.0).select("event_id", "delay")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def bounded_history(spark, d):
    return state.history(_events(spark, d), ["user_id"], ["ts", "event_id"], keep=3).select("user_id", "event_id")


@query("""WITH r AS (SELECT user_id, row_number() OVER w AS round, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS comments, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS expands FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN comments >= 12 THEN 'target_comments' WHEN round >= 60 THEN 'max_rounds' WHEN expands >= 10 THEN 'max_expand_actions' END AS reason FROM r)
SELECT user_id, min(round) AS round, arg_min(reason, round) AS stop_reason FROM s WHERE reason IS NOT NULL GROUP BY 1""")
def stop_reason_first(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda kind: F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0)).over(w)
    r = _events(spark, d).select("user_id", F.count("*").over(w).alias("round"), n("view").alias("comments"), n("click").alias("expands"))
    reason = state.continuous_stop(F.col("comments"), F.col("round"), F.col("expands"), F.lit(0), F.lit(0), {"target_comments": 12, "max_rounds": 60, "max_expand_actions": 10})
    return state.first_stop(r, ["user_id"], "round", reason)


@query("""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, min(event_id) AS f FROM events GROUP BY 1)
SELECT user_id::VARCHAR AS job_id, CASE last WHEN 'view' THEN 'pending' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, CASE last WHEN 'click' THEN 0 ELSE 1 END AS queue FROM s""")
def job_latest_status(spark, d):
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "active").when(F.col("event_type") == "error", "failed").otherwise("completed")
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("job_id"), status.alias("status"), F.struct("ts", "event_id").alias("seq"))
    return state.jobs(e).select("job_id", "status", "queue")


@query("""WITH p AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT day, n, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT count(*) AS captures, sum(n)::BIGINT AS row_count FROM b WHERE before < 1000""")
def target_prefix_stop(spark, d):
    o = _t(spark, d, "orders").select(F.to_date("o_orderdate").alias("ord"), F.lit(0).alias("pos"), F.col("o_orderkey").cast("string").alias("comment_id"), F.lit("m").alias("media_id"), F.lit("a").alias("author"), F.lit("t").alias("comment_text"))
    kept = ingest.target_prefix(o, 1000)
    return kept.agg(F.count_distinct("ord").alias("captures"), F.count("*").alias("row_count"))


@query("""SELECT user_id, CASE WHEN errs >= 6 THEN 'small_batch' WHEN errs >= 3 THEN 'ramp' ELSE 'normal' END AS phase, CASE WHEN errs >= 6 THEN 1 WHEN errs >= 3 THEN 3 END AS queries, CASE WHEN errs >= 6 THEN 1 WHEN errs >= 3 THEN 5 END AS media,
CASE WHEN errs >= 6 THEN 'ramp' ELSE 'normal' END AS next_phase FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errs FROM events GROUP BY 1)""")
def recovery_phase(spark, d):
    u = _events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errs"))
    u = u.withColumn("phase", F.when(F.col("errs") >= 6, "small_batch").when(F.col("errs") >= 3, "ramp").otherwise("normal"))
    return u.select("user_id", "phase", state.recovery(F.col("phase")).alias("r"), state.next_phase(F.col("phase")).alias("next_phase")).select("user_id", "phase", "r.queries", "r.media", "next_phase")


# ---- incremental ingest -----------------------------------------------------------------------


@query("SELECT sha256(text) AS fingerprint, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1")
def capture_fingerprint(spark, d):
    return _t(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("""WITH done AS (SELECT DISTINCT sha256(text) AS f FROM documents WHERE doc_id % 2 = 0), new AS (SELECT sha256(text) AS f, min(doc_id) AS ord FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT f AS fingerprint, ord FROM new WHERE f NOT IN (SELECT f FROM done)""")
def incremental_skip(spark, d):
    f = _t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"))
    return ingest.unseen(f.where("ord % 2 = 1"), f.where("ord % 2 = 0")).select("fingerprint", "ord")


@query("""WITH RECURSIVE t AS (SELECT conv_id, min(turn) AS turn, 0 AS depth FROM conversations GROUP BY 1
UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
SELECT conv_id, max(depth) AS depth, count(*) AS n FROM t GROUP BY 1""")
def thread_tree(spark, d):
    turns = _t(spark, d, "conversations").select(F.col("conv_id").alias("tree"), F.col("turn").alias("node"), (F.col("turn") - 1).alias("parent"))
    first = turns.groupBy("tree").agg(F.min("node").alias("root"))
    trees = threads.reply_trees(turns).join(first, ["tree", "root"])
    return trees.groupBy(F.col("tree").alias("conv_id")).agg(F.max("depth").cast("int").alias("depth"), F.count("*").alias("n"))
