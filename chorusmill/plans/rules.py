"""Queries over rules that the other modules' queries do not reach: routes, merges, state tests, candidate lists, saved pages.

Every query reads whole tables; the inputs' states follow from row numbers, and the SQL derives the results from
those numbers by the rules' wording, without addresses or pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import audit, ingest, jobs, merge, relevance, run, state
from ..sources import captures as saved
from ..sources import cards, sinks
from .captures import CAPTURES, KEYED, captures
from .registry import query
from .registry import table as _t

ADDRESS = "https://www.instagram.com/"


def _address(kind, code, owner: str = "", tail: str = ""):
    return F.concat(F.lit(ADDRESS + owner), kind, F.lit("/"), code, F.lit("/" + tail))


def _word(name: str, number):
    return F.concat(F.lit(name), number.cast("string"))


# ---- routes and identities ----------------------------------------------------------------------

#: One row per document: the codes and kinds that each address of a visit holds, null where it holds none.
ROUTES = """WITH k AS (SELECT doc_id AS i, 'M' || (doc_id % 50) AS code, CASE WHEN doc_id % 2 = 0 THEN 'p' ELSE 'reel' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'reel' ELSE 'p' END AS turned FROM documents),
v AS (SELECT *, CASE i % 11 WHEN 4 THEN NULL ELSE code END AS f_id, CASE i % 11 WHEN 3 THEN turned WHEN 4 THEN NULL ELSE kind END AS f_kind,
  CASE i % 13 WHEN 5 THEN 'Z' WHEN 6 THEN NULL ELSE code END AS l_id, CASE i % 13 WHEN 6 THEN NULL ELSE kind END AS l_kind,
  CASE i % 7 WHEN 2 THEN NULL WHEN 3 THEN 'Y' ELSE code END AS c_id, CASE i % 7 WHEN 1 THEN turned WHEN 2 THEN NULL ELSE kind END AS c_kind,
  CASE i % 5 WHEN 0 THEN NULL ELSE code END AS o_id, CASE i % 5 WHEN 0 THEN NULL WHEN 1 THEN turned ELSE kind END AS o_kind,
  CASE i % 17 WHEN 0 THEN 'Q' WHEN 1 THEN NULL ELSE code END AS q_id FROM k)
"""


def _visits(spark, d) -> DataFrame:
    i = F.col("doc_id")
    code, even = _word("M", i % 50), i % 2 == 0
    kind, turned = F.when(even, "p").otherwise("reel"), F.when(even, "reels").otherwise("p")
    return _t(spark, d, "documents").select(
        i.alias("i"), _address(kind, code).alias("requested"),
        F.when(i % 11 == 3, _address(turned, code)).when(i % 11 != 4, _address(kind, code, tail="?x=1")).alias("final"),
        F.when(i % 13 == 5, _address(kind, F.lit("Z"))).when(i % 13 != 6, _address(kind, code, "own.er/")).alias("location"),
        F.when(i % 7 == 1, _address(turned, code)).when(i % 7 == 2, "https://example.com/p/X/").when(i % 7 == 3, _address(kind, F.lit("Y"))).otherwise(_address(kind, code)).alias("canonical"),
        F.when(i % 5 == 1, _address(turned, code)).when(i % 5 != 0, _address(kind, code)).alias("og"),
        F.when(i % 17 == 0, F.array(_address(F.lit("p"), F.lit("Q"), tail="c/1/"))).when(i % 17 != 1, F.array(_address(F.lit("p"), code, tail="c/1/"))).alias("comment_urls"),
        F.when(i % 19 == 0, "rate_limited").when(i % 19 != 1, "").alias("error"), F.when(i % 23 == 1, False).when(i % 23 != 0, True).alias("ready"),
        F.when(i % 29 == 0, "OTHER").when(i % 3 == 0, code).when(i % 3 == 1, "").alias("expected"),
    )


@query(ROUTES + """, w AS (SELECT *, coalesce(l_id, f_id) AS actual, coalesce(l_kind, f_kind) AS seen, coalesce(f_kind <> kind OR l_kind <> kind, true) AS route_wrong FROM v),
x AS (SELECT *, actual IS NULL OR actual <> code OR coalesce(c_id <> code, false) OR coalesce(o_id <> code, false) OR coalesce(q_id <> code, false) AS code_wrong FROM w)
SELECT i, coalesce(i % 23 > 1, false) AND i % 19 <> 0 AND NOT code_wrong AND NOT route_wrong AS ok, actual, seen, code_wrong, route_wrong,
 concat_ws(';', CASE WHEN c_kind <> seen THEN 'canonical_route_type' END, CASE WHEN o_kind <> seen THEN 'og:url_route_type' END) AS conflicts, CASE WHEN i % 19 = 0 THEN 'rate_limited' END AS error_state FROM x""")
def route_checks(spark, d):
    names = ("requested", "final", "location", "canonical", "og", "comment_urls", "error", "ready")
    e = F.col("e")
    return _visits(spark, d).select("i", identity.route_evidence(*(F.col(c) for c in names)).alias("e")).select(
        "i", e["ok"].alias("ok"), e["actual_shortcode"].alias("actual"), e["rendered_media_type"].alias("seen"), e["shortcode_mismatch"].alias("code_wrong"),
        e["route_mismatch"].alias("route_wrong"), F.array_join(e["evidence_conflicts"], ";").alias("conflicts"), e["error_state"].alias("error_state"),
    )


@query(ROUTES + """, e AS (SELECT *, CASE WHEN i % 29 = 0 THEN 'OTHER' WHEN i % 3 = 0 THEN code WHEN i % 3 = 1 THEN '' END AS expected, (c_id IS NOT NULL)::INT + (o_id IS NOT NULL)::INT + (q_id IS NOT NULL)::INT AS n FROM v),
x AS (SELECT *, (n > 0 AND (l_id IS NULL OR coalesce(c_id <> l_id, false) OR coalesce(o_id <> l_id, false) OR coalesce(q_id <> l_id, false))) OR coalesce(expected <> '' AND expected <> l_id, false) AS wrong FROM e)
SELECT i, NOT wrong AND n > 0 AS ok, wrong::INT AS mismatch_count, CASE WHEN wrong THEN 'MEDIA_ID_MISMATCH' WHEN n > 0 THEN 'verified' ELSE 'identity_evidence_not_ready' END AS reason,
 array_to_string(list_sort(list_distinct([l_id, c_id, o_id, q_id])), ',') AS observed, len(list_distinct([l_id, c_id, o_id])) = 1 AS agree FROM x""")
def identity_checks(spark, d):
    v, names = _visits(spark, d), ("location", "canonical", "og", "comment_urls", "expected")
    codes = F.array(*(identity.canonical_media(F.col(c))["media_id"] for c in ("location", "canonical", "og")))
    return v.select("i", identity.verify_identity(*(F.col(c) for c in names)).alias("e"), identity.all_agree(codes).alias("agree")).select(
        "i", "e.ok", "e.mismatch_count", "e.reason", F.array_join(F.array_sort("e.observed_shortcodes"), ",").alias("observed"), "agree"
    )


@query(ROUTES + f""" SELECT i, CASE WHEN f_id IS NOT NULL THEN '{ADDRESS}' || CASE f_kind WHEN 'p' THEN 'reel' ELSE 'p' END || '/' || f_id || '/' END AS alternate, l_id AS code,
 '/' || l_kind || '/' || l_id || '/' AS route, i % 4 = 0 OR i % 6 = 1 OR i % 9 = 3 AS payload FROM v""")
def route_keys(spark, d):
    i = F.col("i")
    payload = F.struct(
        F.when(i % 4 == 0, F.col("requested")).alias("url"), F.when(i % 6 == 1, "HTTPS://WWW.INSTAGRAM.COM/X").alias("requested_url"),
        F.when(i % 8 == 2, "https://example.com/?at=instagram.com").alias("discovery_url"), F.when(i % 9 == 3, "https://l.instagram.com/?u=1").otherwise("").alias("navigation_source_url"),
    )
    return _visits(spark, d).select(
        "i", identity.alternate_url(F.col("final")).alias("alternate"), identity.shortcode_in(F.col("location")).alias("code"),
        identity.media_path(F.col("location")).alias("route"), identity.is_media_payload(payload).alias("payload"),
    )


# ---- labels, rows and merges --------------------------------------------------------------------

#: Labels of controls and whether they open more comments or replies.
LABELS = [
    ("View more comments", True), ("Reply", False), ("view  all 12 replies", True), ("查看更多评论", True), ("comments", False),
    ("Load previous 4 more comments (9)", True), ("显示 3 条回复", True), ("Hide replies", False), ("", False),
]


@query(f"""WITH l AS (SELECT unnest({[v for _, v in LABELS]}) AS v, unnest(range({len(LABELS)})) AS n)
SELECT doc_id, a.v OR b.v AS expands, '{{"n":' || doc_id || ',"lang":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"x"' END || '}}' AS cell, CASE WHEN doc_id % 4 = 0 THEN '' ELSE doc_id::VARCHAR END AS plain
FROM documents JOIN l a ON a.n = doc_id % {len(LABELS)} JOIN l b ON b.n = (doc_id // {len(LABELS)}) % {len(LABELS)}""")
def control_cells(spark, d):
    i, labels, n = F.col("doc_id"), F.array(*(F.lit(v) for v, _ in LABELS)), len(LABELS)
    parts = F.array(labels[(i % n).cast("int")], labels[(F.floor(i / n) % n).cast("int")])
    cell = F.struct(i.alias("n"), F.when(i % 3 != 0, "x").alias("lang"))
    return _t(spark, d, "documents").select(
        i, text.is_expansion_control(parts).alias("expands"), text.csv_value(cell, nested=True).alias("cell"), text.csv_value(F.when(i % 4 != 0, i)).alias("plain")
    )


@query(CAPTURES + " SELECT c AS ord, error FROM cap WHERE error IS NOT NULL UNION ALL SELECT c, NULL FROM cap WHERE error IS NULL")
def capture_errors(spark, d):
    c = ingest.checked(captures(spark, d))
    return ingest.rejected(c).select("ord", "error").unionByName(ingest.strict(ingest.valid(c)).select("ord", "error"))


@query(CAPTURES + KEYED + """ SELECT CASE WHEN cid IS NULL THEN 'exact' ELSE 'id' END AS kind, coalesce(cid, 'M' || m) AS a, CASE WHEN cid IS NULL THEN author END AS b, CASE WHEN cid IS NULL THEN body END AS c, count(*) AS n
FROM rws GROUP BY 1, 2, 3, 4""")
def technical_keys(spark, d):
    rows = ingest.comment_rows(ingest.valid(ingest.checked(captures(spark, d))))
    return rows.groupBy(ingest.technical_key().alias("k")).agg(F.count("*").alias("n")).select("k.*", "n")


#: Comments of attempts: every conversation is an attempt of one of twenty media.
ATTEMPTS = """WITH a AS (SELECT 'M' || (conv_id % 20) AS code, conv_id AS attempt, turn AS pos, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN (conv_id % 20) || '-' || turn END AS cid,
 CASE WHEN turn % 4 = 2 THEN 'u' || (turn % 2) ELSE role END AS who, 'w' || (turn % 2) AS said FROM conversations)
"""


def _attempts(spark, d) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return _t(spark, d, "conversations").select(
        _word("M", c % 20).alias("shortcode"), c.alias("attempt"), t.alias("pos"), F.when(t % 3 == 0, "").when(t % 3 == 1, F.concat_ws("-", (c % 20).cast("string"), t.cast("string"))).alias("comment_id"),
        F.when(t % 4 == 2, "").otherwise(F.col("role")).alias("author"), _word("u", t % 2).alias("username"), _word("w", t % 2).alias("comment_text"),
    )


@query(ATTEMPTS + """, k AS (SELECT *, CASE WHEN coalesce(cid, '') <> '' THEN 'id:' || cid ELSE code || '|' || who || '|' || said END AS key FROM a)
SELECT code AS shortcode, comment_id, attempt, pos, first_attempt, first_pos FROM (SELECT code, cid AS comment_id, attempt, pos, row_number() OVER (PARTITION BY key ORDER BY attempt DESC, pos DESC) AS n,
 first_value(attempt) OVER (PARTITION BY key ORDER BY attempt, pos) AS first_attempt, first_value(pos) OVER (PARTITION BY key ORDER BY attempt, pos) AS first_pos FROM k) WHERE n = 1""")
def retry_rows(spark, d):
    r = merge.retry_merge(_attempts(spark, d))
    return r.select("shortcode", "comment_id", "attempt", "pos", F.col("place.attempt").alias("first_attempt"), F.col("place.pos").alias("first_pos"))


@query("""SELECT 'M' || (conv_id % 20) AS shortcode, count(*) AS attempt_count, max(CASE WHEN conv_id % 4 <> 0 THEN n END) AS platform, string_agg(conv_id || ':' || n, ',' ORDER BY conv_id) AS ledger
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) GROUP BY 1""")
def retry_ledgers(spark, d):
    c = F.col("conv_id")
    each = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    ledger = F.array(F.concat_ws(":", c.cast("string"), F.col("n").cast("string")))
    r = merge.retry_totals(each.select(_word("M", c % 20).alias("shortcode"), c.alias("attempt"), F.when(c % 4 != 0, F.col("n")).alias("platform_comment_count"), ledger.alias("ledger")))
    return r.select("shortcode", "attempt_count", F.col("platform_comment_count").alias("platform"), F.array_join("action_ledger", ",").alias("ledger"))


@query(ATTEMPTS + """, r AS (SELECT cid, attempt * 1000 + pos AS ord, attempt % 3 = 0 AS known FROM a WHERE coalesce(cid, '') <> '')
SELECT cid AS comment_id, coalesce(max(ord) FILTER (WHERE known), min(ord)) AS ord FROM r GROUP BY 1""")
def known_rows(spark, d):
    r = _attempts(spark, d).select("comment_id", "attempt", (F.col("attempt") * 1000 + F.col("pos")).alias("ord"))
    return merge.keep_known_by_id(r.where("attempt % 3 = 0"), r.where("attempt % 3 <> 0")).select("comment_id", "ord")


@query("""SELECT 'D' || (doc_id % 40) AS shortcode, min(doc_id) AS ord, sha256(arg_max(text, (length(text), -doc_id))) AS text_sha256, arg_min(n_chars, doc_id) AS first_chars
FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def link_contexts(spark, d):
    links = _t(spark, d, "documents").where("text IS NOT NULL").select(_word("D", F.col("doc_id") % 40).alias("shortcode"), F.col("doc_id").alias("ord"), "text", "n_chars")
    first = merge.first_wins(links.drop("text"), ["shortcode"], ["ord"]).select("shortcode", F.col("n_chars").alias("first_chars"))
    longest = merge.longest_context(links.drop("n_chars")).select("shortcode", "ord", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return longest.join(first, "shortcode")


# ---- state tests --------------------------------------------------------------------------------


@query("""SELECT event_id, i % 5 = 0 OR i % 10 >= i % 7 AS may_start, i % 4 > 0 AND (i % 5 = 0 OR i % 10 >= i % 7) AND i % 3 <> 1 AS preflight,
 i % 3 <> 0 AND i % 4 = 0 AND i % 5 = 0 AND i % 2 = 1 AND i % 7 = 0 AND i % 11 <> 1 AS idle, i % 3 <> 0 AND i % 11 <> 1 AND i % 7 = 0 AND (i % 13 = 0 OR (i % 4 > 0 AND i % 6 > 0 AND i % 9 > 0 AND i % 6 + 10 >= i % 9 * 4 - 8)) AS exhausted,
 list_contains([0, 3], i % 4) AND i % 5 IN (1, 2) AS done FROM (SELECT event_id, event_id AS i FROM events)""")
def state_tests(spark, d):
    i = F.col("event_id")
    at = lambda n: F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), n.cast("int"), F.lit(0), F.lit(0))
    now, until = at(i % 10), F.when(i % 5 != 0, at(i % 7))
    ready, loading, pending = i % 3 != 0, i % 11 == 1, i % 7
    first, second = F.when(i % 4 == 0, "a").when(i % 4 == 3, "b").otherwise("c"), F.when(i % 5 == 1, "d").when(i % 5 == 2, "e").otherwise("f")
    seen = F.array(F.lit("a"), F.lit("b"), F.lit("d"), F.lit("e"), F.lit("z"))
    return _t(spark, d, "events").select(
        i, state.may_start(now, until).alias("may_start"), state.needs_preflight(i % 4, until, now, F.when(i % 3 == 0, False).when(i % 3 == 1, True)).alias("preflight"),
        state.counts_idle(ready, i % 4, i % 5, i % 2 == 0, pending, loading).alias("idle"),
        state.visible_exhausted(ready, loading, pending, i % 13 == 0, i % 4, i % 6, F.lit(10), F.when(i % 6 > 0, i % 9 * 4).otherwise(0)).alias("exhausted"), state.priority_done(F.array(first, second), seen).alias("done"),
    )


@query("""SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS attempt FROM events""")
def attempt_numbers(spark, d):
    r = run.numbered(_t(spark, d, "events"), ["user_id"], "event_id")
    return r.select("user_id", "event_id", "event_type", F.col("attempt").cast("long").alias("attempt"))


@query("""WITH e AS (SELECT user_id, event_id, event_id % 4 = 0 AS open, (event_id * 7919) % 50 AS far FROM events WHERE event_id % 3 <> 0)
SELECT user_id, event_id AS index, far AS distance, open AS expanded FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY open DESC, far, event_id) AS n FROM e) WHERE n = 1""")
def nearest_controls(spark, d):
    i = F.col("event_id")
    items = _t(spark, d, "events").select("user_id", i.alias("index"), (i * 7919 % 50).alias("distance"), (i % 4 == 0).alias("expanded"), (i % 3 != 0).alias("in_viewport"))
    return run.nearest(items, ["user_id"]).select("user_id", "index", "distance", "expanded")


@query("""WITH j AS (SELECT user_id, arg_max(event_type, event_id) AS last, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events GROUP BY 1)
SELECT user_id::VARCHAR AS job_id, CASE WHEN last = 'click' THEN 0 ELSE 1 END AS queue FROM j WHERE last <> 'purchase' ORDER BY 2, CASE WHEN last = 'click' THEN -last_seq ELSE first_seq END LIMIT 12""")
def claimed_jobs(spark, d):
    status = F.when(F.col("event_type") == "click", "active").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), status.alias("status"), F.col("event_id").alias("seq"))
    return run.claim_order(state.jobs(e)).limit(12).select("job_id", "queue")  # twelve workers' first claims


JOB_KIND = "CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'complete' ELSE CASE event_id % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'abandon' ELSE 'claim' END END"


@query(f"""WITH RECURSIVE m AS (SELECT event_id AS seq, epoch(ts) AS said, CASE WHEN event_id % 400 <> 399 THEN user_id * 100 + event_id // 1000 END AS job, {JOB_KIND} AS kind, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id % 5 END AS error FROM events),
lap AS (SELECT job, seq, 1 AS late, 'expire' AS kind, NULL AS error FROM (SELECT *, lead(said, 1, epoch(TIMESTAMP '2024-02-01')) OVER (PARTITION BY job ORDER BY seq) - said AS silent FROM m WHERE job IS NOT NULL) WHERE kind IN ('claim', 'progress') AND silent > 21600),
own AS (SELECT job, seq, 0 AS late, kind, error FROM m WHERE job IS NOT NULL AND kind <> 'progress'),
step AS (SELECT * FROM own UNION ALL SELECT * FROM lap UNION ALL SELECT j.job, m.seq, 0, 'restart', NULL FROM m, (SELECT DISTINCT job FROM (SELECT job FROM own UNION ALL SELECT job FROM lap)) j WHERE m.job IS NULL),
num AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq, late) AS n FROM step),
fold AS (SELECT DISTINCT job, 0::BIGINT AS n, NULL::VARCHAR AS status, NULL::VARCHAR AS error, 0 AS attempts, NULL::BIGINT AS claimed, NULL::BIGINT AS requeued FROM num
 UNION ALL SELECT f.job, f.n + 1, CASE WHEN kind = 'enqueue' AND status IS NULL THEN 'pending' WHEN kind = 'claim' AND status = 'pending' THEN 'active' WHEN kind IN ('expire', 'restart') AND status = 'active' THEN 'pending' WHEN kind = 'complete' AND status = 'active' THEN 'completed'
   WHEN kind = 'fail' OR (kind = 'abandon' AND status IN ('active', 'pending')) THEN 'failed' ELSE status END,
  CASE WHEN kind = 'fail' THEN coalesce(s.error, 'extension_job_failed') WHEN kind = 'abandon' AND status IN ('active', 'pending') THEN coalesce(s.error, 'controller_stopped') WHEN kind IN ('claim', 'complete', 'expire', 'restart') AND status IN ('active', 'pending') AND NOT (kind = 'claim' AND status = 'active') AND NOT (kind <> 'claim' AND status = 'pending') THEN NULL ELSE f.error END,
  attempts + CASE WHEN kind = 'claim' AND status = 'pending' THEN 1 ELSE 0 END, CASE WHEN kind = 'claim' AND status = 'pending' THEN s.seq ELSE claimed END, CASE WHEN kind IN ('expire', 'restart') AND status = 'active' THEN s.seq ELSE requeued END
 FROM fold f JOIN num s ON s.job = f.job AND s.n = f.n + 1)
SELECT DISTINCT ON (job) job::VARCHAR AS job_id, status, error, attempts, claimed, requeued FROM fold ORDER BY job, n DESC""")
def job_leases(spark, d):
    """Jobs with leases of six hours: lapses, restarts, failures and abandoned jobs from their messages."""
    k = F.col("event_id")
    error = F.when(k % 3 == 0, "fail").when(k % 3 == 1, "abandon").otherwise("claim")
    names = {"signup": "enqueue", "click": "claim", "view": "progress", "purchase": "complete"}
    kind = error
    for event, name in names.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    restart = k % 400 == 399
    messages = _t(spark, d, "events").select(
        F.when(~restart, (F.col("user_id") * 100 + F.floor(k / 1000)).cast("string")).alias("job_id"), k.alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.when(restart, "restart").otherwise(kind).alias("kind"),
        F.when(k % 2 == 0, F.concat(F.lit("e"), (k % 5).cast("string"))).alias("error"),
    )
    return jobs.job_states(messages, 6 * 3600, "2024-02-01 00:00:00").select("job_id", "status", "error", F.col("attempts").cast("long").alias("attempts"), "claimed", "requeued")


# ---- candidates, queries and plans ----------------------------------------------------------------

SCORED = "CASE p_partkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' END"


def _parts(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(
        _word("S", k).alias("shortcode"), k.alias("ord"), F.when(k % 4 == 0, "HIGH").when(k % 4 == 1, "MEDIUM").when(k % 4 == 2, "LOW").alias("relevance_tier"),
        (k * 37 % 101 / 100.0).alias("relevance_score"), F.when(k % 6 < 2, "COLLECT").when(k % 6 < 5, "AUDIT_ONLY").alias("decision"),
        F.when(k % 3 == 0, relevance.MODEL_VERSION).when(k % 3 == 1, "older").alias("relevance_model_version"),
    )


@query(f"""SELECT 'S' || p_partkey AS shortcode, {SCORED} AS relevance_tier FROM part WHERE p_partkey % 6 < 2
ORDER BY coalesce(p_partkey % 4, 3), (p_partkey * 37 % 101) DESC, p_partkey LIMIT 25""")
def best_candidates(spark, d):
    return relevance.selected(_parts(spark, d), 25).select("shortcode", "relevance_tier")


@query(f"""SELECT 'S' || p_partkey AS shortcode, {SCORED} AS relevance_tier, NULL::VARCHAR AS stop_reason, 39 AS n_columns FROM part WHERE p_partkey % 3 <> 0""")
def stale_records(spark, d):
    r = run.candidate_audit(relevance.stale(_parts(spark, d)))
    return r.select("shortcode", "relevance_tier", "stop_reason", F.lit(len(set(r.columns))).alias("n_columns"))


def _asins(spark, d, table: str, key: str) -> DataFrame:
    return _t(spark, d, table).select(F.concat(F.lit("B"), F.lpad(F.col(key).cast("string"), 9, "0")).alias("asin"), F.col(key).alias("ord"))


@query("SELECT 'B' || lpad(p_partkey::VARCHAR, 9, '0') AS asin, p_partkey AS ord FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def unknown_asins(spark, d):
    profiles = _asins(spark, d, "supplier", "s_suppkey")
    return run.unknown_asins(_asins(spark, d, "part", "p_partkey"), profiles.unionByName(profiles))


@query("SELECT string_agg(asin, ',' ORDER BY asin) AS asins FROM (SELECT 'B' || lpad(s_suppkey::VARCHAR, 9, '0') AS asin FROM supplier UNION SELECT 'B' || lpad(n_nationkey::VARCHAR, 9, '0') FROM nation)")
def run_asins(spark, d):
    return run.run_asins(_asins(spark, d, "supplier", "s_suppkey"), _asins(spark, d, "nation", "n_nationkey"), _asins(spark, d, "supplier", "s_suppkey")).select(F.array_join("amazon_asins", ",").alias("asins"))


def _queries(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(
        _word("A", k % 40).alias("asin"), F.concat_ws(" ", F.col("p_name"), k.cast("string")).alias("query"), F.when(k % 2 == 0, "product_entity").otherwise("scenario").alias("query_family"),
        F.lit("seed").alias("generation_source"), (k % 7).cast("int").alias("priority"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("executed"), (k % 9).cast("int").alias("posts_found"), (k % 3).cast("int").alias("qualified_posts"),
    )


@query(f"""WITH b AS (SELECT DISTINCT ON (asin) 'A' || (p_partkey % 60) AS asin, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS brand FROM part WHERE p_partkey % 4 <> 3 ORDER BY asin, p_partkey),
q AS (SELECT 'A' || (p_partkey % 40) AS asin, p_name || ' ' || p_partkey AS query, p_partkey % 2 = 0 AS product FROM part WHERE p_partkey % 5 <> 0)
SELECT query, q.asin, brand, CASE WHEN product AND brand IS NOT NULL THEN '{ADDRESS}' || replace(lower(brand), '#', '') || '/' END AS account_url FROM q LEFT JOIN b USING (asin)""")
def open_queries(spark, d):
    k = F.col("p_partkey")
    profiles = _t(spark, d, "part").where(k % 4 != 3).select(_word("A", k % 60).alias("asin"), F.when(k % 4 != 0, F.col("p_brand")).alias("brand"), k.alias("profile_ord"))
    return run.with_account(run.pending_queries(_queries(spark, d)), profiles).select("query", "asin", "brand", "account_url")


@query(f"""SELECT p_name || ' ' || p_partkey AS query, CASE WHEN p_partkey % 2 = 0 THEN 'product_entity' ELSE 'scenario' END AS family, 'seed' AS generation_source, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS executed,
 (p_partkey % 9)::INT AS posts_found, (p_partkey % 3)::INT AS qualified_posts FROM part
UNION ALL SELECT '{ADDRESS}p/N' || n_nationkey || '/', 'direct_media_url', 'user_provided', true, 1, 1 FROM nation""")
def plan_sheet(spark, d):
    seeds = _t(spark, d, "nation").select(_address(F.lit("p"), _word("N", F.col("n_nationkey"))).alias("url"))
    return sinks.query_sheet(_queries(spark, d), seeds)


@query("""SELECT check_name, value, n FROM (SELECT count(*) AS rows_, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS bad, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS part FROM orders) o,
LATERAL (VALUES (0, 'no_standalone_media_rows', 'true'), (1, 'raw_rows_equal_csv_rows', (rows_ = 0)::VARCHAR), (2, 'invalid_row_count', bad::VARCHAR), (3, 'shortcode_mismatch_count', '0'),
 (4, 'partial_media_count', part::VARCHAR), (5, 'blocked_media_count', '1'), (6, 'decision', CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END)) t(n, check_name, value)""")
def gate_rows(spark, d):
    k = F.col("o_orderkey")
    one = _t(spark, d, "orders").agg(
        F.count("*").alias("internal_raw_unique_count"), F.count_if(k % 9 == 0).alias("invalid_row_count"), F.lit(0).alias("shortcode_mismatch_count"),
        F.count_if(k % 4 == 0).alias("partial_media_count"), F.lit(1).alias("blocked_media_count"), F.when(F.count_if(k % 9 == 0) > 0, "FAIL").otherwise("PASS").alias("quality_gate"),
    )
    return audit.gate_sheet(one, standalone=0, exported=0).select(F.col("check").alias("check_name"), "value", "n")


@query("SELECT count(*) AS raw_rows, 2 AS rate_limit_count, 5 AS post_batch_size, 20.0::DOUBLE AS navigation_delay_min_seconds, 'ramp' AS recovery_phase, NULL::VARCHAR AS cooldown_until FROM orders")
def patched_manifest(spark, d):
    record = _t(spark, d, "orders").agg(F.count("*").alias("raw_rows"), F.lit("normal").alias("recovery_phase"), F.lit("2024").alias("cooldown_until"))
    r = audit.patched(record, {"rate_limit_count": 2, "recovery_phase": "ramp"})
    return r.select("raw_rows", "rate_limit_count", "post_batch_size", "navigation_delay_min_seconds", "recovery_phase", "cooldown_until")


@query("""WITH p AS (SELECT p_partkey % 40 AS k, p_brand, p_name, p_type, p_partkey FROM part), t AS (SELECT 'direct' AS list, p_partkey AS o, 0 AS pos, p_brand AS term FROM p UNION ALL SELECT 'direct', p_partkey, 1, p_name FROM p
UNION ALL SELECT 'direct', p_partkey, 2, upper(p_name) FROM p UNION ALL SELECT 'direct', p_partkey, 3, 'alias ' || k FROM p UNION ALL SELECT 'medium', p_partkey, 0, p_type FROM p UNION ALL SELECT 'medium', p_partkey, 1, 'use ' || k FROM p),
f AS (SELECT list, arg_min(term, (o, pos)) AS term, min((o, pos)) AS spot FROM t GROUP BY list, lower(term))
SELECT string_agg(term, ';' ORDER BY spot) FILTER (WHERE list = 'direct') AS direct, string_agg(term, ';' ORDER BY spot) FILTER (WHERE list = 'medium') AS medium FROM f""")
def run_terms(spark, d):
    k, none = F.col("p_partkey"), F.lit(None).cast("array<string>")
    p = _t(spark, d, "part").select(
        k.alias("profile_ord"), F.col("p_brand").alias("brand"), F.col("p_name").alias("product_name"), F.array(F.upper("p_name"), _word("alias ", k % 40)).alias("product_aliases"), F.col("p_type").alias("category"),
        none.alias("core_functions"), F.array(_word("use ", k % 40), F.lit("  ")).alias("use_scenarios"), none.alias("pain_points"), F.array(_word("USE ", k % 40)).alias("ingredients"),
    )
    return relevance.semantic_terms(p).select(F.array_join("direct", ";").alias("direct"), F.array_join("medium", ";").alias("medium"))


# ---- saved pages ----------------------------------------------------------------------------------


@query("""SELECT p_partkey::VARCHAR AS asin, p_name AS title, p_brand AS brand, p_type || '|size ' || p_size AS bullets, p_type AS category, p_partkey % 3 <> 0 AS available FROM part""")
def product_pages(spark, d):
    k, c = F.col("p_partkey"), F.concat
    html = c(
        F.lit("<html><head><title>shop</title></head><body><h1><span id='productTitle'>\n "), F.col("p_name"), F.lit(" </span></h1><a id='bylineInfo'>"),
        F.when(k % 2 == 0, c(F.lit("Visit the "), F.col("p_brand"), F.lit(" Store"))).otherwise(c(F.lit("Brand: "), F.col("p_brand"))), F.lit("</a><div id='feature-bullets'>\n"), F.col("p_type"), F.lit("\n\nsize  "),
        F.col("p_size").cast("string"), F.lit("\n</div><div id='wayfinding-breadcrumbs_feature_div'>Home › All › "), F.col("p_type"), F.lit("</div><div id='availability'>"),
        F.when(k % 3 == 0, "Currently unavailable.").otherwise("In stock"), F.lit("</div></body></html>"),
    )
    r = saved.product_facts(_t(spark, d, "part").select(k.cast("string").alias("asin"), html.alias("html")))
    return r.select("asin", "title", "brand", F.array_join("bullets", "|").alias("bullets"), "category", "available")


@query("""SELECT 'C' || conv_id AS media_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, (turn + 1)::VARCHAR AS comment_id, CASE WHEN turn % 2 = 1 THEN turn::VARCHAR END AS parent_comment_id, turn % 2 AS depth,
 role || turn AS author, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5, '2024-01-' || (10 + turn % 20) AS published_at, turn || 'd' AS published_label, CASE WHEN turn % 3 = 0 THEN (turn * 1000 + 5)::VARCHAR END AS likes,
 'https://www.instagram.com/p/C' || conv_id || '/c/' || (turn + 1) || '/' AS comment_url FROM conversations WHERE conv_id % 7 <> 3 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def page_comments(spark, d):
    """Conversations as saved pages: even turns are cards of a post, odd ones replies in a list of their own; some pages are of another post."""
    c, t, lit, join = F.col("conv_id").cast("string"), F.col("turn"), F.lit, F.concat
    who, number = join("role", t.cast("string")), (t + 1).cast("string")
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", lit("")), lit("&"), lit("&amp;")), lit("<"), lit("&lt;")), lit(">"), lit("&gt;"))
    likes = F.when(t % 3 == 0, join(lit("<div><span>"), (t * 1000 + 5).cast("string"), lit(" likes</span></div>"))).otherwise("")
    card = join(
        lit("<div><span><a href='/"), who, lit("/'>"), who, lit("</a></span><div>"), escaped, lit("</div><span><a href='/p/C"), c, lit("/c/"), number, lit("/'><time datetime='2024-01-"), (10 + t % 20).cast("string"), lit("'>"), t.cast("string"),
        lit("d</time></a></span>"), likes, lit("<div role='button'><span>Reply</span></div></div>"),
    )
    item = F.when(t % 2 == 1, join(lit("<ul><li>"), card, lit("</li></ul></li>"))).otherwise(join(lit("<li>"), card))
    items = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]), "").alias("items"))
    url = join(lit(ADDRESS + "p/C"), c, lit("/"))
    own = F.when(F.col("conv_id") % 7 == 3, ADDRESS + "p/OTHER/").otherwise(url)
    html = join(lit("<html><head><meta property='og:url' content='"), own, lit("'></head><body><article><header><a href='/o/'>o</a></header><ul>"), F.col("items"), lit("</ul></article></body></html>"))
    r = cards.comment_cards(items.select(url.alias("url"), html.alias("html")))
    return r.select(
        "media_id", F.col("pos").cast("long").alias("pos"), "comment_id", "parent_comment_id", F.col("depth").cast("long").alias("depth"), "author", F.md5(F.col("comment_text").cast("binary")).alias("text_md5"), "published_at", "published_label",
        F.col("like_count").alias("likes"), "comment_url",
    )


@query(f"""SELECT '{ADDRESS}p/M' || i || '/' AS url, i % 3 <> 1 AND NOT (i % 3 = 2 AND i % 5 <> 0) AS verified, CASE WHEN i % 3 = 0 THEN 'own.er' END AS owner, 'own.er' AS accounts, 'red ' || i || ' #tag' || (i % 7) AS caption,
 'Seen ' || i AS visible_text, CASE WHEN i % 4 = 0 THEN 'a long picture ' || i ELSE 'short' END AS alt FROM (SELECT p_partkey AS i FROM part)""")
def media_pages(spark, d):
    k = F.col("p_partkey").cast("string")
    i, c = F.col("p_partkey"), F.concat
    og = F.when(i % 3 == 0, c(F.lit(ADDRESS + "own.er/p/M"), k, F.lit("/"))).when(i % 3 == 1, ADDRESS + "p/OTHER/").otherwise("https://example.com/")
    link = F.when((i % 3 == 2) & (i % 5 == 0), c(F.lit("<a href='" + ADDRESS + "p/M"), k, F.lit("/c/17/'></a>"))).otherwise("<a href='/about'></a>")
    more = F.when(i % 4 == 0, c(F.lit("<img alt='a long  picture "), k, F.lit("'>"))).otherwise("")
    html = c(
        F.lit("<html><head><meta property='og:url' content='"), og, F.lit("'><meta property='og:title' content='Own (@own.er)'><meta property='og:description' content='3 likes: “red "), k, F.lit(" #tag"), (i % 7).cast("string"),
        F.lit("”'></head><body>Seen\n  "), k, link, F.lit("<img alt='someone&#39;s profile picture of great length'><img alt='short'>"), more, F.lit("</body></html>"),
    )
    m = saved.media_metadata(_t(spark, d, "part").select(c(F.lit(ADDRESS + "p/M"), k, F.lit("/")).alias("url"), html.alias("html")))
    return m.select("url", F.col("identity.ok").alias("verified"), "owner", F.array_join("accounts", ",").alias("accounts"), "caption", "visible_text", F.col("media_alt_text").alias("alt"))


@query(f"""WITH l AS (SELECT doc_id % 30 AS q, doc_id AS ord, doc_id % 45 AS m, CASE WHEN doc_id % 2 = 0 THEN 'p' ELSE 'reel' END AS kind, repeat('x', (doc_id % 17 + 1)::INT) AS said FROM documents WHERE doc_id % 11 <> 0),
b AS (SELECT q, m, min(ord) AS ord, arg_min(kind, ord) AS kind, max(said) AS said FROM l GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ord) AS n FROM b)
SELECT 'q' || q AS query, 'M' || m AS shortcode, kind AS media_type, '{ADDRESS}' || kind || '/M' || m || '/' AS url, said AS text, ord FROM n WHERE n <= 10""")
def search_page_links(spark, d):
    i = F.col("doc_id")
    address = _address(F.when(i % 2 == 0, "p").otherwise("reels"), _word("M", i % 45))
    url = F.when(i % 11 == 0, "https://example.com/").when(i % 3 == 0, F.concat(F.lit("https://www.google.com/url?q="), F.url_encode(address), F.lit("&sa=U"))).otherwise(address)
    links = _t(spark, d, "documents").select(_word("q", i % 30).alias("query"), i.alias("ord"), url.alias("url"), F.concat(F.lit(" "), F.repeat(F.lit("x"), (i % 17 + 1).cast("int"))).alias("text"))
    return saved.search_links(links).select("query", "shortcode", "media_type", "url", "text", "ord")
