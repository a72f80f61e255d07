"""Media identity from addresses, and identity checks over whole captures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and path forms of media addresses. The strict form has no owner before the kind.
HOSTS = ["instagram.com", "www.instagram.com"]
STRICT_PATH = r"^/(p|reels?)/([A-Za-z0-9_-]+)(?:/|$)"
OWNER_PATH = r"^/(?:([A-Za-z0-9._]+)/)?(p|reels?)/([A-Za-z0-9_-]+)(?:/|$)"
IDENTITY_TYPE = "struct<media_id:string,media_type:string,owner:string,media_url:string>"


def _found(url: Column, pattern: str, kind: int, code: int, owner: int | None, hosts: list[str]) -> Column:
    path = F.try_parse_url(url, F.lit("PATH"))
    fits = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(hosts) & path.rlike(pattern)
    media_type = F.when(F.regexp_extract(path, pattern, kind) == "p", "p").otherwise("reel")
    shortcode = F.regexp_extract(path, pattern, code)
    who = F.nullif(F.regexp_extract(path, pattern, owner), F.lit("")) if owner else F.lit(None).cast("string")
    address = F.concat(F.lit("https://www.instagram.com/"), media_type, F.lit("/"), shortcode, F.lit("/"))
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(shortcode.alias("media_id"), media_type.alias("media_type"), who.alias("owner"), address.alias("media_url")))


def canonical_media(url: Column, hosts: list[str] = HOSTS) -> Column:
    """Identity of an address that may name the owner first; null if it is none."""
    return _found(url, OWNER_PATH, 2, 3, 1, hosts)


def media_identity(url: Column) -> Column:
    """Identity by the strict form: an owner before the kind makes it none."""
    return _found(url, STRICT_PATH, 1, 2, None, HOSTS)


def alternate_url(url: Column) -> Column:
    """The same media under its other route."""
    m = canonical_media(url)
    return F.concat(F.lit("https://www.instagram.com/"), F.when(m["media_type"] == "reel", "p").otherwise("reel"), F.lit("/"), m["media_id"], F.lit("/"))


def comment_id(url: Column) -> Column:
    in_path = F.nullif(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/c/(\d+)(?:/|$)", 1), F.lit(""))
    return F.coalesce(in_path, F.try_parse_url(url, F.lit("QUERY"), F.lit("comment_id")), F.try_parse_url(url, F.lit("QUERY"), F.lit("commentId")))


def shortcode_in(value: Column) -> Column:
    """A shortcode anywhere in a text."""
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), r"/(?:p|reels?)/([A-Za-z0-9_-]+)", 1), F.lit(""))


def unwrap_redirect(url: Column, host: str = "instagram.com") -> Column:
    """The media address inside a redirect's q or url parameter, else the address itself."""
    inner = lambda k: F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(k)))
    pick = lambda c: F.when(F.contains(c, F.lit(host)), c)
    return F.coalesce(pick(inner("q")), pick(inner("url")), url)


def mismatch_count(media_id: Column, page: Column, comments: Column) -> Column:
    """Ingest's count: the page's own, at least 1 if identity is false; per comment 1 for an address that is none or of
    another media, and for a missing one where identity is confirmed."""
    own = F.coalesce(page["shortcode_mismatch_count"], F.lit(0))
    own = F.when(page["identity_verified"] == F.lit(False), F.greatest(own, F.lit(1))).otherwise(own)
    strict = F.coalesce(page["identity_verified"], F.lit(False))

    def wrong(c: Column) -> Column:
        missing = F.coalesce(c["comment_url"], F.lit("")) == ""
        return F.when(missing, strict).otherwise(F.coalesce(media_identity(c["comment_url"])["media_id"] != media_id, F.lit(True)))

    return (own + F.size(F.filter(F.coalesce(comments, F.array()), wrong))).cast("int")


def media_path(url: Column) -> Column:
    """The route of a media address as a key (/p/CODE/), null if it is none."""
    m = canonical_media(url)
    return F.concat(F.lit("/"), m["media_type"], F.lit("/"), m["media_id"], F.lit("/"))


def is_media_payload(payload: Column) -> Column:
    """Whether any of a job's addresses (url, requested_url, discovery_url, navigation_source_url) is of the media host."""
    named = (payload["url"], payload["requested_url"], payload["discovery_url"], payload["navigation_source_url"])
    return F.exists(F.array(*named), lambda u: F.contains(F.lower(F.coalesce(u, F.lit(""))), F.lit("instagram.com/")))


def collection_check(expected: Column, media: Column, page: Column, comments: Column) -> Column:
    """The collection's count and the codes seen, sorted.

    The page's own count, one for an identity that is not confirmed, one for a media that is missing or another one,
    and one for each permalink of another media; permalinks that are missing or none count nothing.
    """
    own = F.coalesce(F.nullif(media["media_id"], F.lit("")), canonical_media(media["media_url"])["media_id"], F.lit(""))
    want = F.coalesce(expected, F.lit(""))
    codes = F.filter(F.transform(F.coalesce(comments, F.array()), lambda c: canonical_media(c["comment_url"])["media_id"]), lambda c: c.isNotNull())
    wrong = F.filter(codes, lambda c: (c != want) | (c != own))
    unsure = F.when(F.coalesce(page["identity_verified"], F.lit(False)), 0).otherwise(1)
    count = F.coalesce(page["shortcode_mismatch_count"], F.lit(0)) + unsure + F.when((own == "") | (own != want), 1).otherwise(0) + F.size(wrong)
    seen = F.concat(F.coalesce(page["observed_shortcodes"], F.array().cast("array<string>")), F.array(F.nullif(own, F.lit(""))), codes)
    observed = F.array_sort(F.array_distinct(F.filter(seen, lambda c: c.isNotNull())))
    return F.struct((count == 0).alias("ok"), F.nullif(own, F.lit("")).alias("actual_shortcode"), count.cast("int").alias("mismatch_count"), observed.alias("observed_shortcodes"))


def route_evidence(requested: Column, final: Column, location: Column, canonical: Column, og: Column, comment_urls: Column, error: Column, ready: Column) -> Column:
    r, f, l, c, o = (canonical_media(x) for x in (requested, final, location, canonical, og))
    rendered_id, rendered_type = F.coalesce(l["media_id"], f["media_id"]), F.coalesce(l["media_type"], f["media_type"])
    others = F.filter(F.concat(F.array(c["media_id"], o["media_id"]), F.transform(F.coalesce(comment_urls, F.array().cast("array<string>")), lambda u: canonical_media(u)["media_id"])), lambda x: x.isNotNull())
    code_wrong = F.coalesce((rendered_id != r["media_id"]) | F.exists(others, lambda x: x != r["media_id"]), F.lit(True))
    route_wrong = F.coalesce((f["media_type"] != r["media_type"]) | (l["media_type"] != r["media_type"]), F.lit(True))
    conflict = lambda m, name: F.when(m["media_type"] != rendered_type, F.lit(name))
    conflicts = F.filter(F.array(conflict(c, "canonical_route_type"), conflict(o, "og:url_route_type")), lambda x: x.isNotNull())
    ok = F.coalesce(ready, F.lit(False)) & F.coalesce(error == "", F.lit(True)) & ~code_wrong & ~route_wrong
    return F.struct(
        ok.alias("ok"), r["media_id"].alias("requested_shortcode"), r["media_type"].alias("requested_media_type"), rendered_id.alias("actual_shortcode"), rendered_type.alias("rendered_media_type"),
        code_wrong.alias("shortcode_mismatch"), route_wrong.alias("route_mismatch"), conflicts.alias("evidence_conflicts"), F.nullif(error, F.lit("")).alias("error_state"),
    )


def verify_identity(location: Column, canonical: Column, og: Column, comment_urls: Column, expected: Column) -> Column:
    """The location's code must agree with page metadata, permalinks and the expected one, and something must corroborate it."""
    actual = canonical_media(location)["media_id"]
    witnesses = F.filter(F.concat(F.array(canonical_media(canonical)["media_id"], canonical_media(og)["media_id"]), F.transform(F.coalesce(comment_urls, F.array().cast("array<string>")), lambda u: canonical_media(u)["media_id"])), lambda x: x.isNotNull())
    wrong = F.coalesce(F.exists(witnesses, lambda x: x != actual), actual.isNull()) | F.coalesce((expected != "") & (expected != actual), F.lit(False))
    backed = F.size(witnesses) > 0
    reason = F.when(wrong, "MEDIA_ID_MISMATCH").when(backed, "verified").otherwise("identity_evidence_not_ready")
    observed = F.array_distinct(F.filter(F.concat(F.array(actual), witnesses), lambda x: x.isNotNull()))
    return F.struct((~wrong & backed).alias("ok"), actual.alias("actual_shortcode"), observed.alias("observed_shortcodes"), wrong.cast("int").alias("mismatch_count"), reason.alias("reason"))


def all_agree(codes: Column) -> Column:
    """At least one code, and no two different ones."""
    return F.size(F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))) == 1
