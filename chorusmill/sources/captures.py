"""Sources: capture JSON, comment JSONL, ASIN lists, product facts and media metadata from saved HTML, link tables."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.text import clean_text, hashtags
from ..schemas import CAPTURE, RAW_COMMENT


def read_captures(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Capture documents with fingerprint (SHA-256 of the file), path and ord (by path); a byte-order mark is tolerated.

    A file that is no JSON fails the query (strict), or is a row of nulls that ingest.checked marks as invalid.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    parsed = files.select("path", F.sha2("content", 256).alias("fingerprint"), F.from_json(text, CAPTURE, mode).alias("c"))
    return parsed.select(F.col("path").alias("ord"), "fingerprint", "path", "c.*")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop))


def read_rows(spark: SparkSession, path: str, strict: bool = True, schema: str = RAW_COMMENT) -> DataFrame:
    """Comment rows from JSONL: blank lines skipped; a malformed line fails (strict) or is dropped. A missing path is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], schema)


CHECKPOINT = "stop_reason string, collection_goal string, settings struct<collection_goal:string>, amazon_asins array<string>, processed_capture_hashes array<string>"
PLAN = "amazon_asins array<string>, seed_media_urls array<string>, queries array<struct<asin:string,query:string,query_family:string,family:string,generation_source:string,priority:int,executed:boolean,posts_found:int,qualified_posts:int>>"
CANDIDATE = (
    "shortcode string, media_type string, url string, discovery_media_type string, discovery_url string, requested_media_type string, requested_url string, "
    "rendered_media_type string, rendered_url string, working_media_url string, route_fallback_attempt_count int, route_fallback_success_count int, owner string, "
    "relevance_tier string, relevance_score double, evidence_terms array<string>, evidence_sources array<string>, matched_groups array<string>, "
    "relevance_reason string, relevance_model_version string, deliverable_eligible boolean, decision string, stop_reason string, shortcode_mismatch_count int"
)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return read_optional_json(spark, path, CHECKPOINT)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return read_optional_json(spark, path, PLAN)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The candidate audit, one row per candidate; none where there is no file."""
    return read_optional_json(spark, path, CANDIDATE)


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an earlier run that have an id, the last of each by file and line; malformed lines are skipped."""
    rows = read_rows(spark, path, strict=False)
    if not exists(spark, path):
        return rows
    # ids grow along a split, whose place in its file is known
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    named = rows.select("*", place.alias("_place")).where(F.coalesce("comment_id", F.lit("")) != "")
    return named.groupBy("comment_id").agg(F.max_by(F.struct(*rows.columns), "_place").alias("r")).select("r.*")


def asins(spark: SparkSession, single: list[str] | None = None, joined: str | None = None, file: str | None = None, split_single: bool = False) -> DataFrame:
    """Distinct ASINs in order of first mention (ord, asin); a value that is none fails the query.

    split_single: whether single values are split at commas and white space too, as the joined ones and a text file are.
    A csv file gives one value per cell. The header word ASIN is dropped.
    """
    rows = [(0, k, v) for k, v in enumerate(single or [])]
    cut = lambda c: F.split(c, r"[,\s]+")
    parts = spark.createDataFrame(rows, "source int, line long, value string").select("source", "line", F.posexplode(cut("value") if split_single else F.array("value")).alias("pos", "value"))
    if joined:
        parts = parts.unionByName(spark.createDataFrame([(1, 0, joined)], "source int, line long, value string").select("source", "line", F.posexplode(cut("value")).alias("pos", "value")))
    if file:
        lines = spark.read.text(file).select(F.lit(2).alias("source"), F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^﻿", "").alias("value"))
        quoted = F.regexp_extract_all("value", F.lit(r'("(?:[^"]|"")*"|[^,"]+)'), F.lit(1))  # a quoted cell may hold commas
        cells = quoted if file.lower().endswith(".csv") else cut("value")
        parts = parts.unionByName(lines.select("source", "line", F.posexplode(cells).alias("pos", "value")))
    value = F.upper(F.trim(F.regexp_replace("value", '^"|"$', "")))
    named = parts.withColumn("value", value).where("value <> '' AND value <> 'ASIN'")
    good = F.when(F.col("value").rlike("^[A-Z0-9]{10}$"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an ASIN: "), "value")))
    return named.withColumn("asin", good).groupBy("asin").agg(F.min(F.struct("source", "line", "pos")).alias("ord")).select("ord", "asin")


class _Facts(HTMLParser):
    """Text by element id or class, meta properties, and image alternatives of a saved page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.texts: dict[str, list[str]] = {}
        self.meta: dict[str, str] = {}
        self.alts: list[str] = []
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            self.meta[a.get("property") or a.get("name") or ""] = a.get("content") or ""
        elif tag == "img" and a.get("alt"):
            self.alts.append(a["alt"])
        elif tag == "link" and a.get("rel") == "canonical":
            self.meta["canonical"] = a.get("href") or ""
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag not in ("meta", "img", "link", "br", "input", "hr"):
            self.stack.append(a.get("id") or tag)
            self.texts.setdefault(self.stack[-1], []).append("")

    def handle_endtag(self, tag):
        if self.stack:
            self.stack.pop()

    def handle_data(self, data):
        for name in self.stack:
            self.texts[name][-1] += data


def _facts(page: str | None) -> _Facts:
    parser = _Facts()
    try:
        parser.feed(page or "")
    except AssertionError:
        pass
    return parser


_PRODUCT_PAGE = "struct<title:string,brand:string,bullets:array<string>,breadcrumb:string,availability:string>"


def _product_page(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for page in pages:
        f = _facts(page)
        one = lambda k, f=f: " ".join((f.texts.get(k) or [""])[0].split()) or None
        bullets = [" ".join(x.split()) for x in f.texts.get("feature-bullets", [""])[0].split("\n") if x.strip()]
        crumbs = [x.strip() for x in f.texts.get("wayfinding-breadcrumbs_feature_div", [""])[0].split("›") if x.strip()]
        rows.append((one("productTitle") or one("title"), one("bylineInfo"), bullets[:12], " ".join(crumbs[-1].split()) if crumbs else None, one("availability")))
    return pd.DataFrame(rows, columns=["title", "brand", "bullets", "breadcrumb", "availability"])


def brand_name(value: Column) -> Column:
    """A byline without its store and label words."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(value, r"(?i)^\s*(?:visit the\s+|brand:\s*)", ""), r"(?i)\s+store\s*$", "")), F.lit(""))


def product_facts(pages: DataFrame) -> DataFrame:
    """asin, title, brand, bullets (12 at most), category, available of saved product pages (asin, html)."""
    p = pages.select("asin", F.pandas_udf(_product_page, _PRODUCT_PAGE)("html").alias("p"))
    gone = F.coalesce("p.availability", F.lit("")).rlike(r"(?i)unavailable|out of stock|currently not available")
    return p.select("asin", "p.title", brand_name(F.col("p.brand")).alias("brand"), "p.bullets", F.col("p.breadcrumb").alias("category"), (~gone).alias("available"))


_MEDIA_PAGE = "struct<og_url:string,canonical:string,description:string,title:string,text:string,alts:array<string>,links:array<string>>"


def _media_page(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for page in pages:
        f = _facts(page)
        text = " ".join("".join(f.texts.get("body", [""])).split())
        rows.append((f.meta.get("og:url"), f.meta.get("canonical"), f.meta.get("og:description") or f.meta.get("description"), f.meta.get("og:title"), text[:5000], [" ".join(a.split()) for a in f.alts], f.links))
    return pd.DataFrame(rows, columns=["og_url", "canonical", "description", "title", "text", "alts", "links"])


def media_metadata(pages: DataFrame) -> DataFrame:
    """Identity, owner, accounts, caption, hashtags, visible text (5000 characters), alternatives (10) of saved media pages (url, html)."""
    p = pages.select("url", F.pandas_udf(_media_page, _MEDIA_PAGE)("html").alias("p"))
    found = identity.verify_identity(F.col("url"), F.col("p.canonical"), F.col("p.og_url"), F.col("p.links"), F.lit(None).cast("string"))
    caption = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("p.description", F.lit("")), r'(?s):\s*[“"](.*)[”"]', 1), F.lit("")), F.col("p.description"))
    accounts = F.array_distinct(F.regexp_extract_all(F.coalesce("p.title", F.lit("")), F.lit(r"@([A-Za-z0-9._]+)"), F.lit(1)))
    about = F.filter("p.alts", lambda a: ~F.lower(a).contains("profile picture") & ~a.contains("头像"))
    longest = F.aggregate(about, F.lit(""), lambda best, a: F.when(F.length(a) > F.length(best), a).otherwise(best))
    return p.select(
        "url", found.alias("identity"), identity.canonical_media(F.col("p.og_url"))["owner"].alias("owner"), accounts.alias("accounts"), caption.alias("caption"), hashtags(caption).alias("hashtags"),
        F.col("p.text").alias("visible_text"), F.slice("p.alts", 1, 10).alias("visible_image_alts"), F.nullif(longest, F.lit("")).alias("media_alt_text"),
    )


def search_links(links: DataFrame, limit: int = 10) -> DataFrame:
    """Media of search-result links (query, ord, url, text): redirects unwrapped, longest text per shortcode, `limit` per query."""
    from pyspark.sql import Window

    m = links.withColumn("m", identity.canonical_media(identity.unwrap_redirect(F.col("url")))).where("m IS NOT NULL").withColumn("text", clean_text(F.col("text")))
    best = m.groupBy("query", F.col("m.media_id").alias("shortcode")).agg(F.min("ord").alias("ord"), F.min_by("m", "ord").alias("m"), F.max_by("text", F.struct(F.length("text"), -F.col("ord"))).alias("text"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("ord"))
    return best.withColumn("n", place).where(F.col("n") <= limit).select("query", "shortcode", F.col("m.media_type").alias("media_type"), F.col("m.media_url").alias("url"), "text", hashtags(F.col("text")).alias("hashtags"), "ord")
