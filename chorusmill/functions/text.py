"""Text rules as column expressions. Case folding is lower(): equal for ASCII and CJK."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the text rules.
STOP_WORDS = ["the", "and", "for", "with", "from", "this", "that", "amazon", "pack", "count"]
EDGE = " ,;|-."
WHITE = r"(?U)[\s\x1c-\x1f]+"
EXPANSION_PATTERN = r"^(?:load|show|view)\s+(?:all\s+)?(?:previous\s+)?(?:\d+\s+)?(?:more\s+)?comments?(?:\s*\(\d+\))?$|^(?:view|show|load)\s+(?:all\s+)?(?:\d+\s+)?(?:more\s+)?repl(?:y|ies)(?:\s*\(\d+\))?$|^(?:加载|显示|查看)(?:全部|所有|更多|之前的)?\s*\d*\s*条?(?:更多)?评论$|^查看更多评论$|^(?:查看|显示|加载)(?:全部|所有|更多)?\s*\d*\s*条?(?:更多)?回复$"
TRIGGER_PATTERN = r"^(?:comment|comments|open comments|view comments|评论|打开评论|查看评论)$"
EMPTY_PATTERN = r"(?:no comments yet|be the first to comment|comments are turned off|暂无评论|还没有评论|成为第一个评论的人|评论已关闭)"
RESTRICTIONS = [
    ("captcha", r"captcha|confirm you.?re human|验证码"),
    ("rate_limited", r"try again later|too many requests|rate limit|操作过于频繁"),
    ("private", r"this account is private|此帐号为私密帐号"),
    ("unavailable", r"sorry, this page isn.?t available|page not available|页面不可用"),
    ("login_required", r"log in to instagram|登录 instagram 以继续"),
]
#: What a page shows when it fails, in order of precedence; the last also by its address.
PAGE_ERRORS = [
    ("rate_limited", r"http error 429|too many requests|try again later|操作过于频繁"),
    ("unavailable", r"sorry, this page isn.?t available|page not available|页面不可用"),
    ("login_required", r"log in to instagram|登录 instagram"),
]
LOGIN_ADDRESS = r"/accounts/login"
RATE_LIMIT_PATTERN = r"(?i)http\s*(?:error\s*)?429|too many requests|try again later|rate[_ -]?limited|操作过于频繁"
COUNT_BEFORE = r"(?i)([\d,.]+)\s*(万|k|m)?\s*(?:comments?|条评论|评论)"
COUNT_AFTER = r"(?i)(?:comments?|条评论|评论)\s*([\d,.]+)\s*(万|k|m)?"
COUNT_ALONE = r"(?i)^\s*([\d,.]+)\s*(万|k|m)?\s*$"
LIKES_PATTERN = r"(?i)(\d[\d,.]*)\s*(?:likes?|次赞|赞)"
BADGE_PATTERN = r"(?i)\s*(?:verified|已验证)\s*"
CARD_NOISE = r"(?i)^(?:reply|like|likes|see translation|view translation|回复|赞|查看翻译|翻译|\d[\d,.]*\s*(?:likes?|次赞|赞))$"
SEARCH_PREFIX = "https://www.google.com/search?q="
SEARCH_SITES = "site:instagram.com/p/ OR site:instagram.com/reel/ "
TAG_ADDRESS = "https://www.instagram.com/explore/tags/"
UI_LABELS = ["帖子", "Reels", "轮播"]


def clean_text(value: Column) -> Column:
    """White space collapsed, edge punctuation stripped; null as empty."""
    return F.btrim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), WHITE, " "), F.lit(EDGE))


def distinct_folded(values: Column) -> Column:
    """Values in order, without blanks and without those that equal an earlier one in lower case. values is evaluated once."""
    none, kind = F.array().cast("array<string>"), "struct<lows:array<string>,values:array<string>>"

    def add(kept: Column, v: Column) -> Column:
        low = F.lower(v)
        more = F.struct(F.array_append(kept["lows"], low), F.array_append(kept["values"], v)).cast(kind)
        return F.when((low == "") | F.array_contains(kept["lows"], low), kept).otherwise(more)

    return F.aggregate(values, F.struct(none, none).cast(kind), add, lambda kept: kept["values"])


def clean(values: Column) -> Column:
    """Cleaned values in order, blanks dropped, the first spelling of each kept; a null list is an empty one."""
    return distinct_folded(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean_text))


def clean_list(values: list[str | None]) -> list[str]:
    """clean() of constants."""
    out: dict[str, str] = {}
    for value in values:
        value = re.sub(r"\s+", " ", value or "").strip(EDGE)
        if value:
            out.setdefault(value.lower(), value)
    return list(out.values())


def words(value: Column) -> Column:
    """Lower-case tokens of more than two characters that are no stop words; order and repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(value.cast("string"), F.lit(""))), F.lit(r"[A-Za-z0-9][A-Za-z0-9+.-]*"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def found_terms(folded: Column, terms: list[str]) -> Column:
    """The cleaned ones of constant terms that a folded text contains."""
    hits = [F.when(F.contains(folded, F.lit(t.lower())), F.lit(t)) for t in clean_list(terms)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def contains_terms(text: Column, terms: Column | list[str]) -> Column:
    """The cleaned terms that text contains, case folded. Constant terms (a list) are cleaned once and become plain tests."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(clean(terms), lambda t: F.contains(folded, F.lower(t))) if isinstance(terms, Column) else found_terms(folded, terms)


def compact(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")


def term_in(term: Column, value: Column) -> Column:
    """Whether a term is in a text as it stands, or without punctuation if it has six or more letters and digits."""
    short = compact(term)
    return (term != "") & (F.contains(F.lower(value), F.lower(term)) | ((F.length(short) >= 6) & F.contains(compact(value), short)))


def term_sources(term: Column, evidence: Column) -> Column:
    """Names of the evidence entries (a map) that hold the term."""
    return F.map_keys(F.map_filter(evidence, lambda _, v: term_in(term, v)))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"#[\p{L}\p{N}_]+"), F.lit(0)))


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def visible_count(raw: Column) -> Column:
    """Count of a rendered label: commas, decimals, 万, k and m; rounded half up; null if there is none."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), "\u00a0", " ")
    rules = [COUNT_BEFORE, COUNT_AFTER, COUNT_ALONE]
    hit = F.coalesce(*(F.when(text.rlike(p), F.lit(k)) for k, p in enumerate(rules)))
    pick = lambda g: F.coalesce(*(F.when(hit == k, _group(text, p, g)) for k, p in enumerate(rules)))
    value = F.regexp_replace(pick(1), ",", "").try_cast("double")
    scale = F.when(pick(2) == "万", 10000.0).when(F.lower(pick(2)) == "k", 1000.0).when(F.lower(pick(2)) == "m", 1000000.0).otherwise(1.0)
    return F.floor(value * scale + 0.5).cast("long")


def like_text(text: Column) -> Column:
    """The rendered number before a likes label, as it stands."""
    return _group(F.coalesce(text, F.lit("")), LIKES_PATTERN, 1)


def restriction(text: Column) -> Column:
    value = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, pattern in RESTRICTIONS:
        out = F.when(value.rlike(pattern), F.lit(name)) if out is None else out.when(value.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("ready"))


def visible_error(text: Column, url: Column) -> Column:
    """rate_limited, unavailable or login_required, the first that text or address shows; else null."""
    value = F.lower(F.coalesce(text, F.lit("")))
    shown = [F.when(value.rlike(pattern), F.lit(name)) for name, pattern in PAGE_ERRORS]
    return F.coalesce(*shown, F.when(F.coalesce(url, F.lit("")).rlike(LOGIN_ADDRESS), F.lit("login_required")))


def normal_label(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def is_expansion_label(value: Column) -> Column:
    return normal_label(value).rlike("(?i)" + EXPANSION_PATTERN)


def is_trigger_label(value: Column) -> Column:
    return normal_label(value).rlike("(?i)" + TRIGGER_PATTERN)


def is_empty_label(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).rlike("(?i)" + EMPTY_PATTERN)


def combined_label(parts: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, normal_label), lambda v: v != "")), " | ")


def is_expansion_control(parts: Column) -> Column:
    return F.exists(parts, is_expansion_label)


def author_name(value: Column) -> Column:
    """Without the badge text and the leading @; blank as null."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(value, BADGE_PATTERN, " "), r"^\s*@", "")), F.lit(""))


def own_text(card: Column, author: Column, buttons: Column, time_text: Column) -> Column:
    """A comment's text from its card's lines: without author, buttons, time, and reply, like and translation lines."""
    lines = F.transform(F.split(card, r"\r?\n"), lambda x: F.trim(x))
    keep = lambda x: (x != "") & (F.coalesce(x != author, F.lit(True))) & ~F.array_contains(F.coalesce(buttons, F.array().cast("array<string>")), x) & F.coalesce(x != time_text, F.lit(True)) & ~x.rlike(CARD_NOISE)
    return F.nullif(F.array_join(F.filter(lines, keep), " "), F.lit(""))


def csv_value(value: Column, nested: bool = False) -> Column:
    """Nested values as JSON text with nulls kept, null as the empty string."""
    return F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}) if nested else value.cast("string"), F.lit(""))


def truth(value: Column) -> Column:
    """Anything but 0, false, no and off."""
    return ~F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))).isin("0", "false", "no", "off")


def search_url(query: Column) -> Column:
    """The public search for a query's media: percent-coded, slashes as they are."""
    coded = F.url_encode(F.concat(F.lit(SEARCH_SITES), F.coalesce(query, F.lit(""))))
    for form, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(form), F.lit(plain))
    return F.concat(F.lit(SEARCH_PREFIX), coded)


def tag_slug(query: Column) -> Column:
    """ASCII letters and digits in lower case, 80 at most; null if there are none."""
    return F.nullif(F.substring(F.lower(F.regexp_replace(query, "[^A-Za-z0-9]+", "")), 1, 80), F.lit(""))


def tag_url(query: Column) -> Column:
    return F.concat(F.lit(TAG_ADDRESS), tag_slug(query), F.lit("/"))


def has_rate_limit(value: Column, kind: T.DataType) -> Column:
    """Whether any text in a value of that type names a rate limit; names of fields and keys of maps do not count."""
    if isinstance(kind, T.StructType):
        tests = [has_rate_limit(value[f.name], f.dataType) for f in kind.fields]
    elif isinstance(kind, T.ArrayType):
        tests = [F.coalesce(F.exists(value, lambda v: has_rate_limit(v, kind.elementType)), F.lit(False))]
    elif isinstance(kind, T.MapType):
        tests = [F.coalesce(F.exists(F.map_values(value), lambda v: has_rate_limit(v, kind.valueType)), F.lit(False))]
    elif isinstance(kind, T.StringType):
        tests = [F.coalesce(value.rlike(RATE_LIMIT_PATTERN), F.lit(False))]
    else:
        tests = []
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out
