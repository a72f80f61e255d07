"""Exact removal of repeated byte strings by a distributed, sparse suffix array.

Every string of `length` bytes is represented by the suffix that starts at its anchor: the first of its
least `gram`-byte names (Karp-Rabin names, mixed). Equal strings have equal anchors, and neighbouring
strings share one, so only one suffix in about 36 bytes is sorted. A suffix's leading tokens are the
name of its gram and the name of the span of bytes covered by all strings of that anchor.

1. A bounded sample of suffixes gives splitters; each suffix goes to the bucket of its key (gram, span,
   document, start). A frequent suffix is split over buckets by its place in the corpus.
2. A bucket sorts its suffixes by multikey quicksort. Of equal spans all but the first are repeats as a
   whole. Different spans that share their gram and enough bytes beside it may share some strings only:
   they stay open. So do spans whose gram also stands beyond the bucket's border.
3. The open spans' strings are named one by one; equal names meet in one bucket, after each batch has
   settled its own repeats, and all but the first are repeats.
4. Each document's repeats are merged and applied.

Only splitters (bounded by the number of buckets) are held by the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, blocks, materialize, mix64, release_shuffles

LENGTH = 100
GRAM = 20
#: Documents and suffixes that the splitter sample holds at most, and for each bucket where that is more.
SAMPLE_DOCS, DOCS_PER_BUCKET = 3000, 20
SAMPLE_SUFFIXES, SUFFIXES_PER_BUCKET = 60_000, 400
#: Rows of a payload at most: its documents are numbered in 16 bits.
PAYLOAD_ROWS = 60_000
#: Bytes whose names are made at once; a longer document comes in overlapping parts.
BLOCK_BYTES = 1 << 20
#: Segments below which the quicksort hands over to a plain sort.
SMALL = 2048
_BASE = 0x9E3779B97F4A7C15
_NO_ID = -(1 << 63)
_POS_BITS = 28

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * BLOCK_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def _prefix_names(x: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
    return sums


def _names(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed names of the byte strings [start, end); equal strings have equal names wherever they stand."""
    _, down = _powers(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def anchors(x: np.ndarray, doc_ends: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Spans of a run of documents: for each anchor the first string start, number of strings, tokens and side names.

    lefts and rights name the gram with (length - gram) / 2 bytes before or behind it; 0 where the document has fewer.
    """
    empty = {k: np.zeros(0, t) for k, t in (("first", np.int64), ("count", np.int64), ("doc", np.int64), ("grams", np.uint64), ("spans", np.uint64), ("lefts", np.uint16), ("rights", np.uint16))}
    n = len(x)
    if n < length:
        return empty
    doc_starts = np.concatenate([[0], doc_ends[:-1]])
    ok = doc_ends - doc_starts >= length
    if not ok.any():
        return empty
    sums = _prefix_names(x)
    at = np.arange(n - gram + 1)
    _, down = _powers(n + 1)
    names = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    low = np.uint64((1 << _POS_BITS) - 1)
    value = (names & ~low) | at.astype(np.uint64)
    width, m, span = length - gram + 1, value, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    windows = n - length + 1
    if span < width:
        m = np.minimum(m[:windows], m[width - span : width - span + windows])
    anchor = (m[:windows] & low).astype(np.int64)
    edge = np.zeros(windows + 1, np.int32)
    np.add.at(edge, doc_starts[ok], 1)
    np.add.at(edge, doc_ends[ok] - length + 1, -1)
    valid = np.cumsum(edge[:windows]) > 0
    same = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1])
    begins, stops = valid.copy(), valid.copy()
    begins[1:] &= ~same
    stops[:-1] &= ~same
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    a = anchor[first]
    doc = np.searchsorted(doc_ends, first, side="right")
    side = (length - gram) // 2
    has_left, has_right = a - side >= doc_starts[doc], a + gram + side <= doc_ends[doc]
    lefts = _names(sums, np.where(has_left, a - side, a), a + gram)
    rights = _names(sums, a, np.where(has_right, a + gram + side, a + gram))
    short = lambda v, has: np.where(has, (v >> np.uint64(48)).astype(np.uint16) | np.uint16(1), np.uint16(0))
    return {"first": first, "count": last - first + 1, "doc": doc, "grams": names[a], "spans": _names(sums, first, last + length), "lefts": short(lefts, has_left), "rights": short(rights, has_right)}


def _segments(raw: np.ndarray, offs: np.ndarray, length: int):
    """(rows, bytes, ends, shift) of runs of whole documents; a long one comes in parts that overlap by length - 1 bytes."""
    for lo, hi in blocks(offs, BLOCK_BYTES):
        size = int(offs[hi] - offs[lo])
        if hi - lo == 1 and size > 2 * BLOCK_BYTES:
            for s in range(0, size - length + 1, BLOCK_BYTES):
                e = min(size, s + BLOCK_BYTES + length - 1)
                yield lo, hi, raw[offs[lo] + s : offs[lo] + e], np.array([e - s]), s
        else:
            yield lo, hi, raw[offs[lo] : offs[hi]], (offs[lo + 1 : hi + 1] - offs[lo]), 0


def bucket_of(keys: tuple[np.ndarray, ...], splitters: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many splitters are at or below each key, by lexicographic order."""
    left = np.searchsorted(splitters[0], keys[0], side="left")
    right = np.searchsorted(splitters[0], keys[0], side="right")
    out = left.copy()
    tied = np.flatnonzero(right > left)
    for lo in np.unique(left[tied]) if len(tied) else []:
        rows = tied[left[tied] == lo]
        hi = int(right[rows[0]])
        for s in range(int(lo), hi):
            ge, eq = np.zeros(len(rows), bool), np.ones(len(rows), bool)
            for key, split in zip(keys[1:], splitters[1:], strict=True):
                ge |= eq & (key[rows] > split[s])
                eq &= key[rows] == split[s]
            out[rows] += ge | eq
    return out


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their token columns: three-way partition on one token; only equal rows go on to the next."""
    n = len(columns[0])
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == len(columns):
            continue
        rows = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = rows[np.lexsort([c[rows] for c in columns[depth:][::-1]])]
            continue
        tokens = columns[depth][rows]
        pivot = np.sort(tokens[np.linspace(0, hi - lo - 1, 9).astype(np.int64)])[4]
        less, equal = tokens < pivot, tokens == pivot
        a, b = lo + int(less.sum()), lo + int(less.sum()) + int(equal.sum())
        order[lo:hi] = np.concatenate([rows[less], rows[equal], rows[~(less | equal)]])
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


# A suffix in transit: fixed-width columns, one payload for each bucket and batch.
_SUFFIX = [("grams", "<u8"), ("spans", "<u8"), ("doc", "<u2"), ("first", "<u4"), ("count", "<u1"), ("lefts", "<u2"), ("rights", "<u2")]
_NAME = [("high", "<u8"), ("low", "<u4"), ("doc", "<u2"), ("first", "<u4")]
_PAYLOAD = "bucket int, n int, keys binary, body binary"


def _pack(bucket: np.ndarray, table: np.ndarray, columns: dict[str, np.ndarray], layout) -> pa.RecordBatch:
    """One row per bucket; doc columns point into a table of the payload's own document keys."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    keys, bodies = [], []
    for a, b in zip(cuts, ends, strict=True):
        rows = order[a:b]
        used, doc = np.unique(columns["doc"][rows], return_inverse=True)
        keys.append(table[used].tobytes())
        bodies.append(b"".join((doc if name == "doc" else columns[name][rows]).astype(kind).tobytes() for name, kind in layout))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array((ends - cuts), pa.int32()), pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], names=["bucket", "n", "keys", "body"])


def _unpack(batches, layout) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """All payloads of a bucket as columns, with the document keys (id, text name) of each row."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in layout}
    ids, texts = [], []
    for batch in batches:
        for n, keys, body in zip(batch.column("n").to_pylist(), batch.column("keys").to_pylist(), batch.column("body").to_pylist(), strict=True):
            table, at = np.frombuffer(keys, "<i8").reshape(-1, 2), 0
            for name, kind in layout:
                col = np.frombuffer(body, kind, n, at)
                at += col.nbytes
                if name == "doc":
                    ids.append(table[col, 0])
                    texts.append(table[col, 1])
                else:
                    parts[name].append(col)
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return {k: join(v) for k, v in parts.items() if k != "doc"}, join(ids), join(texts)


def _keyed(docs: DataFrame, rest: bool = False) -> DataFrame:
    """(id, name, text): a null doc_id as the least one, a null text as empty; name tells rows of one doc_id apart.

    With rest, the row's columns but its text come along as one struct.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = [F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest")] if rest else []
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("name"), text.alias("text"), *more)


def _spans_of(batch, length: int, gram: int):
    raw, offs = binary_column(batch.column(2))
    keys = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1).astype("<i8")
    for lo, hi, part, ends, shift in _segments(raw, offs, length):
        found = anchors(part, ends, length, gram)
        if len(found["first"]):
            starts = np.concatenate([[0], ends[:-1]])
            found["first"] = found["first"] - starts[found["doc"]] + shift
            yield keys[lo:hi], found


def _sampler(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for keys, s in _spans_of(batch, length, gram):
                pick = np.flatnonzero(mix64(s["spans"] ^ (keys[s["doc"], 0] * 31 + s["first"]).astype(np.uint64)) & np.uint64(7) == 0)
                if len(pick):
                    order = mix64(s["grams"][pick] + s["spans"][pick] * np.uint64(3) + s["first"][pick].astype(np.uint64)).astype(np.int64)
                    cols = [order, s["grams"][pick].astype(np.int64), s["spans"][pick].astype(np.int64), keys[s["doc"][pick], 0], keys[s["doc"][pick], 1], s["first"][pick]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["order", "gram", "span", "id", "name", "first"])

    return run


def _splitters(docs: DataFrame, parts: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    rows, wanted = docs.count(), max(SAMPLE_DOCS, DOCS_PER_BUCKET * parts)
    some = docs if rows <= wanted else docs.sample(fraction=wanted / rows, seed=7)
    sampled = _keyed(some).mapInArrow(_sampler(length, gram), "order long, gram long, span long, id long, name long, first long")
    got = sampled.orderBy("order").limit(max(SAMPLE_SUFFIXES, SUFFIXES_PER_BUCKET * parts)).toArrow()  # of least hash, so from all documents alike
    cols = [got.column(k).to_numpy().astype(np.uint64 if k in ("gram", "span") else np.int64) for k in ("gram", "span", "id", "name", "first")]
    order = multikey_quicksort(cols)
    n = len(order)
    pick = order[np.unique((np.arange(1, parts) * n) // parts)] if n else order
    return tuple(c[pick] for c in cols)


def _sliced(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, PAYLOAD_ROWS):
            yield batch.slice(first, PAYLOAD_ROWS)


def _scatter(splitters: tuple[np.ndarray, ...], length: int, gram: int):
    def run(batches):
        for batch in _sliced(batches):
            keys, parts, before = [], [], 0
            for some, s in _spans_of(batch, length, gram):
                bucket = bucket_of((s["grams"], s["spans"], some[s["doc"], 0], some[s["doc"], 1], s["first"]), splitters)
                parts.append((bucket, {name: (s[name] + before if name == "doc" else s[name].astype(kind)) for name, kind in _SUFFIX}))
                keys.append(some)
                before += len(some)
            if parts:
                yield _pack(np.concatenate([b for b, _ in parts]), np.concatenate(keys), {name: np.concatenate([c[name] for _, c in parts]) for name, _ in _SUFFIX}, _SUFFIX)

    return run


def _runs(order_keys: list[np.ndarray]) -> np.ndarray:
    """True where a sorted row differs from the one before it in any of the columns."""
    new = np.zeros(len(order_keys[0]), bool)
    new[:1] = True
    for c in order_keys:
        new[1:] |= c[1:] != c[:-1]
    return new


def _shared(group: np.ndarray, side: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Which candidate rows have another candidate of the same group and side name (0: none)."""
    out = np.zeros(len(group), bool)
    rows = np.flatnonzero(candidates & (side > 0))
    if len(rows) > 1:
        order = rows[np.lexsort([side[rows], group[rows]])]
        new = _runs([group[order], side[order]])
        sizes = np.bincount(np.cumsum(new) - 1)
        out[order] = sizes[np.cumsum(new) - 1] > 1
    return out


def _bucket_sort(border: np.ndarray):
    """border: grams that stand at some splitter, whose suffixes may go on in other buckets."""

    def run(batches):
        cols, ids, names = _unpack(batches, _SUFFIX)
        if not len(ids):
            return
        order = multikey_quicksort([cols["grams"], cols["spans"], ids, names, cols["first"]])
        c = {k: v[order] for k, v in cols.items()}
        ids, names = ids[order], names[order]
        new = _runs([c["grams"], c["spans"]])
        group = np.cumsum(_runs([c["grams"]])) - 1
        lone = np.bincount(group, weights=new)[group] < 2
        open_ = new & ~lone & (_shared(group, c["lefts"], new) | _shared(group, c["rights"], new))
        open_ |= new & np.isin(c["grams"], border)
        kind = np.where(~new, 1, np.where(open_, 2, 0))
        # the same row twice (one doc_id and text repeated) is one occurrence, not a repeat
        twin = np.zeros(len(ids), bool)
        twin[1:] = ~new[1:] & (ids[1:] == ids[:-1]) & (names[1:] == names[:-1]) & (c["first"][1:] == c["first"][:-1])
        first_copy = np.maximum.accumulate(np.where(twin, 0, np.arange(len(ids))))
        rows = np.flatnonzero((kind[first_copy] > 0) & ~twin)
        for a in range(0, len(rows), 100_000):
            r = rows[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(names[r]), pa.array(kind[r].astype(np.int8)), pa.array(c["first"][r].astype(np.int64) << 8 | c["count"][r])], names=["id", "name", "kind", "span"])

    return run


def _open_strings(buckets: int, length: int):
    """Names of the open spans' strings; repeats within a batch are settled at once, the first ones are dealt by name."""

    def run(batches):
        for batch in _sliced(batches):
            raw, offs = binary_column(batch.column("text"))
            keys = np.stack([batch.column("id").to_numpy(zero_copy_only=False), batch.column("name").to_numpy(zero_copy_only=False)], axis=1).astype("<i8")
            high, low, doc, first = [], [], [], []
            for k, spans in enumerate(batch.column("open").to_pylist()):
                span = np.unique(np.array(spans, np.int64))
                count = span & 255
                starts = np.repeat(span >> 8, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                x = raw[offs[k] : offs[k + 1]]
                for s in range(0, len(x), BLOCK_BYTES):  # a long text's sums are made part by part
                    some = starts[(starts >= s) & (starts < s + BLOCK_BYTES)]
                    if not len(some):
                        continue
                    part = x[s : s + BLOCK_BYTES + length]
                    sums = _prefix_names(part)
                    name = _names(sums, some - s, some - s + length)
                    twice = _prefix_names(np.bitwise_xor(part, np.uint8(0x5A)) * np.uint8(167))
                    high.append(name)
                    low.append((_names(twice, some - s, some - s + length) >> np.uint64(32)).astype(np.uint32))
                    doc.append(np.full(len(some), k))
                    first.append(some)
            if not high:
                continue
            h, w, d, f = (np.concatenate(v) for v in (high, low, doc, first))
            order = np.lexsort([f, keys[d, 1], keys[d, 0], w, h])
            order = order[_runs([h[order], w[order], keys[d[order], 0], keys[d[order], 1], f[order]])]  # a repeated row counts once
            h, w, d, f = h[order], w[order], d[order], f[order]
            new = _runs([h, w])
            known = np.flatnonzero(~new)
            fresh = np.flatnonzero(new)
            if len(known):
                yield _pack(np.full(len(known), -1), keys, {"high": h[known], "low": w[known], "doc": d[known], "first": f[known]}, _NAME)
            fresh = fresh[np.lexsort([f[fresh], d[fresh]])]  # in corpus order places compress better on the way
            yield _pack((h[fresh] % np.uint64(buckets)).astype(np.int64), keys, {"high": h[fresh], "low": w[fresh], "doc": d[fresh], "first": f[fresh]}, _NAME)

    return run


def _starts_to_runs(ids, names, first):
    """Consecutive starts of one document as (id, name, start << 8 | count) with counts up to 255."""
    order = np.lexsort([first, names, ids])
    ids, names, first = ids[order], names[order], first[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (names[1:] != names[:-1]) | (first[1:] > first[:-1] + 1)
    at = np.flatnonzero(new)
    index = np.arange(len(ids))
    place = index - at[np.cumsum(new) - 1]
    new |= place % 255 == 0
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(ids))
    count = first[ends - 1] - first[at] + 1
    return ids[at], names[at], (first[at].astype(np.int64) << 8) | count


def _string_sort(batches):
    """Of equal names all but the first in corpus order; what batches had settled passes through."""
    names_ = ["id", "name", "span"]
    held = []
    for batch in batches:
        known = batch.filter(pa.array(np.asarray(batch.column("bucket")) < 0))
        if known.num_rows:
            cols, ids, texts = _unpack([known], _NAME)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in _starts_to_runs(ids, texts, cols["first"].astype(np.int64))], names=names_)
        held.append(batch.filter(pa.array(np.asarray(batch.column("bucket")) >= 0)))
    cols, ids, texts = _unpack(held, _NAME)
    if not len(ids):
        return
    order = multikey_quicksort([cols["high"], cols["low"], ids, texts, cols["first"]])
    h, w, ids, texts, f = cols["high"][order], cols["low"][order], ids[order], texts[order], cols["first"][order].astype(np.int64)
    once = _runs([h, w, ids, texts, f])  # a repeated row counts once
    rows = np.flatnonzero(~_runs([h, w]) & once)
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in _starts_to_runs(ids[rows], texts[rows], f[rows])], names=names_)


def _sorted_suffixes(docs: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(id, name, kind, span): kind 1 repeats as a whole, kind 2 is open."""
    splitters = _splitters(docs, parts, length, gram)
    dealt = _keyed(docs).mapInArrow(_scatter(splitters, length, gram), _PAYLOAD).repartitionById(max(parts, len(splitters[0]) + 1), F.col("bucket"))
    return materialize(dealt.mapInArrow(_bucket_sort(np.unique(splitters[0])), "id long, name long, kind byte, span long"), "suffixes")


def removed_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, rest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(base, marks): the keyed documents and, per (id, name), its repeated strings as start << 8 | count lists.

    base is dealt by its key once; the open strings' stage and the caller's join share that shuffle.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = _sorted_suffixes(docs, parts, length, gram)
    release_shuffles(spark)
    base = _keyed(docs, rest).repartition(parts, "id", "name")
    open_ = sorted_.where("kind = 2").groupBy("id", "name").agg(F.collect_list("span").alias("open"))
    strings = base.join(open_.hint("shuffle_hash"), ["id", "name"]).select("id", "name", "open", *base.columns[2:]).mapInArrow(_open_strings(parts, length), _PAYLOAD)
    by_name = strings.repartitionById(parts, F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("keys"), F.lit(parts)).cast("int")).otherwise(F.col("bucket")))
    late = by_name.mapInArrow(_string_sort, "id long, name long, span long")
    marks = sorted_.where("kind = 1").select("id", "name", "span").unionByName(late).groupBy("id", "name").agg(F.collect_list("span").alias("spans"))
    return base, marks


def merged(spans, length: int, size: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs [start, end) of a document of size bytes."""
    if spans is None or not len(spans):
        return []
    s = np.asarray(spans, np.int64)
    start, end = s >> 8, (s >> 8) + (s & 255) + length - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    ends = end[np.append(at[1:], len(start)) - 1]
    return list(zip(start[at].tolist(), np.minimum(ends, size).tolist(), strict=True))


def _cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept)


def _joined(docs: DataFrame, length: int, gram: int) -> DataFrame:
    base, marks = removed_ranges(docs, length, gram)
    return base.join(marks.hint("shuffle_hash"), ["id", "name"], "left").select("id", "name", "text", "spans")


def _digest(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                runs = merged(spans, length, len(raw))
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_cut(raw, runs)).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removing every repeated string of `length` bytes.

    Null text: empty. Corpus order is doc_id (null first), then, for rows that share a doc_id, a name of the
    text; rows equal in doc_id and text are one document and get equal results. Texts shorter than `length`
    lose nothing. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    out = _joined(docs, length, gram).mapInArrow(_digest(length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _cleaner(length: int):
    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode() if spans else b""
                texts.append(_cut(raw, merged(spans, length, len(raw))).decode(errors="ignore") if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("rest")], names=["text", "rest"])

    return run


def clean(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with the repeated strings removed from text (a character cut in two goes whole); null texts become empty.

    Corpus order as in digests(): rows equal in doc_id and text are one document and fare alike, a null doc_id is first.
    An empty table gives no rows; columns of any name come along as they are.
    """
    base, marks = removed_ranges(docs, length, gram, rest=True)
    kind = base.schema["rest"].dataType.simpleString()
    out = base.join(marks.hint("shuffle_hash"), ["id", "name"], "left").select("text", "spans", "rest").mapInArrow(_cleaner(length), f"text string, rest {kind}")
    return out.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])
