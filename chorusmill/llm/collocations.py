"""Phrase collocations from compressed position bitmaps.

Documents of one language form shards of a bounded number of word positions; pieces of a text are one empty position
apart. In a shard each word has a compressed position bitmap: its non-empty blocks of 16 positions. A phrase's bitmap marks
the places of its last word. Shifted by one place and ANDed with the bitmaps of the words in the blocks it touches, it gives
the bitmaps of all longer phrases; their set bits are the shard's count. No bit is set between pieces, so no phrase crosses.
Phrases grow depth-first: a bounded run of a shard's first words goes down to the wanted length before the next one.

Which phrases are frequent only the sum over all shards tells, so there is a round for each length. Shards send the counts
of what they found, dealt into ranges by a hash; the number of ranges follows the corpus. A range sums them, numbers what is
frequent and tells each shard the numbers of its own (all others cannot be part of a longer frequent phrase). A word is
counted by its bytes and a phrase by the numbers of what precedes its last word and of that word, so equal counts are those
of equal phrases. Nothing is held for a whole corpus in one place, and no list of phrases is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, delete_table, materialize, mix64, release_shuffles, tune

#: Positions after which a shard is closed, and those that a task may hold open over all its languages.
SHARD_POSITIONS, OPEN_POSITIONS = 1 << 21, 1 << 22
#: Positions of a bitmap's block.
BLOCK_BITS = 16
#: Bitmap blocks of a run of phrases that go down together; each meets at most BLOCK_BITS blocks of words.
RUN_BLOCKS = 200_000
#: Counts that a range of names sums, on average.
RANGE_COUNTS = 1 << 20
#: Parts into which each language's phrases are dealt before its best are chosen.
BEST_PARTS = 64

_CUT = 0xFF  # no byte of UTF-8; marks the borders of pieces
_CLEAN = bytes(_CUT if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)

SHARDS = "shard long, lang string, n_words long, ids binary, words binary, counts binary"
COUNTS = "span long, shard long, lang string, first binary, last binary, counts binary"
KEPT = "shard long, size int, first binary, last binary, numbers binary, lang string, number long, prefix long, word long, phrase string, f long"


def _packed(values: np.ndarray) -> bytes:
    """Numbers compressed byte place by byte place, as most high bytes are zero."""
    places = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(places.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    places = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(places.reshape(size, n).T).reshape(-1).view(kind)


def _steps(ordered: np.ndarray) -> bytes:
    """Numbers in order, as the steps between them."""
    return _packed(np.diff(ordered, prepend=np.int64(0)))


def _climbed(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.int64))


def _text_packed(text: bytes) -> bytes:
    return pa.compress(text, codec="zstd", asbytes=True) + len(text).to_bytes(8, "little")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; they only deal words out."""
    if not words:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    powers = np.full(int(sizes.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    return mix64(np.add.reduceat(raw * powers[place], starts))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with its sum."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)


def _place(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in known, which is sorted, and whether they are."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


# ---- shards -----------------------------------------------------------------------------------


class _Open:
    """A shard that still grows: word numbers from 1 by first place, 0 between pieces."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {b"\xff": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        """Lower-cased bytes with cuts as _CUT; what is added next is another piece."""
        numbers, at = self.numbers, 0
        while at < len(data):
            end = data.find(b" ", at + BLOCK_BYTES)
            end = len(data) if end < 0 else end
            tokens = data[at:end].replace(b"\xff", b" \xff ").split()
            for token in dict.fromkeys(tokens):
                numbers.setdefault(token, len(numbers))
            ids = np.fromiter(map(numbers.__getitem__, tokens), np.uint32, len(tokens))
            self.parts.append(ids)
            self.size += len(ids)
            at = end
        self.parts.append(np.zeros(1, np.uint32))
        self.size += 1

    def closed(self, limit: int = SHARD_POSITIONS) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(n_words, ids, words, counts) of shards of at most `limit` positions (a longer piece stays whole)."""
        ids, words = np.concatenate(self.parts), list(self.numbers)[1:]
        gaps, at = np.flatnonzero(ids == 0), 0
        while at < len(ids):
            fits = gaps[np.searchsorted(gaps, at) : np.searchsorted(gaps, at + limit)]
            end = len(ids) if at + limit >= len(ids) else int(fits[-1]) + 1 if len(fits) else int(gaps[np.searchsorted(gaps, at)]) + 1
            part = ids[at:end]
            here = np.bincount(part, minlength=len(words) + 1)
            used = np.flatnonzero(here[1:]) + 1
            number = np.zeros(len(words) + 1, np.uint32)
            number[used] = np.arange(1, len(used) + 1)
            if len(used):
                yield int(here[1:].sum()), _packed(number[part]), _text_packed(b" ".join(words[k - 1] for k in used)), _packed(here[used])
            at = end


def _words_of(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[-8:], "little")
    return pa.decompress(data[:-8], decompressed_size=n, codec="zstd", asbytes=True).split(b" ") if n else []


def build_shards(docs: DataFrame, limit: int = SHARD_POSITIONS, held: int = OPEN_POSITIONS) -> DataFrame:
    """Shards of docs' texts by language, of about `limit` positions; a task holds at most `held` of them open. A null language is `und`."""

    def build(batches):
        task, done = TaskContext.get().partitionId(), 0
        pending: dict[str, _Open] = {}

        def close(lang):
            nonlocal done
            for n, ids, words, counts in pending.pop(lang).closed(limit):
                yield pa.RecordBatch.from_pylist([{"shard": task << 24 | done, "lang": lang, "n_words": n, "ids": ids, "words": words, "counts": counts}], schema=layout)
                done += 1

        layout = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("ids", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                pending.setdefault(lang, _Open()).add(b"\xff".join(texts).lower().translate(_CLEAN))
                if pending[lang].size >= limit:
                    yield from close(lang)
            while sum(x.size for x in pending.values()) > held:
                yield from close(max(pending, key=lambda x: pending[x].size))
        for lang in list(pending):
            yield from close(lang)

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(build, SHARDS)


# ---- counts over all shards -------------------------------------------------------------------

_COUNTS_LAYOUT = pa.schema([("span", pa.int64()), ("shard", pa.int64()), ("lang", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("counts", pa.binary())])
_KEPT_LAYOUT = pa.schema(
    [("shard", pa.int64()), ("size", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("numbers", pa.binary()), ("lang", pa.string())]
    + [("number", pa.int64()), ("prefix", pa.int64()), ("word", pa.int64()), ("phrase", pa.string()), ("f", pa.int64())]
)


def _by_span(hashes: np.ndarray, spans: int) -> list[tuple[int, np.ndarray]]:
    """(range, rows) of all ranges that hashes fall into."""
    if not len(hashes):
        return []
    span = ((hashes >> np.uint64(32)) * np.uint64(spans)) >> np.uint64(32)
    order = np.argsort(span, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], span[order][1:] != span[order][:-1]]))
    return [(int(span[order[a]]), order[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True)]


def count_shard_words(shards: DataFrame, spans: int) -> DataFrame:
    """The words of each shard with their counts: first holds their numbers in the shard, last the words."""

    def one(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = _words_of(row["words"]), _unpacked(row["counts"], np.int64)
                rows = []
                for span, at in _by_span(word_hashes(words), spans):
                    rows.append({"span": span, "shard": row["shard"], "lang": row["lang"], "first": _steps(at), "last": _text_packed(b" ".join(words[k] for k in at)), "counts": _packed(counts[at])})
                yield pa.RecordBatch.from_pylist(rows, schema=_COUNTS_LAYOUT)

    return shards.select("shard", "lang", "words", "counts").mapInArrow(one, COUNTS)


def frequent_words(counted: DataFrame, least: int) -> DataFrame:
    """For each shard the numbers of its frequent words, by their numbers in the shard; and a row (lang, number, phrase, f) for each."""

    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total: dict[str, dict[bytes, int]] = {}
        for row in rows:
            row["words"], own = _words_of(row["last"]), total.setdefault(row["lang"], {})
            for word, n in zip(row["words"], _unpacked(row["counts"], np.int64).tolist(), strict=True):
                own[word] = own.get(word, 0) + n
        out, number, base = [], {}, rows[0]["span"] << 32
        for lang in sorted(total):
            for word, n in total[lang].items():
                if n >= least:
                    number[lang, word] = base + len(number)
                    out.append({"lang": lang, "size": 1, "number": number[lang, word], "phrase": word.decode(), "f": n})
        for row in rows:
            known = np.fromiter((number.get((row["lang"], w), -1) for w in row["words"]), np.int64, len(row["words"]))
            live = known >= 0
            if live.any():
                out.append({"shard": row["shard"], "size": 1, "first": _steps(_climbed(row["first"])[live]), "last": _packed(known[:0]), "numbers": _packed(known[live])})
        return pa.Table.from_pylist(out, schema=_KEPT_LAYOUT)

    return counted.select("span", "shard", "lang", "first", "last", "counts").groupBy("span").applyInArrow(one, KEPT)


def frequent_pairs(counted: DataFrame, size: int, least: int) -> DataFrame:
    """As frequent_words for phrases, which are pairs of numbers: what precedes the last word, and that word."""

    def one(table: pa.Table) -> pa.Table:
        rows = table.select(["span", "shard", "first", "last", "counts"]).to_pylist()
        parts = {"first": [_climbed(r["first"]) for r in rows], "last": [_unpacked(r["last"], np.int64) for r in rows], "counts": [_unpacked(r["counts"], np.uint32) for r in rows]}
        first, last, counts = (np.concatenate(parts[c]) for c in ("first", "last", "counts"))
        order = np.lexsort((last, first))
        a, b = first[order], last[order]
        begins = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        total = np.add.reduceat(counts[order].astype(np.int64), begins)
        live = total >= least
        number = np.where(live, (rows[0]["span"] << 32) + np.cumsum(live) - 1, -1)
        each = np.empty(len(first), np.int64)
        each[order] = np.repeat(number, np.diff(np.append(begins, len(order))))
        n, none = int(live.sum()), lambda kind, k: pa.nulls(k, kind)
        told = [none(pa.int64(), n), np.full(n, size, np.int32), *(none(pa.binary(), n) for _ in range(3)), none(pa.string(), n), number[live], a[begins][live], b[begins][live], none(pa.string(), n), total[live]]
        tables, at = [pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in told], schema=_KEPT_LAYOUT)], 0
        kept = []
        for row, own in zip(rows, parts["first"], strict=True):
            part = slice(at, at + len(own))
            at, on = at + len(own), each[part] >= 0
            if on.any():
                kept.append({"shard": row["shard"], "size": size, "first": _steps(own[on]), "last": _packed(last[part][on]), "numbers": _packed(each[part][on])})
        return pa.concat_tables([*tables, pa.Table.from_pylist(kept, schema=_KEPT_LAYOUT)])

    return counted.select("span", "shard", "first", "last", "counts").groupBy("span").applyInArrow(one, KEPT)


def _met(shards: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """Each shard's row together with what goes on in it, of every size."""
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("lang", "string"), ("n_words", "long"), ("ids", "binary"), ("words", "binary"))]
    empty = [F.lit(None).cast("binary").alias(name) for name in ("first", "last", "numbers")]
    rows = shards.select("shard", "lang", "n_words", "ids", "words", F.lit(0).alias("size"), *empty)
    for each in kept:
        rows = rows.unionByName(each.where("shard IS NOT NULL").select("shard", *none, "size", "first", "last", "numbers"))
    return rows


def _shard_of(table: pa.Table) -> tuple[dict, dict[int, list[np.ndarray]]]:
    """The shard's own row; and by size what goes on, as arrays first, last, numbers."""
    own, parts = None, {}
    for row in table.to_pylist():
        if row["size"] == 0:
            own = row
        else:
            parts.setdefault(row["size"], []).append([_climbed(row["first"]), _unpacked(row["last"], np.int64), _unpacked(row["numbers"], np.int64)])
    return own, {size: [np.concatenate(x) for x in zip(*each, strict=True)] for size, each in parts.items()}


def _folded(ids: np.ndarray) -> np.ndarray:
    """A shard's places without words that stand alone between gaps, which are in no phrase, and with one place for each gap."""
    before, after = np.concatenate([[0], ids[:-1]]), np.concatenate([ids[1:], [0]])
    kept = np.where((before == 0) & (after == 0), 0, ids).astype(np.uint32)
    return kept[(kept > 0) | (np.concatenate([[1], kept[:-1]]) > 0)]


def keep_frequent_words(shards: DataFrame, words: DataFrame) -> DataFrame:
    """Shards of frequent words only, whose numbers over all shards replace the words; other words' places become empty."""

    def one(table: pa.Table) -> pa.Table:
        own, parts = _shard_of(table)
        rows = []
        if 1 in parts:
            at, _, number = parts[1]
            ids = _unpacked(own["ids"], np.uint32)
            renamed = np.zeros(int(ids.max()) + 1, np.uint32)
            renamed[at + 1] = np.arange(1, len(at) + 1)
            rows = [{"shard": own["shard"], "lang": own["lang"], "n_words": own["n_words"], "ids": _packed(_folded(renamed[ids])), "words": _packed(number), "counts": b""}]
        layout = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("ids", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
        return pa.Table.from_pylist(rows, schema=layout)

    return _met(shards, [words]).groupBy("shard").applyInArrow(one, SHARDS)


# ---- bitmaps ----------------------------------------------------------------------------------


class Bitmaps:
    """The compressed position bitmaps of a shard's words, numbered from 0: by block, and by word."""

    def __init__(self, ids: np.ndarray, n_words: int):
        places = np.flatnonzero(ids)
        word, block = ids[places].astype(np.int64) - 1, places >> 4
        key = block * n_words + word
        order = np.argsort(key, kind="stable")
        key, bit = key[order], (np.uint32(1) << (places & 15).astype(np.uint32))[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.block, self.word = key[first] // n_words, key[first] % n_words
        self.bits = np.bitwise_or.reduceat(bit, first) if len(key) else bit
        self.starts = np.searchsorted(self.block, np.arange((len(ids) >> 4) + 3))  # a carry may reach one block further
        self.by_word = np.argsort(self.word, kind="stable")

    def runs(self, size: int = RUN_BLOCKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, block, bits) of all words, word by word, a bounded number of blocks at a time."""
        for at in range(0, len(self.by_word), size):
            part = self.by_word[at : at + size]
            yield self.word[part], self.block[part], self.bits[part]

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, word, block, bits) of all phrases one word longer: shift by a place, AND with the words of each block."""
        shifted, carry = (bits << np.uint32(1)) & np.uint32(0xFFFF), bits >> np.uint32(BLOCK_BITS - 1)
        low, high = np.flatnonzero(shifted), np.flatnonzero(carry)
        phrase = np.concatenate([phrase[low], phrase[high]])
        block = np.concatenate([block[low], block[high] + 1])
        bits = np.concatenate([shifted[low], carry[high]])
        start = self.starts[block]
        many = self.starts[block + 1] - start
        row = np.repeat(np.arange(len(block)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + start[row]
        both = bits[row] & self.bits[at]
        live = np.flatnonzero(both)
        row, at = row[live], at[live]
        return phrase[row], self.word[at], block[row], both[live]


class Known:
    """A shard's frequent phrases by size: those of a size are in order of (place of the phrase before the last word, last word)."""

    def __init__(self, words: np.ndarray, parts: dict[int, list[np.ndarray]]):
        self.n, self.numbers, self.keys, self.rest = len(words), {1: words}, {}, {1: np.zeros(len(words), np.int64)}
        order = np.argsort(words)
        before, place = words[order], order
        for size in sorted(s for s in parts if s > 1):
            first, last, number = parts[size]
            key = place[np.searchsorted(before, first)] * self.n + order[np.searchsorted(words[order], last)]
            by_key = np.argsort(key)
            self.keys[size], self.numbers[size] = key[by_key], number[by_key]
            at, word = self.keys[size] // self.n, self.keys[size] % self.n
            # the place of each phrase without its first word
            self.rest[size] = word if size == 2 else self.find(size - 1, self.rest[size - 1][at], word)[0]
            place = np.argsort(self.numbers[size])
            before = self.numbers[size][place]

    def find(self, size: int, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of phrases of a size by the place of what precedes the last word and that word; and whether they are frequent."""
        return _place(at * self.n + word, self.keys.get(size, np.zeros(0, np.int64)))


def _walk(own: dict, parts: dict[int, list[np.ndarray]], size: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth-first over a shard: possible phrases of `size` words as pairs of numbers, with their counts.

    A phrase is possible if it is frequent without its last word, and without its first.
    """
    numbers = _unpacked(own["words"], np.int64)
    maps, known = Bitmaps(_unpacked(own["ids"], np.uint32), len(numbers)), Known(numbers, parts)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, block, bits in maps.runs(run):
        for length in range(2, size + 1):
            at, word, block, bits = maps.extend(at, block, bits)
            if length == size:
                key, count = _summed(at * known.n + word, np.bitwise_count(bits))
                at, word = key // known.n, key % known.n
                live = known.find(size - 1, known.rest[size - 1][at], word)[1] if size > 2 else np.ones(len(key), bool)
                keys.append(key[live])
                counts.append(count[live])
                break
            at, live = known.find(length, at, word)
            at, block, bits = at[live], block[live], bits[live]
            if not len(at):
                break
    key, count = _summed(np.concatenate(keys), np.concatenate(counts))
    return known.numbers.get(size - 1, numbers)[key // max(1, known.n)], numbers[key % max(1, known.n)], count


def grow(shards: DataFrame, kept: list[DataFrame], size: int, spans: int, run: int = RUN_BLOCKS) -> DataFrame:
    """Counts of the possible phrases of `size` words of each shard."""

    def one(table: pa.Table) -> pa.Table:
        own, parts = _shard_of(table)
        first, last, count = _walk(own, parts, size, run) if own is not None and (size == 2 or size - 1 in parts) else (np.zeros(0, np.int64),) * 3
        rows = []
        for span, at in _by_span(mix64(mix64(first.astype(np.uint64)) * _STEP + last.astype(np.uint64)), spans):
            at = at[np.argsort(first[at], kind="stable")]
            rows.append({"span": span, "shard": own["shard"], "first": _steps(first[at]), "last": _packed(last[at]), "counts": _packed(count[at].astype(np.uint32))})
        return pa.Table.from_pylist(rows, schema=_COUNTS_LAYOUT)

    return _met(shards, kept).groupBy("shard").applyInArrow(one, COUNTS)


# ---- phrases ----------------------------------------------------------------------------------


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, shard: int = SHARD_POSITIONS, run: int = RUN_BLOCKS, counts: int = RANGE_COUNTS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f), (lang, n)): all phrases of 1 to `longest` words that occur `least` times or more, and all word counts."""
    tune(docs.sparkSession)
    whole = materialize(build_shards(docs, shard, 2 * shard), "phrase-shards")
    totals = materialize(whole.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-totals")
    spans = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // counts))
    kept = [materialize(frequent_words(count_shard_words(whole, spans), least), "phrase-numbers")]
    shards = materialize(keep_frequent_words(whole, kept[0]), "phrase-shards")
    delete_table(whole)
    for size in range(2, longest + 1):
        kept.append(materialize(frequent_pairs(grow(shards, kept[1:], size, spans, run), size, least), "phrase-numbers"))
        release_shuffles(docs.sparkSession)
    spelled = [kept[0].where("number IS NOT NULL").select("lang", "number", "phrase", "size", "f")]
    words = spelled[0].select(F.col("number").alias("word"), F.col("phrase").alias("last"))
    for each in kept[1:]:
        before = spelled[-1].select("lang", F.col("number").alias("prefix"), F.col("phrase").alias("begun"))
        pairs = each.where("number IS NOT NULL").select("number", "prefix", "word", "size", "f").join(before, "prefix").join(words, "word")
        spelled.append(materialize(pairs.select("lang", "number", F.concat_ws(" ", "begun", "last").alias("phrase"), "size", "f"), "phrases"))
    for table in (*kept[1:], shards):
        delete_table(table)
    every = spelled[0]
    for each in spelled[1:]:
        every = every.unionByName(each)
    return every.drop("number"), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, size, a, l, r, n, score) by their lowest-scoring cut; ties go to the shortest first part."""
    words = F.split("phrase", " ")
    part = lambda start, count: F.array_join(F.slice(words, start, count), " ")
    cut = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("*", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    rows = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"({wide('a * 1000')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    low = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return rows.groupBy("lang", "phrase", "size", "a", "n").agg(low.alias("low")).select("lang", "phrase", "size", "a", "low.l", "low.r", "n", "low.score")


def without_parts(candidates: DataFrame) -> DataFrame:
    """Candidates but for those that a longer one holds each time they occur.

    A longer candidate that is as frequent has parts in between that are as frequent, so parts one word shorter tell all.
    """
    words = F.split("phrase", " ")
    part = lambda start: F.array_join(F.slice(words, F.lit(start), F.col("size") - 1), " ")
    parts = candidates.where("size > 2").select("lang", F.explode(F.array(part(1), part(2))).alias("phrase"), "a")
    return candidates.join(parts, ["lang", "phrase", "a"], "left_anti")


def best(candidates: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's first `most` by score, frequency and phrase, with their rank; parts of a language are cut first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(BEST_PARTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("part")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, **bounds: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-scoring phrases of each language of docs (lang, text).

    Null and empty texts have no words, a null language is `und`. Rows that repeat count as often as they occur, other
    columns are not read, ties go to the lesser phrase. An empty table, or one without frequent phrases, gives no rows. `bounds`
    (shard, run, counts) set the sizes of frequent_phrases, not the result.
    """
    phrases, totals = frequent_phrases(docs, least, longest, **bounds)
    return best(without_parts(scored(phrases, totals)), most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
