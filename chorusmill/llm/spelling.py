"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

A word's mask has a bit for each letter that tells whether the letter occurs an odd number of times. An insertion or
deletion flips one bit, a replacement two at most, so of three bands of the mask one at least stays the same. Words meet
where a band and the length class are equal and, so that no band becomes a large group, where the untouched half of the
word is equal as well: one edit leaves either the first half or the rest as it is. Both conditions hold for every pair one
edit apart, so none is lost; a pair counts at the first place where it meets, after a check of its edit distance.

All work is on the distinct words, which built-in functions count; texts are read once and only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete_table, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a mask, and how many bands they are split into; two flips leave one of three bands.
MASK_BITS, BANDS = 48, 3
#: Bits of each band: every third one, so that frequent letters are spread over the bands.
BAND_MASKS = [sum(1 << bit for bit in range(band, MASK_BITS, BANDS)) for band in range(BANDS)]


def marked_words(docs: DataFrame, marker: int = 97, shortest: int = 5) -> DataFrame:
    """(word) for each run of letters of the texts, with the contract's deleted code points; shorter words are left out.

    A null text has no words, a null doc_id counts as an empty string in the checksum.
    """
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    # runs are maximal as the pattern is greedy; shorter ones cannot become words
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % marker == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest)


def count_words(words: DataFrame, least: int = 3) -> DataFrame:
    """(word, n) of words that occur often enough; counts are combined before the shuffle."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def parity_mask(word: Column) -> Column:
    """Bit c % MASK_BITS for each code point c that occurs an odd number of times (code points that share a bit are added up)."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % MASK_BITS)))


def _places(words: DataFrame) -> DataFrame:
    """A row for each place where a word may meet another: length class, half and band.

    The class is the shorter word's length. A word is in its own length's class, and in the class below as the longer one.
    """
    length = F.length("word")
    classes = F.array(F.struct(length.alias("size"), F.lit(False).alias("longer")), F.struct((length - 1).alias("size"), F.lit(True).alias("longer")))
    rows = words.select("word", "n", "mask", F.explode(classes).alias("c")).select("word", "n", "mask", "c.*").where("size > 0")
    first = F.floor(F.col("size") / 2).cast("int")
    halves = [F.substring("word", F.lit(1), first), F.substring("word", F.length("word") - (F.col("size") - first) + 1, F.col("size") - first)]
    slots = [
        F.struct(F.lit(half * BANDS + band).alias("slot"), F.xxhash64("size", halves[half], F.col("mask").bitwiseAND(F.lit(bits))).alias("key"))
        for half in range(2) for band, bits in enumerate(BAND_MASKS)
    ]
    return rows.select("word", "n", "mask", "size", "longer", F.explode(F.array(*slots)).alias("s")).select("word", "n", "mask", "size", "longer", "s.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word_a, n_a, word_b, n_b) for every pair of words of (word, n, mask) exactly one edit apart, once each."""
    places = _places(words)
    a = places.where(~F.col("longer")).select("slot", "key", "size", *(F.col(c).alias(f"{c}_a") for c in ("word", "n", "mask")))
    b = places.select("slot", "key", "longer", *(F.col(c).alias(f"{c}_b") for c in ("word", "n", "mask")))
    met = a.join(b, ["slot", "key"]).where((F.col("longer") | (F.col("word_a") < F.col("word_b"))) & (F.levenshtein("word_a", "word_b", 1) == 1))
    # the first place where two words meet counts: bands before differ, and so do the first halves where the second are compared
    flips = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    differ = [flips.bitwiseAND(F.lit(bits)) != 0 for bits in BAND_MASKS]
    first = F.floor(F.col("size") / 2).cast("int")
    earlier = F.lit(False)
    for band in range(BANDS):
        earlier = earlier | (~differ[band] & (F.col("slot") % BANDS > band))
    same_start = F.substring("word_a", F.lit(1), first) == F.substring("word_b", F.lit(1), first)
    once = ~earlier & ((F.col("slot") < BANDS) | ~same_start)
    # a key is a hash: words may meet by chance where neither half nor band is equal
    real = ~F.element_at(F.array(*differ), F.col("slot") % BANDS + 1) & ((F.col("slot") >= BANDS) | same_start)
    return met.where(once & real).select("word_a", "n_a", "word_b", "n_b")


def variant_groups(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n): each word's more frequent form and the last form of its chain.

    The form is the near word of largest n (ties: the lesser word) if that is twice the word's n at least. Chains double n at
    every step, so they end; roots follow by pointer doubling, a written table for each round. Every word has a row, in an
    empty table there are none.
    """
    words = materialize(words.select("word", "n", parity_mask(F.col("word")).alias("mask")), "spelling-words")
    pairs = near_pairs(words)
    ends = F.array(F.struct(F.col("word_a").alias("word"), F.col("word_b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("word_b").alias("word"), F.col("word_a").alias("near"), F.col("n_a").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.select("word", "n").join(near, "word", "left").select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    taken = F.col("near_n") >= 2 * F.col("n")
    formed = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n")), "spelling-forms")
    delete_table(words)
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word of each chain."""
    table = materialize(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = table.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = table.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = materialize(moved, "spelling-roots")
        if after.where("moved").isEmpty():
            delete_table(table)
            return after.select("word", "root")
        delete_table(table)
        table = after.select("word", "root")


def spelling_variants(docs: DataFrame, marker: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """Variant groups of all words of docs (doc_id, text).

    Nulls and empty texts have no words; rows that repeat count as often as they occur; other columns are not read. An
    empty table gives no rows, words without near words are their own root.
    """
    return variant_groups(count_words(marked_words(docs, marker, shortest), least))
