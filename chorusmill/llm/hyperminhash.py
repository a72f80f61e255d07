"""Near-duplicate documents by HyperMinHash sketches.

A sketch has REGISTERS buckets; a shingle name's top bits choose its bucket, and the bucket keeps its
least remaining name as 6 bits of leading zeros and 10 mantissa bits. A bucket without shingles takes the
register of the first occupied bucket on its own fixed probe path, so two sketches agree in a bucket with
the sets' similarity, whatever their sizes. Bands of registers give candidates; the sketches' agreement,
corrected for chance collisions, drops hopeless ones; the rest are confirmed on the full shingle sets.

Documents with equal shingle sets are one class from the start. In a band's group each class is first
compared with the group's least class only; after the components of those links are known, only classes of
different components are still compared, so a large group of near copies never yields all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, blocks, materialize, mix64, texts_of
from .components import connected_components
from .shingles import shingle_sets

REGISTERS = 256
MANTISSA_BITS = 10
#: Chance, at most, that no band of a pair at the wanted similarity agrees; the widest bands that hold it are taken.
MISS = 5e-5
#: Standard deviations below the wanted similarity at which a sketch estimate drops a pair; sets smaller than
#: SMALL_SET shingles, whose registers repeat, are never dropped by the estimate.
SLACK = 5.0
SMALL_SET = 200
#: Classes of one band, and their shingle names, compared at once; a larger group is cut into chunks and each pair of chunks is a task of its own.
CHUNK = 512
CHUNK_NAMES = 400_000
#: Names per incidence block.
NAME_BLOCK = 8192

_SHIFT = np.uint64(64 - REGISTERS.bit_length() + 1)


def _probe_paths(steps: int) -> np.ndarray:
    at = np.arange(REGISTERS, dtype=np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(steps, dtype=np.uint64)[None, :]
    return (mix64(at + np.uint64(77)) % np.uint64(REGISTERS)).astype(np.int64)


_PATHS = _probe_paths(48)


def sketch(names: np.ndarray) -> np.ndarray:
    """Registers (leading zeros and mantissa of each bucket's least name) of a non-empty set."""
    bucket = (names >> _SHIFT).astype(np.int64)
    rest = names << np.uint64(REGISTERS.bit_length() - 1)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket, rest)
    has = np.zeros(REGISTERS, bool)
    has[bucket] = True
    exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))[1]  # 53 - leading zeros; 0 for zero
    zeros = np.minimum(53 - exponent, 63).astype(np.uint64)
    mantissa = ((least << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    regs = (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    empty = np.flatnonzero(~has)
    if len(empty):
        hit = has[_PATHS[empty]]
        found = hit.any(axis=1)
        source = _PATHS[empty, hit.argmax(axis=1)]
        for k in np.flatnonzero(~found):  # tiny sets: follow the path further
            step = _PATHS.shape[1]
            while True:
                at = mix64(np.arange(step, step + 512, dtype=np.uint64) + np.uint64(int(empty[k]) * 1_000_003 + 77)) % np.uint64(REGISTERS)
                ok = np.flatnonzero(has[at.astype(np.int64)])
                if len(ok):
                    source[k] = int(at[ok[0]])
                    break
                step += 512
        regs[empty] = regs[source]
    return regs


def band_rows(similarity: float) -> int:
    """Registers per band for a similarity."""
    return max(r for r in range(1, 17) if (1 - similarity**r) ** (REGISTERS // r) <= MISS or r == 1)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """(n, REGISTERS // rows) keys of the sketches' bands."""
    bands = REGISTERS // rows
    parts = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k] + np.uint64(1))
    return key


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of n and m shingles agree: equal leading zeros and mantissa by chance."""
    zeros = np.arange(64)
    hi, lo = 2.0**-zeros, 2.0 ** -(zeros + 1)
    a, b = np.maximum(n, 1)[:, None] / REGISTERS, np.maximum(m, 1)[:, None] / REGISTERS
    pa_ = np.power(1 - lo, a) - np.power(np.maximum(1 - hi, 0.0), a)
    pb = np.power(1 - lo, b) - np.power(np.maximum(1 - hi, 0.0), b)
    return (pa_ * pb).sum(axis=1) * 2.0**-MANTISSA_BITS


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of sketch pairs, corrected for chance agreement."""
    agree = (a == b).mean(axis=1)
    c = chance_agreement(n, m)
    return (agree - c) / (1 - c)


def set_names(names: np.ndarray) -> tuple[int, int]:
    """Two order-free names of a shingle set, as signed 64-bit integers."""
    a, b = mix64(names + np.uint64(1)).sum(dtype=np.uint64), mix64(names ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _hopeful(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    want = num / den
    floor = want - SLACK * np.sqrt(want * (1 - want) / REGISTERS)
    return (np.minimum(n, m) * den >= num * np.maximum(n, m)) & ((np.minimum(n, m) < SMALL_SET) | (estimate(a, b, n, m) >= floor))


def _sketches(words: int):
    def run(batches):
        for batch in batches:
            raw, offs = binary_column(batch.column(1))
            ids = batch.column(0)
            for lo, hi in blocks(offs):
                sets = shingle_sets(raw, offs[lo : hi + 1], words)
                sums = np.array([set_names(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([sketch(s).astype("<u2").tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
                )

    return run


def _banded(rows: int):
    def run(batches):
        for batch in batches:
            regs = _sketch_rows(batch.column("sketch"))
            if len(regs):
                keys = band_keys(regs, rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), keys.shape[1]))], names=["key", "rep"])

    return run


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _promising(num: int, den: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ok = _hopeful(_sketch_rows(batch.column("sketch_a")), _sketch_rows(batch.column("sketch_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), num, den)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of incidence blocks over the names that two sets share."""
    every, inverse, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    column = np.full(len(every), -1)
    shared = np.flatnonzero(times > 1)
    column[shared] = np.arange(len(shared))
    column = column[inverse]
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, len(shared), NAME_BLOCK):
        a, b = np.searchsorted(column, [first, first + NAME_BLOCK])
        has = np.zeros((len(left) + len(right), min(NAME_BLOCK, len(shared) - first)), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def _compare_chunks(num: int, den: int):
    """Links between different roots in each (key, i, j) group of sorted rows, confirmed on the full sets.

    Only a forest of links is returned: rows of one root, or joined by earlier links of the group, need no other.
    """

    def links(key, rows):
        left = [r for r in rows if r[2] == key[1]]
        right = left if key[1] == key[2] else [r for r in rows if r[2] == key[2]]
        sets_l = [np.frombuffer(r[3], "<u8") for r in left]
        sets_r = sets_l if right is left else [np.frombuffer(r[3], "<u8") for r in right]
        n, m = np.array([len(s) for s in sets_l]), np.array([len(s) for s in sets_r])
        apart = np.array([r[1] for r in left])[:, None] != np.array([r[1] for r in right])[None, :]
        apart &= np.minimum(n[:, None], m[None, :]) * den >= num * np.maximum(n[:, None], m[None, :])
        if right is left:
            apart &= np.triu(np.ones(apart.shape, bool), 1)
        p, q = np.nonzero(apart)
        if not len(p):
            return
        if len(p) < 64:
            both = np.array([len(np.intersect1d(sets_l[x], sets_r[y], assume_unique=True)) for x, y in zip(p, q, strict=True)])
        else:
            both = _common(sets_l, sets_r)[p, q].astype(np.int64)
        ok = den * both >= num * (n[p] + m[q] - both)
        parent: dict[int, int] = {}

        def find(v):
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        for x, y in zip(p[ok].tolist(), q[ok].tolist(), strict=True):
            a, b = find(left[x][1]), find(right[y][1])
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield left[x][0], right[y][0]

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for k0, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "rep", "root", "chunk", "names")), strict=True):
                if (k0, i, j) != key:
                    if len(rows) > 1:
                        yield from _pair_batch(links(key, rows))
                    key, rows = (k0, i, j), []
                rows.append(row)
        if len(rows) > 1:
            yield from _pair_batch(links(key, rows))

    return run


def _pair_batch(found):
    found = list(found)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])


def _sets(words: int):
    def run(batches):
        for batch in batches:
            raw, offs = binary_column(batch.column("text"))
            for lo, hi in blocks(offs):
                sets = shingle_sets(raw, offs[lo : hi + 1], words)
                mine = [set_names(s)[0] == want for s, want in zip(sets, batch.column("set_a").slice(lo, hi - lo).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(lo, hi - lo), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["rep", "names"]).filter(pa.array(mine, pa.bool_()))

    return run


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("names_a").to_pylist(), batch.column("names_b").to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are den * |intersection| >= num * |union| of word shingle sets.

    Null or empty text, or text without words: no shingles, linked with nothing. Rows with a null doc_id are
    kept under a null component. Rows that share a doc_id are one document: its set is the one of least name,
    and each row is returned with its own n_shingles. An empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    rows = materialize(texts_of(docs).mapInArrow(_sketches(words), "doc_id long, n_shingles long, set_a long, set_b long, sketch binary"), "sketches")
    same = ["set_a", "set_b", "n_shingles"]
    keyed = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*same, "sketch")).alias("x")).select("doc_id", "x.*")
    keyed = materialize(keyed, "sets-by-document")
    classes = materialize(keyed.groupBy(*same).agg(F.min(F.struct("doc_id", "sketch")).alias("x")).select(*same, F.col("x.doc_id").alias("rep"), F.col("x.sketch").alias("sketch")), "classes")
    roots = connected_components(_class_links(docs, classes, num, den, words))
    named = classes.select(*same, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("root", "rep").alias("component"))
    component = keyed.select("doc_id", *same).join(named, same).select("doc_id", "component")
    out = rows.select("doc_id", "n_shingles").join(component, "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _class_links(docs: DataFrame, classes: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """All links (a, b) between classes that can join components: to each band's least class, then across components."""
    bands = classes.select("rep", "sketch").mapInArrow(_banded(band_rows(num / den)), "key long, rep long")
    pivots = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top")).where("pivot < top").select("key", "pivot")
    shared = materialize(bands.join(pivots, "key"), "shared-bands")
    involved = shared.select("rep").distinct().join(classes.select("rep", "set_a"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sets = materialize(texts.join(involved.hint("shuffle_hash"), "rep").mapInArrow(_sets(words), "rep long, names binary"), "sets")
    info = classes.select("rep", "n_shingles", "sketch")

    def confirmed(near: DataFrame) -> DataFrame:
        full = near.join(sets.toDF("a", "names_a"), "a").join(sets.toDF("b", "names_b"), "b").select("a", "b", "names_a", "names_b")
        return full.mapInArrow(_confirm(num, den), "a long, b long")

    tried = shared.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    a, b = info.toDF("a", "n_a", "sketch_a"), info.toDF("b", "n_b", "sketch_b")
    near = tried.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_promising(num, den), "a long, b long")
    first = materialize(confirmed(near), "pivot-links")
    roots = connected_components(first)
    labelled = shared.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    weighed = labelled.join(info.select("rep", "n_shingles"), "rep")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n_shingles") / CHUNK_NAMES)).cast("int")
    mixed = weighed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), chunks.alias("chunks")).where("lo < hi").select("key", "chunks")
    rest = labelled.join(mixed, "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).join(sets, "rep")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = rest.select("key", "rep", "root", "chunk", "names", other.alias("o")).select("key", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "rep", "root", "chunk", "names")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    late = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare_chunks(num, den), "a long, b long")
    return first.unionByName(late)


def keep_first(docs: DataFrame, num: int = 80, den: int = 100, words: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps: one document of each component.

    Rows without text, words or id stay. Rows that share a doc_id stay or go together. Of equally near documents the least
    doc_id stays. An empty table gives no rows; columns of any name come along as they are.
    """
    gone = near_duplicates(docs, num, den, words).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
