"""Near-duplicate embeddings by spherical-cap filters with structured random product codes.

Filter directions are products of random codebooks over the two halves of a rotated space, for CODES
independent rotations. A vector belongs to every filter whose direction it exceeds by a threshold (and to
its LEAST best ones of each code, so that none stays without); the list decoder finds them by merging the
sorted inner products of the halves, without going through the product. Vectors of one label meet in the filters they share
and are verified there in double precision. A pair counts in its first common filter only, so a filter
returns each vector's number of links and a spanning forest instead of pairs.

The code grows with a label's number of distinct vectors: the threshold is the one at which a filter holds LOAD
vectors by chance, so chance meetings per vector stay the same at any size, and the number of filters per vector
follows from the chance that a pair at the wanted cosine shares one, so recall does, too. In few dimensions the
threshold stops where that chance falls below LEAST_SHARE.

Equal vectors of a label are one class with a count, so copies never meet. A filter's group larger than
CHUNK is cut into chunks, and each pair of chunks is a task of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune
from .components import connected_components

CODES = 4
LEAST = 10
#: Vectors that a filter holds by chance, and the size from which a label's code grows.
LOAD, LEAST_SIZE = 0.1, 1024
#: Least chance that a pair at the wanted cosine shares a filter; how often a pair may share none if filters were
#: independent; and by how much more filters a vector has, as those of a product code are not.
LEAST_SHARE, MISS, DEPENDENT = 0.2, 1e-6, 3.0
#: Bytes of a worker's codebooks for one dimension and size; a code that needs more keeps a lower threshold instead.
BOOK_BYTES = 256 << 20
CHUNK = 512
#: Groups up to this size are first compared all at once, as most meet by chance.
SMALL_GROUP = 16
#: Rows of the lists of large labels and filter groups up to which they are broadcast; beyond that they are joined by shuffle.
BROADCAST_ROWS = 50_000

_CODES: dict[tuple, tuple] = {}


def _tail(dim: int, grid: np.ndarray) -> np.ndarray:
    """Share of random directions whose inner product with a unit vector is at least each (rising) grid value."""
    weight = np.power(np.maximum(1 - grid * grid, 0), (dim - 3) / 2) if dim > 2 else 1 / np.sqrt(np.maximum(1 - grid * grid, 1e-9))
    return np.cumsum(weight[::-1])[::-1] / weight.sum()


def share_chance(dim: int, cap: float, cosine: float) -> float:
    """Chance that a direction that exceeds cap for one vector does so for another one at that cosine."""
    grid = np.linspace(-1, 1, 20_001)
    weight = -np.diff(_tail(dim, grid), append=0.0)
    at = np.flatnonzero(grid >= cap)
    rest = _tail(max(2, dim - 1), grid)
    reach = (cap - cosine * grid[at]) / np.maximum(math.sqrt(1 - cosine * cosine) * np.sqrt(np.maximum(1 - grid[at] ** 2, 0)), 1e-9)
    inside = np.interp(np.clip(reach, -1, 1), grid, rest) * (reach <= 1)
    return float((weight[at] * inside).sum() / max(weight[at].sum(), 1e-300))


def plan(dim: int, size: int, cosine: float) -> tuple[float, int]:
    """(threshold, filters of each half's codebook) for labels of up to `size` vectors."""
    grid = np.linspace(-1, 1, 400_001)
    tail = _tail(dim, grid)
    cap = float(grid[max(0, int(np.searchsorted(-tail, -LOAD / size)) - 1)])
    cap = max(0.0, min(cap, 0.95))
    while cap > 0 and share_chance(dim, cap, cosine) < LEAST_SHARE:
        cap -= 0.01
    while True:
        chance = min(share_chance(dim, cap, cosine), 0.999)
        wanted = DEPENDENT * math.log(MISS) / math.log(1 - chance)
        count = max(LEAST, math.ceil(math.sqrt(wanted / CODES / max(float(np.interp(cap, grid, tail)), 1e-15))))
        if count * dim * CODES * 4 <= BOOK_BYTES or cap <= 0:
            return cap, count
        cap = max(0.0, cap - 0.01)


def _codes(dim: int, size: int, cosine: float):
    """(rotations, codebooks of both halves, threshold) for a dimension and size; fixed by a seed, so every worker has the same."""
    key = (dim, size, cosine)
    if key not in _CODES:
        rng = np.random.default_rng(20240607 + dim)
        cap, count = plan(dim, size, cosine)
        half = max(1, dim // 2)
        codes = []
        for _ in range(CODES):
            rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
            books = []
            for a, b in ((0, half), (half, dim)):
                c = rng.standard_normal((count, b - a))
                books.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) * math.sqrt((b - a) / dim))
                books[-1] = books[-1].astype(np.float32)
            codes.append((rotation, half, *books))
        _CODES[key] = (codes, cap)
    return _CODES[key]


def _listed(head: np.ndarray, tail: np.ndarray, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose products' sum is at least cap, or the floor below it that gives LEAST pairs."""
    floor = cap
    while True:
        rows = np.flatnonzero(head >= floor - tail.max())
        cols = np.flatnonzero(tail >= floor - head.max())
        cols = cols[np.argsort(-tail[cols], kind="stable")]
        reach = np.searchsorted(-tail[cols], head[rows] - floor, side="right")  # tails t with head + t >= floor
        if reach.sum() >= LEAST or floor < -1:
            break
        floor -= 0.02
    within = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
    return np.repeat(rows, reach), cols[within]


def decode(vectors: np.ndarray, size: int = LEAST_SIZE, cosine: float = 0.93) -> list[np.ndarray]:
    """Sorted filter numbers of each unit vector: all it exceeds by the threshold, at least LEAST of each code."""
    n, dim = vectors.shape
    codes, cap = _codes(dim, size, cosine)
    out: list[list[np.ndarray]] = [[] for _ in range(n)]
    for number, (rotation, half, head_book, tail_book) in enumerate(codes):
        x = (vectors @ rotation).astype(np.float32)
        head, tail = x[:, :half] @ head_book.T, x[:, half:] @ tail_book.T
        count = head.shape[1]
        for k in range(n):
            rows, cols = _listed(head[k], tail[k], cap)
            out[k].append((number * count + rows) * count + cols)
    return [np.sort(np.concatenate(parts)) for parts in out]


def _bytes(vector: list[float]) -> bytes:
    """The components as 32-bit floats if that loses nothing, else as 64-bit ones; scaled where squares would overflow or vanish."""
    x = np.array(vector, np.float64)
    top = np.abs(x).max()
    if not 1e-100 < top < 1e100:
        x = x / top
    small = x.astype("<f4")
    return small.tobytes() if np.array_equal(small.astype(np.float64), x) else x.astype("<f8").tobytes()


def _vector(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * dim else "<f8").astype(np.float64)


def _decoder(cosine: float):
    def run(batches):
        for batch in batches:
            rows = batch.column("vector").to_pylist()
            raw = [_bytes(r) for r in rows]
            found: list = [None] * len(rows)
            dims = np.array([len(r) for r in rows])
            kinds = np.stack([dims, batch.column("size").to_numpy(zero_copy_only=False)], axis=1)
            for dim, size in np.unique(kinds, axis=0).tolist():
                at = np.flatnonzero((kinds == (dim, size)).all(axis=1))
                x = np.stack([_vector(raw[k], dim) for k in at])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                step = max(1, min(250, (8 << 20) // _codes(dim, size, cosine)[0][0][2].shape[0]))  # inner products held at once
                for a in range(0, len(at), step):
                    for k, f in zip(at[a : a + step], decode(x[a : a + step], size, cosine), strict=True):
                        found[k] = f
            fields = [batch.column("label"), batch.column("rep"), batch.column("copies"), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(fields, names=["label", "rep", "copies", "dim", "vector", "filters"])

    return run


def _sized(classes: DataFrame) -> DataFrame:
    """classes with the size class of their label and length: the power of two from its number of distinct vectors.

    Labels up to LEAST_SIZE share one. The list of larger ones is broadcast if it is short; a longer one meets the
    vectors by label and a salt, so that a label with a third of all vectors is spread.
    """
    keyed = classes.withColumn("dim", F.size("vector"))
    large = keyed.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_SIZE)
    power = F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("long")
    large = materialize(large.select("label", "dim", power.alias("size")), "sizes")
    if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = keyed.join(F.broadcast(large), ["label", "dim"], "left")
    else:
        salts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = keyed.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")).join(spread, ["label", "dim", "salt"], "left").drop("salt")
    return out.withColumn("size", F.coalesce("size", F.lit(LEAST_SIZE).cast("long")))


def _first_common(a: np.ndarray, b: np.ndarray, here: int) -> bool:
    both = np.intersect1d(a, b, assume_unique=True)
    return bool(len(both)) and int(both[0]) == here


def _group_links(here: int, ids, copies, vectors, filters, chunk, i, j, limit: float):
    """(links per row, forest edges) of one group: pairs at or above limit whose first common filter this is."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    left = np.flatnonzero(chunk == i)
    right = left if i == j else np.flatnonzero(chunk == j)
    cos = (vectors[left] @ vectors[right].T) / (norms[left][:, None] * norms[right][None, :])
    ok = cos >= limit
    if i == j:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    p, q = np.nonzero(ok)
    links = np.zeros(len(ids), np.int64)
    parent = list(range(len(ids)))

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    if len(p) > 256:
        early = [f[f < here] for f in filters]
        seen, inverse = np.unique(np.concatenate(early), return_inverse=True) if any(len(f) for f in early) else (np.zeros(0), np.zeros(0, np.int64))
        has = np.zeros((len(ids), max(1, len(seen))), np.float32)
        has[np.repeat(np.arange(len(ids)), [len(f) for f in early]), inverse] = 1
        shared = has[left] @ has[right].T
        first = shared[p, q] == 0
    else:
        first = np.array([_first_common(filters[left[a]], filters[right[b]], here) for a, b in zip(p, q, strict=True)], bool)
    np.add.at(links, left[p[first]], copies[right[q[first]]])
    np.add.at(links, right[q[first]], copies[left[p[first]]])
    edges = []
    for a, b in zip(left[p].tolist(), right[q].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[y] = x
            edges.append((ids[x], ids[y]))
    return links, edges


_FOUND = "a long, b long, links long"


def _linked_groups(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray, limit: float) -> np.ndarray:
    """Which groups of a batch may hold a link: small ones are compared all at once, large ones always may."""
    raw = batch.column("vector").to_pylist()
    sizes = ends - starts
    if len({len(r) for r in raw}) > 1 or len(set(batch.column("dim").to_pylist())) > 1:
        return sizes > 1
    x = _vector(b"".join(raw), len(raw) * batch.column("dim")[0].as_py()).reshape(len(raw), -1)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    may = sizes > SMALL_GROUP
    group = np.repeat(np.arange(len(starts)), sizes)
    for step in range(1, int(min(SMALL_GROUP, sizes.max()))):
        rows = np.flatnonzero(group[step:] == group[:-step])
        rows = rows[~may[group[rows]]]
        near = np.einsum("ij,ij->i", x[rows], x[rows + step]) >= limit - 1e-9
        may[group[rows[near]]] = True
    return may


def _verified(limit: float):
    """Groups arrive sorted by (label, dim, filter, i, j); rows with b null carry link counts, the others are forest edges."""

    def finish(rows: pa.RecordBatch):
        one = lambda c: rows.column(c)[0].as_py()
        ids = rows.column("rep").to_pylist()
        vectors = np.stack([_vector(r, one("dim")) for r in rows.column("vector").to_pylist()])
        filters = [np.array(f, np.int64) for f in rows.column("filters").to_pylist()]
        links, edges = _group_links(one("filter"), ids, rows.column("copies").to_numpy(), vectors, filters, rows.column("chunk").to_numpy(), one("i"), one("j"), limit)
        found = [(ids[k], None, int(links[k])) for k in np.flatnonzero(links)] + [(a, b, 0) for a, b in edges]
        if found:
            a, b, n = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "links"])

    def groups(batch: pa.RecordBatch):
        new = np.ones(batch.num_rows, bool)
        new[1:] = False
        for c in ("label", "dim", "filter", "i", "j"):
            col = batch.column(c)
            v = (col.dictionary_encode().indices if c == "label" else col).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def settle(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray):
        if len(starts):
            whole = batch.slice(0, int(ends[-1]))
            for k in np.flatnonzero(_linked_groups(whole, starts, ends, limit)):
                yield from finish(batch.slice(int(starts[k]), int(ends[k] - starts[k])))

    def run(batches):
        held = None  # the group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            starts = groups(batch)
            yield from settle(batch, starts[:-1], starts[1:])
            held = batch.slice(int(starts[-1]))
        if held is not None:
            yield from settle(held, np.zeros(1, np.int64), np.array([held.num_rows]))

    return run


def near_duplicates(vectors: DataFrame, limit: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of (vec_id, embedding, label): links need equal labels and cosine >= limit.

    Null labels, null or empty vectors, null or non-finite components and zero vectors link with nothing:
    n_links 0, their own component. Vectors of different lengths never link. A cosine of exactly the limit links. Rows that share a vec_id are
    one node of the components, with the links of all of them. A null vec_id is kept under a null component. An empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    usable = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    keyed = materialize(usable.withColumns({"digest": F.xxhash64("vector"), "mirror": F.xxhash64(F.reverse("vector"))}), "vectors")
    same = ["label", "digest", "mirror"]
    classes = keyed.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("vector").alias("vector"))
    sized = _sized(materialize(classes.select("label", "rep", "copies", "vector"), "distinct-vectors")).select("label", "rep", "copies", "vector", "size")
    decoded = materialize(sized.mapInArrow(_decoder(limit), "label string, rep long, copies long, dim int, vector binary, filters array<long>"), "filters")
    light = decoded.select("label", "dim", F.explode("filters").alias("filter"), "rep")
    group = ["label", "dim", "filter"]
    groups = materialize(light.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1"), "groups")
    large = groups.where(F.col("n") > CHUNK).select(*group, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    few = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = light.join(groups.select(*group), group).groupBy("label", "rep").agg(F.array_sort(F.collect_list("filter")).alias("filters"))
    held = met.join(decoded.select("label", "rep", "dim", "copies", "vector"), ["label", "rep"])
    spread = held.select("label", "dim", F.explode("filters").alias("filter"), "rep", "copies", "vector", "filters")
    cut = spread.join(F.broadcast(large) if few else large, group, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = cut.withColumns({"i": F.least("chunk", "o"), "j": F.greatest("chunk", "o")}).drop("o", "chunks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(dealt.repartition(parts, "label", "dim", "filter", "i", "j").sortWithinPartitions("label", "dim", "filter", "i", "j").mapInArrow(_verified(limit), _FOUND), "found")
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.select(*same, "rep", "copies").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(*same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    known = keyed.select("vec_id", *same).join(named, same).select("vec_id", "n_links", "component")
    rest = rows.where(~(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    out = known.unionByName(rest)
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"))
