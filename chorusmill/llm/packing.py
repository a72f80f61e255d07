"""Packing documents into fixed windows by non-negative least squares over length combinations.

A document of n ids gives n // window whole windows and a remainder. Each task packs its remainders:
all pairs and triples of lengths that fill a window exactly are enumerated, their repeat counts x are
fitted by min ||A x - h||, x >= 0 against the histogram h of remainders (image-space multiplicative
updates; the least x are dropped step by step until no more are left than there are lengths), rounded
within the histogram, and fitted anew to what is left while that places any. The last remainders are packed
greedily, longest first, with the best fit; where nothing fits, the longest is cut to close the window. The last partial window is cut into
sequences whose lengths are powers of two, so nothing is padded.

A task needs no ids of others: only the count of its sequences (one row per task) is combined.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, texts_of

#: Ids that a task holds at once; its remainders are packed each time so many have come.
SHARD_IDS = 8_000_000
ITERATIONS = 60
#: Updates before each dropping of combinations.
ROUNDS = 12


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """(k, 3) lengths that sum to window, shortest first, of lengths in present; a 0 stands for 'no third piece'."""
    lengths = np.flatnonzero(present[:window])
    lengths = lengths[lengths > 0]
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    pairs = lengths[(2 * lengths <= window) & has[window - lengths]]
    found = [np.stack([np.zeros_like(pairs), pairs, window - pairs], axis=1)]
    for a in lengths[3 * lengths <= window]:
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[has[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def fit_repeats(combos: np.ndarray, hist: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Non-negative least squares for how often each combination repeats: x <- x * (A'h) / (A'Ax)."""
    h = hist.astype(float).copy()
    h[0] = 0.0
    pull = h[combos].sum(axis=1)
    flat = combos.ravel()
    x = pull / 3 / max(1.0, len(combos) / max(1, np.count_nonzero(h)))
    for _ in range(iterations):
        made = np.bincount(flat, weights=np.repeat(x, 3), minlength=len(h))
        made[0] = 0.0
        x *= pull / np.maximum(made[combos].sum(axis=1), 1e-12)
    return x


def fit_sparse(combos: np.ndarray, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combinations, no more than there are lengths (as many as a basic solution has), and their repeats."""
    most = max(1, np.count_nonzero(hist[1:]))
    x = fit_repeats(combos, hist, ROUNDS)
    while len(combos) > most:
        best = np.sort(np.argsort(-x, kind="stable")[: max(most, len(combos) // 3)])
        combos = combos[best]
        x = fit_repeats(combos, hist, ROUNDS)
    return combos, fit_repeats(combos, hist)


def plan_windows(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of exactly filled windows within hist; counts are rounded and never exceed what is there."""
    left = hist.astype(np.int64).copy()
    plan = []
    while True:
        combos = combinations(window, left > 0)
        if len(combos) == 0:
            return plan
        combos, x = fit_sparse(combos, left)
        before = len(plan)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            parts = [int(v) for v in combos[k] if v]
            need: dict[int, int] = {}
            for v in parts:
                need[v] = need.get(v, 0) + 1
            n = min(int(x[k] + 0.5), *(int(left[v]) // c for v, c in need.items()))
            if n > 0:
                for v, c in need.items():
                    left[v] -= n * c
                plan.append((tuple(parts), n))
        if len(plan) == before:
            return plan


def pack_lengths(lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) pieces for items shorter than window; every id lies in one piece.

    All sequences but the last few are full; those few have lengths that are powers of two.
    """
    hist = np.bincount(lengths, minlength=window + 1)
    order = np.argsort(lengths, kind="stable")
    first = np.concatenate([[0], np.cumsum(hist)])
    pool = {int(v): order[first[v] : first[v + 1]].tolist() for v in np.flatnonzero(hist) if v > 0}
    out = []
    for parts, n in plan_windows(hist, window):
        for _ in range(n):
            out.append([(pool[v].pop(), 0, v) for v in parts])
    left = np.zeros(window + 1, np.int64)
    stock: dict[int, list[tuple[int, int]]] = {}
    for v, items in pool.items():
        if items:
            left[v], stock[v] = len(items), [(i, 0) for i in items]

    def take(v: int) -> tuple[int, int]:
        left[v] -= 1
        return stock[v].pop()

    current: list[tuple[int, int, int]] = []
    gap = window
    remaining = int(left.sum())
    while remaining:
        fits = np.flatnonzero(left[: gap + 1])
        if len(fits):
            v = int(fits[-1])
            item, start = take(v)
            current.append((item, start, v))
            gap -= v
            remaining -= 1
        else:
            v = int(np.flatnonzero(left)[-1])
            item, start = take(v)
            current.append((item, start, gap))
            stock.setdefault(v - gap, []).append((item, start + gap))
            left[v - gap] += 1
            gap = 0
        if gap == 0:
            out.append(current)
            current, gap = [], window
    return out + power_of_two_cuts(current)


def power_of_two_cuts(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut the pieces of one partial window into sequences whose lengths are the powers of two in its binary form."""
    total = sum(p[2] for p in pieces)
    out, queue = [], list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        room = 1 << bit
        if not total & room:
            continue
        row = []
        while room:
            item, start, n = queue.pop()
            k = min(n, room)
            row.append((item, start, k))
            if k < n:
                queue.append((item, start + k, n - k))
            room -= k
        out.append(row)
    return out


_PIECES = "task int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local_sequence long, offset long"


def _packer(path: str, window: int, end_id: int, last_use: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def flush(task, first, docs, coded):
        """Pieces of one shard as an Arrow batch, and how many sequences it made."""
        n = np.array([len(c) // 4 for c in coded], np.int64)
        rows: list[tuple[int, int, int, int, int]] = []
        seq = first
        for k, whole in enumerate((n // window).tolist()):
            for j in range(whole):
                rows.append((k, j * window, window, seq, 0))
                seq += 1
        rest = n % window
        base = n - rest
        for pieces in pack_lengths(rest, window):
            at = 0
            for k, start, size in pieces:
                rows.append((k, int(base[k]) + start, size, seq, at))
                at += size
            seq += 1
        crcs = [zlib.crc32(memoryview(coded[k])[4 * s : 4 * (s + z)]) for k, s, z, _, _ in rows]
        col = np.array(rows, np.int64).reshape(-1, 5)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows), task, np.int32)), pa.array([docs[k] for k in col[:, 0].tolist()], pa.int64()), pa.array(col[:, 1]), pa.array(col[:, 2]), pa.array(crcs, pa.int64()), pa.array(n[col[:, 0]]), pa.array(col[:, 3]), pa.array(col[:, 4])],
            names=["task", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "local_sequence", "offset"],
        )
        return batch, seq

    def run(batches):
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        enc = tokens.encoder(path)
        docs: list[int] = []
        coded: list[bytes] = []
        held = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first in range(0, len(texts), 100):
                for doc, ids in zip(names[first : first + 100], enc.encode(texts[first : first + 100]), strict=True):
                    docs.append(doc)
                    coded.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= SHARD_IDS:
                        out, seq = flush(task, seq, docs, coded)
                        yield out
                        docs, coded, held = [], [], 0
        if docs:
            yield flush(task, seq, docs, coded)[0]
        if last_use:
            enc.cache.clear()

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, last_use: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text: only the end id. Repeated rows are packed each. An empty table gives no pieces.
    Sequence ids have no gaps. Other columns of docs, whatever their names, are not read. With last_use a worker
    drops its chunk cache after each task, as other stages of a pipeline need the memory.
    """
    pieces = materialize(texts_of(docs).mapInArrow(_packer(vocabulary, window, end_id, last_use), _PIECES), "pieces")
    made = pieces.groupBy("task").agg((F.max("local_sequence") + 1).alias("made"))
    before = made.select("task", (F.sum("made").over(Window.orderBy("task")) - F.col("made")).alias("before"))
    return pieces.join(F.broadcast(before), "task").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local_sequence")).alias("sequence_id"), "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """Per sequence: its used length and its pieces in order (at most window pieces, so a bounded list). No pieces: no rows."""
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length"))).alias("pieces"))
