"""Token files in Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector (top bits) and up to 60 bits of payload: selector s packs
COUNTS[s] ids of WIDTHS[s] bits, first id in the lowest bits. Selectors 0 and 1 are runs of 240 and
120 zeros. Selector 15 holds one id of 60 bits; an id that needs more is an escape: selector 15 with
all 60 bits set, followed by a raw word. A block is coded alone, so its offset is all a reader needs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, texts_of

#: Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 60) - 1
#: Ids a block aims at: a reader decodes one block at a time.
BLOCK_IDS = 1 << 17


def encode(ids: np.ndarray) -> bytes:
    """Simple-8b words (little-endian) of unsigned ids; greedy: each word takes the selector that packs most.

    Where a selector's count of ids all fit its width is found for all positions at once, from running counts
    of wider ids; then only the words' start positions are walked.
    """
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if n == 0:
        return b""
    best = np.full(n, 15, np.int64)
    for s in range(14, -1, -1):
        k = int(COUNTS[s])
        if k > n:
            continue
        wide = np.zeros(n + 1, np.int32)
        np.cumsum(ids >= np.uint64(1 << int(WIDTHS[s])), out=wide[1:])
        ok = np.flatnonzero(wide[k:] == wide[:-k])  # no wide id among the next k
        if len(ok) == 0 and s < 14:
            if k > 60 or not (wide[1:] == wide[:-1]).any():
                break  # narrower selectors want more ids that are smaller still
            continue
        best[ok] = s
    take = COUNTS[best].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += take[i]
    starts_a = np.array(starts, dtype=np.int64)
    sel = best[starts_a]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        at = np.flatnonzero(sel == s)
        if WIDTHS[s] == 0:
            continue
        part = ids[starts_a[at][:, None] + np.arange(COUNTS[s])[None, :]]
        if s == 15:
            part = np.minimum(part, np.uint64(ESCAPE))
        shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        words[at] |= np.bitwise_or.reduce(part << shifts[None, :], axis=1)
    escaped = np.flatnonzero((sel == 15) & (ids[starts_a] >= np.uint64(ESCAPE)))
    if len(escaped):
        words = np.insert(words, escaped + 1, ids[starts_a[escaped]])
    return words.astype("<u8").tobytes()


def decode(payload: bytes) -> np.ndarray:
    """Ids of encode(), as uint64: one pass per selector over all of the block's words."""
    words = np.frombuffer(payload, dtype="<u8")
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    body = words & np.uint64(ESCAPE)
    marks = np.flatnonzero(words == np.uint64(0xFFFFFFFFFFFFFFFF))
    raw_of: dict[int, int] = {}
    if len(marks):
        # a raw word may look like an escape; only marks that are not raw words themselves count
        raw = np.zeros(len(words), bool)
        for m in marks.tolist():
            if not raw[m]:
                raw[m + 1] = True
                raw_of[m] = int(words[m + 1])
        keep = ~raw
        index = np.cumsum(keep) - 1
        raw_of = {int(index[m]): v for m, v in raw_of.items()}
        sel, body = sel[keep], body[keep]
    counts = COUNTS[sel]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(sel):
        w = int(WIDTHS[s])
        if w == 0:
            continue
        at = np.flatnonzero(sel == s)
        shifts = (np.arange(COUNTS[s]) * w).astype(np.uint64)
        vals = (body[at][:, None] >> shifts[None, :]) & np.uint64((1 << w) - 1)
        out[starts[at][:, None] + np.arange(COUNTS[s])[None, :]] = vals
    for word, value in raw_of.items():
        out[starts[word]] = value
    return out


#: Stands for a null doc_id in a block; it is the least id, as null is first in order.
NO_ID = -(1 << 63)
_BLOCK = "shard int, block int, first_id long, doc_ids binary, lengths binary, n_ids long, n_words long, payload binary"


def _block_writer(path: str, end_id: int):
    def write(batches):
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        docs: list[int] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        held, first_id = 0, 0
        enc = tokens.encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()

        def block():
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            payload = encode(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first_id], pa.int64()), pa.array([np.array(docs, "<i8").tobytes()], pa.binary()), pa.array([np.array(lengths, "<i8").tobytes()], pa.binary()), pa.array([len(ids)], pa.int64()), pa.array([len(payload) // 8], pa.int64()), pa.array([payload], pa.binary())],
                names=["shard", "block", "first_id", "doc_ids", "lengths", "n_ids", "n_words", "payload"],
            )

        for batch in batches:
            ids_col, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first in range(0, len(texts), 100):
                for doc, ids in zip(ids_col[first : first + 100], enc.encode(texts[first : first + 100]), strict=True):
                    docs.append(NO_ID if doc is None else doc)
                    lengths.append(len(ids) // 4 + 1)
                    parts.append(ids + end)
                    held += lengths[-1]
                    if held >= BLOCK_IDS:
                        yield block()
                        number, first_id = number + 1, first_id + held
                        docs, lengths, parts, held = [], [], [], 0
        if docs:
            yield block()

    return write


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Encode all texts and write Simple-8b blocks in ascending doc_id order; returns the written table.

    One row is one block: shard (files in doc_id order), block (order in the shard), the documents'
    ids and lengths, and the coded words. Null text: empty (only the end id). Rows of one doc_id that
    repeat are each written. An empty table gives an empty file set.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts_of(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(_block_writer(vocabulary, end_id), _BLOCK), "token-files")


def _block_reader(batches):
    for batch in batches:
        for shard_start, docs, lengths, payload in zip(batch.column("first").to_pylist(), batch.column("doc_ids").to_pylist(), batch.column("lengths").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            ids = decode(payload).astype("<u4")
            n = np.frombuffer(lengths, "<i8")
            ends = np.cumsum(n)
            view = memoryview(ids).cast("B")
            crcs = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            keys = np.frombuffer(docs, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == NO_ID), pa.array(shard_start + ends - n), pa.array(n), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document from the written blocks: doc_id, start (ids before it), n_tokens, ids_crc32 of its decoded ids.

    A block knows the ids before it in its shard; those of earlier shards are a running sum over one row
    per file, which is also all that is broadcast.
    """
    from pyspark.sql import Window

    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = sums.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    placed = files.join(F.broadcast(before), "shard").select((F.col("before") + F.col("first_id")).alias("first"), "doc_ids", "lengths", "payload")
    return placed.mapInArrow(_block_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
