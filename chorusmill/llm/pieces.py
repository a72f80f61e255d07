"""Exact merge-type piece encoding by backtracking, and decoding.

A sequence of pieces is the merge encoding of its text exactly if each two neighbours are compatible:
merging the text of the pair anew gives that pair. The encoder walks the text with the longest piece at
each place (Aho-Corasick), tries shorter prefixes while a neighbour is not compatible, and steps back
otherwise; a bit per text position marks places from which no encoding exists, so none is tried twice.

Texts are cut before each run of space marks (no piece holds a mark after another character) and at
characters outside the vocabulary, which become byte pieces. Frequent chunks are kept per worker.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of

MARK = "▁"
CACHE_ENTRIES = 500_000
CACHE_CHARS = 64

_CODECS: dict[str, PieceCodec] = {}


class PieceCodec:
    """Pieces are numbered by merge order inside (single characters first), so a lower number merges earlier."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ordered = sorted(plain, key=lambda i: (len(names[i]) > 1, -model.get_score(i), i))
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [names[i] for i in ordered]
        self.outer = ordered
        number = {t: k for k, t in enumerate(self.text)}
        self.chars = {t for t in self.text if len(t) == 1}
        self._surface(model, names, size)
        self.pair: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(len(ordered))), list(range(len(ordered)))
        self.known_pairs: dict[tuple[int, int], bool] = {}
        reachable = []
        for k, t in enumerate(self.text):
            if len(t) > 1 and not self._learn_merge(k, t, number):
                continue  # merging its text alone gives other pieces, so no text is encoded with it
            reachable.append(k)
        self.known_pairs.clear()
        self.automaton = ahocorasick.Automaton()
        for k in reachable:
            self.automaton.add_word(self.text[k], (k, len(self.text[k])))
        self.automaton.make_automaton()
        usable = {self.text[k]: k for k in reachable}
        self.shorter = [next((usable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), -1) for t in self.text]
        cut_marks = all(MARK not in t.lstrip(MARK) for t in self.text)
        breaks = "".join(c for c in "\n\t\r" if c not in self.chars)
        self.chunk = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+|[{breaks}]+" if breaks else f"{MARK}*[^{MARK}]+|{MARK}+") if cut_marks else None
        self.cache: dict[str, bytes] = {}

    def _surface(self, model, names: list[str], size: int) -> None:
        self.bytes_of = [n.replace(MARK, " ").encode() for n in names]
        for i in range(size):
            if model.is_control(i):
                self.bytes_of[i] = b""
            elif model.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.is_byte = [False] * size
        for i in self.byte_ids:
            self.is_byte[i] = True
        self.control = {i for i in range(size) if model.is_control(i)}

    def _learn_merge(self, k: int, t: str, number: dict[str, int]) -> bool:
        for n in range(1, len(t)):
            a, b = number.get(t[:n]), number.get(t[n:])
            if a is not None and b is not None and a < k and b < k and self._made(a) and self._made(b) and self._compatible(a, b):
                self.left[k], self.right[k] = a, b
                self.pair[(a, b)] = k
                self.known_pairs.clear()
                return True
        return False

    def _made(self, k: int) -> bool:
        return len(self.text[k]) == 1 or self.left[k] != k

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.known_pairs.get(key)
        if known is None:
            if len(self.known_pairs) > 2_000_000:
                self.known_pairs.clear()
            known = self.known_pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Undo the two pieces' merges, latest first; no merge across the border may come before those undone.

        bound: merges numbered below it happen before the state reached; at equal number the left place wins.
        """
        bound = 1 << 60
        while True:
            joined = self.pair.get((a, b))
            if joined is not None and joined < bound:
                return False
            single_a, single_b = self.right[a] == a, self.left[b] == b
            if single_a and single_b:
                return True
            if not single_a and (single_b or a > b):
                bound, a = a, self.right[a]
            else:
                bound, b = b + 1, self.left[b]

    def _encode_known(self, chunk: str) -> list[int]:
        """Backtracking over a text whose characters are all in the vocabulary."""
        n = len(chunk)
        longest = [-1] * n
        for end, (k, size) in self.automaton.iter(chunk):
            longest[end - size + 1] = k  # ends ascend, so the longest stays
        failed = bytearray((n >> 3) + 1)
        text, shorter, compatible = self.text, self.shorter, self.compatible
        out: list[int] = []
        at, k = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while k >= 0:
                end = at + len(text[k])
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or compatible(last, k)):
                    break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at = end
                if at == n:
                    return out
                k = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no encoding")
                k = out.pop()
                at -= len(text[k])
                # its end is marked now, so a shorter one is tried

    def _encode_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        outer, chars = self.outer, self.chars
        if chars.issuperset(chunk):
            ids = [outer[k] for k in self._encode_known(chunk)]
        else:
            run: list[str] = []
            for c in chunk:
                if c in chars:
                    run.append(c)
                    continue
                if run:
                    ids += [outer[k] for k in self._encode_known("".join(run))]
                    run = []
                ids += [self.byte_ids[b] for b in c.encode()]
            if run:
                ids += [outer[k] for k in self._encode_known("".join(run))]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids between begin and end ids, as little-endian unsigned 32-bit integers."""
        edge = np.array([self.bos, self.eos], dtype="<u4").tobytes()
        if not text:
            return edge
        marked = MARK + text.replace(" ", MARK)
        chunks = self.chunk.findall(marked) if self.chunk else [marked]
        cache = self.cache
        try:
            body = b"".join(map(cache.__getitem__, chunks))
        except KeyError:
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            parts = []
            for c in chunks:
                ids = cache.get(c)
                if ids is None:
                    ids = self._encode_chunk(c)
                    if len(c) <= CACHE_CHARS:
                        cache[c] = ids
                parts.append(ids)
            body = b"".join(parts)
        return edge[:4] + body + edge[4:]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the first one goes, byte pieces are joined; ill-formed bytes give U+FFFD each."""
        first = next((i for i in ids if i not in self.control), None)
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            out = raw.decode()
        except UnicodeDecodeError:
            out = "".join(self._decode_runs(ids))
        return out[1:] if first is not None and out[:1] == " " and not self.is_byte[first] else out

    def _decode_runs(self, ids: list[int]):
        run = b""
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.bytes_of[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        yield run[:n].decode()
                    except UnicodeDecodeError:
                        continue
                    run = run[n:]
                    break
                else:
                    yield "�"
                    run = run[1:]
            if i >= 0:
                yield self.bytes_of[i].decode()


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _digests(path: str):
    def run(batches):
        c = codec(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches):
        c = codec(path)
        for batch in batches:
            coded = [c.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches):
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (with begin and end ids). Null text: empty, so just those two ids. No shuffle; rows that repeat stay."""
    return texts_of(docs).mapInArrow(_ids(model), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(model), "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded in one pass.

    Null or empty text: the two edge ids and the empty text. An empty table gives no rows; repeated rows
    stay; other columns, whatever their names, are not read.
    """
    return texts_of(docs).mapInArrow(_digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
