"""Token ids of whole texts by a public byte-level BPE, with a bounded cache of white-space-led chunks.

The vocabulary's pre-tokenizer never joins a non-space character with white space after it, and
looks ahead no further than the end of a white-space run; a run of letters also ends before
punctuation. So a text may be cut at those places, the chunks encoded one by one and their ids joined:
the result is that of the whole text. Frequent chunks
are encoded once per worker; the others go to the library together.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: White space as the pre-tokenizer's pattern sees it (fixed values).
SPACES = "\\t\\n\\x0b\\x0c\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters of one pre-token run, and punctuation that always begins another (fixed values; an apostrophe may begin a contraction).
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PUNCTUATION = '.,;:!?*&%$#|)"'
#: Chunks kept per worker before the cache starts anew, and the longest one that is kept.
CACHE_ENTRIES = 1_200_000
CACHE_CHARS = 64
_MISS_BATCH = 1024



def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}


_ENCODERS: dict[str, CachedEncoder] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunk = re.compile(f"[{SPACES}]*[{LETTERS}]+(?=[{PUNCTUATION}])|[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.cache: dict[str, bytes] = {}
        # one run of letters is one pre-token, so it can go to the library's model directly
        form = json.loads(self.tokenizer.to_str())
        before = form.get("pre_tokenizer") or {}
        plain = form.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.single = re.compile(f" ?[{LETTERS}]+") if plain else None
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunks = [self.chunk.findall(t) for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        known, once = self.cache, {}
        wanted = {c for row in chunks for c in row if c not in known}
        self._learn(wanted, once)
        out = []
        for row in chunks:
            try:
                out.append(b"".join(map(known.__getitem__, row)))
            except KeyError:
                out.append(b"".join([known[c] if c in known else once[c] for c in row]))
        # a special token's string in a text is one id here as in the library; it holds no white space, so no cut falls into it
        return out

    def _learn(self, wanted: set[str], once: dict[str, bytes]) -> None:
        queue = []
        for chunk in wanted:
            if self.single is not None and self.single.fullmatch(chunk):
                found = self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))
                (self.cache if len(chunk) <= CACHE_CHARS else once)[chunk] = array("I", [t.id for t in found]).tobytes()
            else:
                queue.append(chunk)
        for first in range(0, len(queue), _MISS_BATCH):
            part = queue[first : first + _MISS_BATCH]
            for chunk, enc in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (self.cache if len(chunk) <= CACHE_CHARS else once)[chunk] = array("I", enc.ids).tobytes()


def encoder(path: str) -> CachedEncoder:
    """The worker's encoder for a vocabulary file; built once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]
