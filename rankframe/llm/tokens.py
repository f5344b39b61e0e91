"""Tokenizer wrappers: exact counts and ids of the public tokenizer files, with bounded caches.

Texts of plain Latin characters are cut into white-space chunks whose ids are cached; every other text,
and every text with a special string, goes to the library whole, so results are the library's own.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from functools import lru_cache

#: Entries a cache may hold; later words are encoded each time (about 200 bytes an entry, 50 MB at most).
CACHE_ENTRIES = 250_000
#: Characters on which Python's and the tokenizer's lower-casing, white space and letter classes agree.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def tokenizer_path(name_or_path: str) -> str:
    """A path as given, or the place of a public tokenizer's file."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _load(name_or_path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name_or_path))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level BPE (a published rule)."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in keep}
    spare = (chr(256 + i) for i in range(256))
    return [letters[b] if b in letters else next(spare) for b in range(256)]


class WordEncoder:
    """Ids of a lower-casing word BPE with word ends, as little-endian 16-bit numbers."""

    def __init__(self, name_or_path: str = "word_bpe_49k.json", entries: int = CACHE_ENTRIES):
        self.library = _load(name_or_path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model, self.letters, self.entries = self.library.model, byte_letters(), entries
        #: Ids of chunks, and of the pieces that chunks are cut into: a piece is a chunk of one piece.
        self.chunks: dict[str, bytes] = {}

    def _kept(self, chunk: str, ids: bytes) -> bytes:
        if len(self.chunks) < self.entries:
            self.chunks[chunk] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.chunks.get(piece)
        if ids is None:
            letters = self.letters
            coded = "".join([letters[b] for b in piece.encode()])
            ids = self._kept(piece, array("H", [t.id for t in self.model.tokenize(coded)]).tobytes())
        return ids

    def _chunk(self, chunk: str) -> bytes:
        pieces = _PIECES.findall(chunk)
        return self._piece(chunk) if len(pieces) == 1 else self._kept(chunk, b"".join([self._piece(p) for p in pieces]))

    def encode(self, text: str) -> bytes:
        if _PLAIN.search(text) or "<|" in text or any(s in text for s in self.special) or not unicodedata.is_normalized("NFC", text):
            return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        known, slow = self.chunks, self._chunk
        chunks = text.lower().split()
        try:
            return b"".join([known[c] if c in known else slow(c) for c in chunks])
        finally:
            del chunks


class ByteCounter:
    """Number of ids of a byte-level BPE.  Plain texts are counted by the same ranks in a faster library."""

    def __init__(self, name_or_path: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken"):
        self.library = _load(name_or_path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(tokenizer_path(ranks), "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.fast is None or _PLAIN.search(text):
            return len(self.library.encode(text, add_special_tokens=False))
        parts = self.cut.split(text)
        return sum(len(self.fast.encode_ordinary(p)) for p in parts if p) + len(parts) - 1


@lru_cache(maxsize=2)
def word_encoder(name_or_path: str) -> WordEncoder:
    return WordEncoder(name_or_path)


@lru_cache(maxsize=2)
def byte_counter(name_or_path: str, ranks: str | None) -> ByteCounter:
    return ByteCounter(name_or_path, ranks)
