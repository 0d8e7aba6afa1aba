"""Token ids of a public tokenizer, fast enough for whole corpora.

``WordCoder`` is for word-level BPE files whose pre-tokens never cross white space (the
``word_bpe_49k.json`` kind): the ids of a text are those of its white-space-separated chunks
in turn, so the ids of a chunk are computed once and remembered while the memory lasts.
"""

from __future__ import annotations

import struct
import unicodedata

import regex
from tokenizers import Tokenizer

from scholion.llm.common import cached, keep_only

#: Chunks and pre-tokens that a Python worker remembers.
CACHE = 600_000
#: Chunks of these characters need no Unicode rules beyond lower-casing and letter classes.
_PLAIN = regex.compile(r"[!-~À-ɏ]*")
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE files write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordCoder(dict):
    """Maps a chunk (UTF-8 without white space, A-Z lower-cased) to its ids as little-endian
    unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {chr(b): c for b, c in _byte_letters().items()}
        self.pretokens: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = ids = self._encode(chunk.decode("utf-8"))
        return ids

    def _encode(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) is None or "<|" in chunk:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        out = []
        for word in _PRETOKEN.findall(unicodedata.normalize("NFC", chunk).lower()):
            ids = self.pretokens.get(word)
            if ids is None:
                if len(self.pretokens) >= CACHE:
                    self.pretokens.clear()
                written = word if word.isascii() else "".join(self.letters[chr(b)] for b in word.encode())
                ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(written))
                self.pretokens[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, 4 bytes each."""
        raw = text.encode("utf-8", "replace")
        # a letter may compose with a mark (U+0300 to U+036F) in one case only, and composing comes first
        if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.split()))


_coders: dict[str, WordCoder] = {}
cached("tokens", _coders.clear)


def coder(path: str) -> WordCoder:
    """The coder of a vocabulary file, kept by the Python worker between tasks."""
    keep_only("tokens")
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]
