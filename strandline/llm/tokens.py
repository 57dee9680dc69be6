"""Token ids of texts, by the tokenizers library, at several million characters a second.

A corpus repeats its words, so ids are kept per pre-token. A pre-token is found with the tokenizer's own pattern and
given to the library's BPE model; the ids of a text are its pre-tokens' ids in order. Where the shortcut could differ
from Tokenizer.encode (special-token strings, letters beyond the blocks that the patterns agree on) the text goes
through Tokenizer.encode itself. tests/llm/test_ops.py holds both ways against each other.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: The pre-token patterns of the two tokenizers, with \p{L} and \p{N} written for Python's re below U+0300.
PATTERNS = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+",
}
#: Information separators (white space for Python only), numerals that are no decimal digits, and all from U+0300 on.
UNSURE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0300-\U0010ffff]|<\\|")
#: The same within Latin-1.
RARE = (b"<|", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xb2", b"\xb3", b"\xb9", b"\xbc", b"\xbd", b"\xbe")


def unsure(text: str) -> bool:
    """Whether UNSURE is found; the few signs are looked up one by one in texts of one byte a letter, which is faster."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return UNSURE.search(text) is not None
    return any(x in data for x in RARE)


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others take the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder(dict):
    """encode(text) gives the ids as little-endian unsigned 16- or 32-bit integers (`kind`)."""

    #: Pre-tokens kept; beyond that the table starts anew.
    KEPT = 400_000

    def __init__(self, path: str, kind: str = "<u4"):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.model, self.letters = self.tokenizer.model, byte_letters()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        split, normal = said["pre_tokenizer"], said.get("normalizer")
        plain = split["type"] == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not normal
        words = split["type"] == "Sequence" and [x["type"] for x in split["pretokenizers"]] == ["Split", "ByteLevel"] and [x["type"] for x in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.lower = words
        self.find = re.compile(PATTERNS["byte" if plain else "word"]).findall if plain or words else None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.KEPT:
            self.clear()
        ids = [x.id for x in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        out = self[piece] = np.array(ids, self.kind).tobytes()
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.find is None or unsure(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.__getitem__, self.find(text.lower() if self.lower else text)))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str = "<u4") -> Encoder:
    """One encoder a Python worker, kept between tasks."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer file is, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
