"""Token ids of whole texts by a byte-level BPE file of the `tokenizers` library, with a bounded cache of pieces.

The pre-tokenizer's pattern splits a text into pieces and each distinct piece is encoded once; that gives the library's
ids for every text made of characters whose class (letter, number, space, other) no Unicode version has changed. Other
texts are encoded whole by the library itself. Special strings inside a text become their one id, as the library does
by default.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the pre-tokenization pattern of the public byte-level BPE vocabulary.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranges whose character classes are old and stable: Latin, Greek, Cyrillic, Hebrew, Arabic and Devanagari letters,
#: punctuation and symbols, kana, CJK ideographs, Hangul, full-width forms, emoji.
SAFE = [
    (0x00, 0x377), (0x400, 0x523), (0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939), (0x1E00, 0x1F15), (0x2000, 0x2064),
    (0x20A0, 0x20B5), (0x2100, 0x214F), (0x2190, 0x23E7), (0x2500, 0x26FF), (0x3000, 0x3029), (0x3041, 0x3096),
    (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E), (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F),
]
#: Numbers of these ranges that are neither decimal digits nor letters, and white space.
NUMBERS = "".join(chr(c) for a, b in SAFE for c in range(a, b + 1) if chr(c).isnumeric() and not chr(c).isdecimal() and not chr(c).isalpha())
BLANKS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: PIECE for the standard library's faster engine: the same pieces for texts in these ranges, and for ASCII.
FAST = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_{re.escape(NUMBERS)}]+| ?[\d{re.escape(NUMBERS)}]+| ?(?:[^\w{re.escape(BLANKS)}]|_)+|[{re.escape(BLANKS)}]+(?![^{re.escape(BLANKS)}])|[{re.escape(BLANKS)}]+"
)
FAST_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)
UNSAFE = regex.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SAFE) + "]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Vocabulary:
    """A tokenizer file: the library's own tokenizer, and an encoder of single pieces over the same vocabulary."""

    def __init__(self, path: str | None = None):
        path = path or default_path()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_of_symbol()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {bytes(of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.piece = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=self.tokens, special_tokens={})

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(text: str) -> list[str]:
    """The pre-tokenizer's pieces of a text without UNSAFE characters."""
    return (FAST_ASCII if text.isascii() else FAST).findall(text)


class IdEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers. The cache starts anew at `limit` pieces."""

    LONG = 4096

    def __init__(self, path: str | None = None, limit: int = 400_000):
        self.vocabulary, self.limit = Vocabulary(path), limit
        # a plain dictionary: lookups of a subclass with __missing__ take three times as long
        self.cache: dict[str, bytes] = {}
        self.get = self.cache.__getitem__

    def _ids(self, text: str) -> bytes:
        found = pieces(text)
        try:
            return b"".join(map(self.get, found))
        except KeyError:
            pass
        cache, encode = self.cache, self.vocabulary.piece.encode_ordinary
        missing = [p for p in dict.fromkeys(found) if p not in cache]
        if len(cache) + len(missing) > self.limit:
            cache.clear()
            missing = list(dict.fromkeys(found))
        for p in missing:
            cache[p] = np.array(encode(p), "<u4").tobytes()
        out = b"".join(map(self.get, found))
        for p in missing:
            if len(p) > self.LONG:
                del cache[p]
        if len(cache) > self.limit:
            cache.clear()
        return out

    def __call__(self, text: str) -> bytes:
        v = self.vocabulary
        if not text.isascii() and UNSAFE.search(text):
            return np.array(v.library_ids([text])[0], "<u4").tobytes()
        if v.specials is None or not any(s in text for s in v.special):
            return self._ids(text)
        return b"".join(np.array([v.special[part]], "<u4").tobytes() if k % 2 else self._ids(part) for k, part in enumerate(v.specials.split(text)))
