"""Token ids of whole texts by a published vocabulary, with caches of pieces between certain cuts.

A cut before a run of white space that follows other characters is certain for both supported vocabularies, as is one
between a letter or digit and a full stop or comma, and one on either side of a sole line end: their pre-tokenizers never
let a token reach over it. So a text is split there, each piece is encoded by itself, and the ids are joined. Pieces
recur, so their ids are cached; a cache holds a bounded number of bytes and is emptied when full, which changes the time
taken and never a result.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable
from struct import Struct

from tokenizers import Tokenizer

#: Unicode White_Space, as the pre-tokenizers' \s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Characters that some libraries count as white space and others do not: such texts are encoded whole.
_UNSURE = re.compile("[\\x1c-\\x1f\\u180e\\u200b\\ufeff]")
_LATIN = re.compile("[A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0132-\\u017f]+")
#: Where a cut before a full stop, comma or line end, or after a line end, isn't certain.
_TIGHT = re.compile(r"[.,](?<![^\W_][.,])|\n(?:\s|(?<=\s\n))")
#: The same where texts are normalised first: letters beyond these may end in a mark then.
_TIGHT_LATIN = re.compile(r"[.,](?<![0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017f][.,])|\n(?:\s|(?<=\s\n))")
#: Marks that end a run of letters and are one pre-token, up to the end of the piece. No apostrophe: some begin tokens.
_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+")


class _Uncut(Exception):
    """A piece whose borders are not certain cuts."""


class _Cache(dict):
    """piece -> little-endian unsigned 32-bit ids; entries that a whole generation has not used are forgotten.

    A generation holds about ``most`` bytes: a short entry counts as ``COST``, a longer one by its length as well, and
    very long pieces are not kept.
    """

    SHORT, LONG, COST = 24, 256, 240

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, most // self.COST, {}
        self.left = self.limit

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece)
            if len(piece) > self.SHORT:
                if len(piece) > self.LONG:
                    return found
                self.left -= 8 * len(piece) // self.COST
        if len(self) >= self.left:
            self.old, self.left = dict(self), self.limit
            self.clear()
        self[piece] = found
        return found


def packed(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    if sys.byteorder == "little":
        return array("I", ids).tobytes()
    out = array("I", ids)
    out.byteswap()
    return out.tobytes()


_PACK = [Struct(f"<{n}I").pack for n in range(32)]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class Encoder:
    """``encode(text)`` gives ``Tokenizer.encode(text, add_special_tokens=False).ids`` as little-endian 32-bit bytes.

    Truncation and padding are off. Null and empty texts have no ids. ``word`` and ``piece`` replace the library
    for a run of letters and for any other piece.
    """

    def __init__(self, path: str, cache: int = 56 << 20, word: Callable[[str], bytes] | None = None, piece: Callable[[str], bytes] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = spec.get("pre_tokenizer") or {}
        self.keeps_space = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"[\s.,]", x["content"]) for x in spec["added_tokens"])
        drops = pre.get("type") == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"]
        drops = drops and pre["pretokenizers"][0]["behavior"] == "Removed" and not pre["pretokenizers"][1]["use_regex"]
        self.cuts = plain and bool(self.keeps_space or drops)
        self.tight = (_TIGHT if self.keeps_space else _TIGHT_LATIN).search
        self.bytes_to_chars = byte_chars()
        self.space = self.bytes_to_chars[32]
        self.tokenize = self.tokenizer.model.tokenize
        self.word = word or self.library_word
        self.one = piece or self.library
        self.cache = _Cache(self.spaced if self.keeps_space and not word else self.part, cache)

    def library(self, piece: str) -> bytes:
        return packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def library_word(self, word: str) -> bytes:
        """A run of letters, with a space before it at most, is one pre-token: it goes to the model straight away."""
        if word.isascii():
            chars = word if word[0] != " " else self.space + word[1:]
        else:
            chars = "".join(map(self.bytes_to_chars.__getitem__, word.encode()))
        ids = [x.id for x in self.tokenize(chars)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else packed(ids)

    def spaced(self, piece: str) -> bytes:
        """``part`` with a shorter way for the most frequent kind: a space and letters."""
        if piece[1:].isalpha() and piece[0] == " " and piece.isascii():
            ids = [x.id for x in self.tokenize(self.space + piece[1:])]
            if len(ids) < len(_PACK):
                return _PACK[len(ids)](*ids)
        return self.part(piece)

    def part(self, piece: str) -> bytes:
        """Pre-tokens of a piece are encoded by themselves where they are plain to see: letters, and marks after them."""
        if self.keeps_space and (piece[:1] == " " and piece[1:].isalpha() or piece.isalpha()):
            return self.word(piece)
        if not piece:
            return b""
        if piece[-1].isspace():
            if piece != "\n":
                raise _Uncut
            return self.one(piece) if self.keeps_space else b""
        letters = piece[1:] if piece[0] == " " else piece
        if letters.isalpha():
            if _LATIN.fullmatch(letters):  # other letters may change in number when lower-cased
                return self.word(letters.lower())
        elif not letters[-1].isalnum():
            bare = letters.rstrip("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
            if bare.isalpha() and (self.keeps_space or _LATIN.fullmatch(bare)) and _MARKS.fullmatch(letters, len(bare)):
                return self.cache[piece[: len(piece) - len(letters) + len(bare)]] + self.cache[letters[len(bare) :]]
        return self.one(piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts:
            return self.one(text)
        try:
            if "\0" not in text and not self.tight(text):
                pieces = text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n\0").split("\0")
                return b"".join(map(self.cache.__getitem__, pieces))
            first, *rest = text.split(" ")
            if "\n" not in text:
                return self.cache[first] + b"".join(map(self.cache.__getitem__, [f" {x}" for x in rest]))
        except _Uncut:
            pass
        if _UNSURE.search(text):
            return self.one(text)
        return b"".join(map(self.one, _PIECES.findall(text)))
