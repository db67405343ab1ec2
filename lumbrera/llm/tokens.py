"""Token ids of texts, exactly those of the tokenizer file, with the work on repeated words done once.

Both tokenizers cut a text into pieces before they merge, and no piece reaches over a plain space
that is followed by something other than white space. So a text is cut at its spaces, and a chunk
that was seen before is looked up. In a plain text, of letters, digits and punctuation whose class is
beyond doubt, a chunk of letters is one piece and is kept as such, whatever stands next to it
elsewhere; other chunks are cut into pieces by the tokenizer's own rule, and only new pieces are
merged. Chunks of other characters, and texts with white space next to a space or line end, go
through the tokenizer as it is. The caches hold a bounded number of entries: a full one becomes the
old one, and what is still used moves over from there.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

CACHED_CHUNKS, CACHED_MARKS, CACHED_PIECES = 30_000, 5_000, 150_000
# --- fixed values: the piece rules of the two tokenizer files on the characters named here ---------
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(rf"[ -~{_LETTERS}]*\Z")
_PLAIN_TEXT = re.compile(rf"[\n -~{_LETTERS}]*\Z")
_WORD_PIECES = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}0-9]+")
_BYTE_PIECES = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
# ---------------------------------------------------------------------------------------------------
_UNSAFE_SPACE = re.compile(r"[ \n]\s|\s[ \n]")
_UNSAFE_IN_PLAIN = "  ", " \n", "\n ", "\n\n"


def _byte_letters() -> dict[int, str]:
    """One visible character for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """What ``make`` gives for a key, kept for at least the last ``size`` keys; ``apart`` answers for keys that are not letters alone."""

    def __init__(self, make: Callable[[str], bytes], size: int, apart: Callable[[str], bytes] | None = None):
        super().__init__()
        self.make, self.size, self.apart, self.old = make, size, apart, {}

    def __missing__(self, key: str) -> bytes:
        if self.apart and not (key[1:] if key[:1] == " " else key).isalpha():
            return self.apart(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids as little-endian unsigned 16-bit bytes (both vocabularies are below 65536)."""

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit into two bytes")
        self.lowers = self.tokenizer.normalizer is not None
        self.letters = _byte_letters()
        self.space = self.letters[ord(" ")]
        self.tokenizer.model._resize_cache(0)  # a piece comes here once, so the library's own cache is only filled
        self.tokenize = self.tokenizer.model.tokenize
        self.chunks = _Cache(self._chunk, CACHED_CHUNKS)
        self.marks = _Cache(self._piece, CACHED_MARKS)
        self.pieces = _Cache(self._piece, CACHED_PIECES, apart=self.chunks.__getitem__)

    @functools.cached_property
    def whole(self) -> Tokenizer:
        """The tokenizer with its own cache, loaded when a text needs it."""
        return Tokenizer.from_file(self.path)

    def _raw(self, text: str) -> bytes:
        return array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            shown = piece
        elif piece[0] == " " and piece.isascii() and piece[1:].isalpha():
            shown = self.space + piece[1:]
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.tokenize(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.isascii() and (chunk[1:] if chunk[0] == " " else chunk).isalpha():  # one piece
            return self.pieces[chunk.lower()] if self.lowers else self.pieces[chunk]
        if chunk == "\n":  # the byte tokenizer's; the other one's texts are cut there
            return self.marks[chunk]
        if chunk.isspace() or "<|" in chunk or not _PLAIN.match(chunk):
            return self._raw(chunk)
        pieces = _WORD_PIECES.findall(chunk.lower()) if self.lowers else _BYTE_PIECES.findall(chunk)
        return b"".join([self.pieces[p] if p[-1].isalpha() and p[0] != "'" else self.marks[p] for p in pieces])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self._raw(text)
        plain = _PLAIN_TEXT.match(text)
        if self.lowers:
            chunks = text.lower().split() if plain else text.replace("\n", " ").split(" ")
        elif any(x in text for x in _UNSAFE_IN_PLAIN) if plain else _UNSAFE_SPACE.search(text) or "\0" in text:
            return self._raw(text)
        elif text[-1].isspace():
            return self._raw(text)
        else:
            chunks = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return b"".join(map((self.pieces if plain else self.chunks).__getitem__, chunks))

    def ids(self, text: str | None, end: int) -> np.ndarray:
        return np.frombuffer(self(text) + array("H", [end]).tobytes(), "<u2")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one for all tasks of a Python worker: what it has looked up stays known."""
    return Encoder(path)
