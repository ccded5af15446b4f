"""Token ids of whole texts by a public tokenizer, fast enough for a corpus.

The tokenizers library encodes whole texts at about a megabyte a second, but words repeat. A text is cut where the
tokenizer's pattern always cuts; a new piece is split by that pattern and its parts go to the library's own BPE model;
ids of pieces and parts stay in caches of bounded size. Pieces with letters beyond Latin Extended-A go to the library
as they are, so ids are always the library's. As the library does by default, a text is first cut at the strings of
the tokenizer's added tokens, each of which is its own id; ``plain`` takes them for ordinary text instead."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable

import public_tokenizers
import regex

#: Pieces that one generation of a cache holds; two generations are kept.
CACHE_PIECES = 400_000

#: The patterns that the two tokenizers split by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: ASCII characters that are neither white space nor letters nor digits.
MARKS = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

#: White space but for the space and the line feed.
_RARE = regex.compile(r"[^\S \n]")
#: Before a single space that stands between two characters that aren't white space, byte-level patterns always cut.
_CUT = regex.compile(r"(?<=\S)(?= \S)")


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    """Ids by piece; asks the generation before, then the encoder."""

    def __init__(self, encode, old: dict) -> None:
        self.encode, self.old = encode, old

    def __missing__(self, piece) -> bytes:
        found = self.old.get(piece)
        self[piece] = found = self.encode(piece) if found is None else found
        return found


class Ids:
    """Ids as little-endian unsigned 32-bit bytes. With ``words``, for lower-casing tokenizers that drop white space."""

    def __init__(self, name: str, words: bool, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = plain
        added = {} if plain else {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {content: array("I", [i]).tobytes() for content, i in added.items()}
        self.at_added = regex.compile("|".join(regex.escape(c) for c in sorted(added, key=len, reverse=True)) or r"(?!)")
        self.model, self.words = self.tokenizer.model, words
        self.split = regex.compile(WORD_LEVEL if words else BYTE_LEVEL).findall
        self.chars = _byte_chars()
        self.young, self.parts = _Cache(self._new, {}), {}

    def pieces(self, text: str) -> list:
        """What to look up; for byte-level kinds, all but the first stand for themselves behind a space."""
        if self.words:
            return text.encode().split()  # ASCII white space only, which is never part of a token
        if "  " in text or "\n " in text or " \n" in text or text[:1].isspace() or text[-1:].isspace() or _RARE.search(text):
            first, *rest = _CUT.split(text)
            return [first, *[x[1:] for x in rest]]
        return text.split(" ")

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            # What ASCII has besides white space stands for itself.
            tokens = self.model.tokenize(part if part.isascii() and part.isprintable() and " " not in part else part.encode().decode("latin-1").translate(self.chars))
            found = self.parts[part] = array("I", [t.id for t in tokens]).tobytes()
        return found

    def _new(self, piece) -> bytes:
        # Most new pieces are ASCII letters alone, or with one mark behind them: their parts are known without the pattern.
        if self.words and piece.isalpha():
            return self._letters(piece)
        if self.words and piece[:-1].isalpha() and piece[-1] in MARKS:
            return self._letters(piece[:-1]) + self._part(chr(piece[-1]))
        return self._whole(piece.decode() if self.words else " " + piece)

    def _letters(self, piece: bytes) -> bytes:
        if len(self.parts) > CACHE_PIECES:
            self.parts.clear()
        return self._part(piece.lower().decode())

    def _whole(self, p: str) -> bytes:
        if p.isascii():
            p = p.lower() if self.words else p
        elif max(p) > "ſ":
            return array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes()
        elif self.words:
            p = p.lower()  # no letter up to there depends on those beside it
        if len(self.parts) > CACHE_PIECES:
            self.parts.clear()
        return b"".join([self._part(x) for x in self.split(p)])

    def encode(self, text: str) -> bytes:
        if not any(content in text for content in self.added):
            return self._between(text)
        out, at = [], 0
        for m in self.at_added.finditer(text):
            out += [self._between(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self._between(text[at:])])

    def _between(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if not text:
            return b""
        if len(self.young) > CACHE_PIECES:
            self.young = _Cache(self._new, dict(self.young))
        pieces = self.pieces(text)
        if self.words or not pieces:
            return b"".join(map(self.young.__getitem__, pieces))
        return self._whole(pieces[0]) + b"".join(map(self.young.__getitem__, pieces[1:]))

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        return [self.encode(t or "") for t in texts]


_loaded: dict[tuple[str, bool], Ids] = {}


def ids_of(name: str, words: bool) -> Ids:
    """One encoder, with its cache, for each Python worker."""
    if (name, words) not in _loaded:
        _loaded[name, words] = Ids(name, words)
    return _loaded[name, words]
