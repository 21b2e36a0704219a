"""Fast exact encoding with a public word-level BPE file (lower case, word ends, white space dropped).

The file's own library decides every result. What it would do for a pre-token is looked up once per worker. Texts with
characters for which the split below could differ from the library's are normalised and split by the library, and their
pre-tokens are looked up like the others; strings of special tokens are cut out first, as the library does.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np

#: Below this code point a text is already in NFC, and lower-casing has no context and leads to nothing above it (bar dotted I).
PLAIN_BELOW = 0x180
#: Entries and characters of a worker's cache; a full cache is emptied, and holds more only while one slice needs more.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 40_000_000


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if unicodedata.category(chr(c)).startswith(kind))


_SPACE = r"\x09-\x0D\x20\x85\xA0"
_LETTER, _NUMBER = _class("L"), _class("N")
#: Fixed value: the split pattern of the tokenizer file, with its classes written out below PLAIN_BELOW.
PIECE = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: Characters for which the split above could differ from the library's: odd separators, dotted capital I, all above.
ODD = re.compile(rf"[\x00\x1C-\x1Fİ]|[^\x00-{chr(PLAIN_BELOW - 1)}]")
ODD_ASCII = "\x00\x1c\x1d\x1e\x1f"
SPACES = re.compile(r"[\x09-\x0D\x20]+")
#: Longest chunk that is remembered by itself, in characters.
SHORT = 64
#: Marks a pre-token that is written in the library's byte letters already; no other pre-token holds it.
LETTERS = "\x00"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def specials(path: str) -> re.Pattern:
    """The strings of special tokens, found in a text before anything else."""
    found = library(path).get_added_tokens_decoder().values()
    return re.compile("|".join(re.escape(t.content) for t in sorted(found, key=lambda t: -len(t.content))) or "(?!)")


def plain(text: str) -> bool:
    """Whether ``PIECE`` splits the lower-cased text as the library would."""
    if text.isascii():
        return not any(c in text for c in ODD_ASCII)
    return not ODD.search(text)


def pieces(path: str, text: str) -> list[str]:
    """The library's pre-tokens of ``text``: special tokens, lower-cased pieces, or pieces in byte letters after ``LETTERS``."""
    if "<|" in text and (found := list(specials(path).finditer(text))):
        out, start = [], 0
        for m in found:
            out += [*pieces(path, text[start : m.start()]), m.group()]
            start = m.end()
        return out + pieces(path, text[start:])
    if plain(text):
        return PIECE.findall(text.lower())
    return list(chain.from_iterable(_short_chunk(path, c) if len(c) <= SHORT else _chunk(path, c) for c in chunks(text)))


def chunks(text: str) -> list[str]:
    """What stands between white space: neither composition nor lower case nor a pre-token reaches across it."""
    return text.split() if not any(c in text for c in ODD_ASCII) else SPACES.split(text)


def _chunk(path: str, chunk: str) -> list[str]:
    if plain(chunk):
        return PIECE.findall(chunk.lower())
    return [LETTERS + letters for letters, _ in library(path).pre_tokenizer.pre_tokenize_str(library(path).normalizer.normalize_str(chunk))]


@lru_cache(maxsize=200_000)
def _short_chunk(path: str, chunk: str) -> list[str]:
    return _chunk(path, chunk)


@lru_cache(maxsize=2)
def model(path: str):
    return library(path).model


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def encode_piece(path: str, piece: str) -> list[int]:
    """Ids of one pre-token of ``pieces``, by the library's model alone: it is already normalised and split."""
    if piece.startswith("<|") and specials(path).fullmatch(piece):
        return [library(path).token_to_id(piece)]
    if piece.startswith(LETTERS):
        letters = piece[1:]
    else:
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_LETTERS)
    return [token.id for token in model(path).tokenize(letters)]


class IdCache:
    """Chunks of texts to ids, as slices of one flat array, made up from the ids of their pre-tokens."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.path, self.entries = path, entries
        self.chars, self.pieces = 0, {}
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        if len(self.pieces) > self.entries or self.chars > CACHE_CHARS:
            self.pieces = {}
        self.chars, self.flat, self.starts = 0, array("I"), array("q", [0])

    def learn(self, missing: set[str]) -> None:
        for chunk in missing:
            self.index[chunk] = len(self.starts) - 1
            self.chars += len(chunk)
            for piece in pieces(self.path, chunk):
                if (ids := self.pieces.get(piece)) is None:
                    ids = self.pieces[piece] = array("I", encode_piece(self.path, piece))
                self.flat.extend(ids)
            self.starts.append(len(self.flat))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [chunks(t) for t in texts]
        every = list(chain.from_iterable(split))
        needed = set(every)
        if missing := needed.difference(self.index):
            if len(self.index) + len(missing) > self.entries or self.chars > CACHE_CHARS:
                self._clear()  # then all that this slice needs is learned anew, however much that is
                missing = needed
            self.learn(missing)
        flat, starts = np.frombuffer(self.flat, dtype="u4") if len(self.flat) else np.zeros(0, "u4"), np.frombuffer(self.starts, dtype="i8")
        at = np.fromiter(map(self.index.__getitem__, every), dtype="i8", count=len(every))
        first, size = starts[at], starts[at + 1] - starts[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        del flat, starts  # views lock the arrays against growing
        cuts = ends[np.cumsum([0, *map(len, split)])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def worker_cache(path: str) -> IdCache:
    """The cache of this Python worker, which outlives a task."""
    return IdCache(path)
