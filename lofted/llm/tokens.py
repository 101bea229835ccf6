"""Token ids by the `tokenizers` library, through a bounded cache of words.

The word-level vocabulary drops white space and never merges across it, so the
ids of a text are those of its space-separated chunks in order.  A Python worker
keeps the ids of chunks that it met of late.  Of those it does not know, plain
words go straight to the library's BPE model, as nothing else changes them but
lower case; all others go through the whole library together, and the places of
their ids tell them apart again.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np

#: Bytes of remembered chunks above which a worker begins a new generation of its cache; it keeps two.
CACHE_BYTES = 32 << 20
#: Marks of chunks met once; a chunk is remembered when it comes again, as most never do.
MET = 1 << 21
#: Longer chunks are not remembered; characters of a text that are cut into chunks at a time.
LONGEST, STRETCH = 64, 1 << 20
#: Chunks that go through the library at once.
TOGETHER = 128
#: What a dictionary's entry takes besides its key and value.
_ENTRY = 104
#: A word of Latin-1 letters, which are composed already, and the marks after it.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]{0,3})")
#: Byte-level vocabularies write a byte that has no print as the next character from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip([*_PRINTED, *sorted(set(range(256)) - set(_PRINTED))], [*_PRINTED, *range(256, 324)]))
_encoders: dict[str, "WordEncoder"] = {}


def default_path() -> str:
    """The vocabulary of the queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _stretches(text: str) -> Iterator[str]:
    """The parts of a text, each cut at a space unless it has none."""
    at = 0
    while len(text) - at > STRETCH:
        cut = text.find(" ", at + STRETCH)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


class WordEncoder:
    """Ids of texts as unsigned 32-bit bytes in the order of the machine, which is little-endian."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tails: dict[str, bytes] = {"": b""}
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.met = bytearray(MET)
        probes = ["The", "Straße", "ÉTÉ", "anblehe"]
        self.direct = [self._word(c.lower()) for c in probes] == self._library(probes)

    def _word(self, word: str) -> bytes:
        """The ids of a word of Latin-1 letters in lower case."""
        plain = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def _library(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        made = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        raw, places = array("I", made.ids).tobytes(), [a for a, _ in made.offsets]
        cuts = 4 * np.searchsorted(places, np.cumsum([0, *(len(c) + 1 for c in chunks)]))
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            (self.tails[marks],) = self._library([marks])
        return self.tails[marks]

    def _learn(self, chunks: list[str], parts: list[bytes | None]) -> list[bytes]:
        """`parts` with the ids of those chunks that were not known."""
        found: dict[str, bytes] = {}
        odd, young, old = [], self.young, self.old
        for c in [c for c, p in zip(chunks, parts) if p is None]:
            if c in found:
                continue
            if (ids := old.get(c)) is not None:
                self._remember(c, ids)
                found[c] = ids
                continue
            tail = ""
            if c.isascii() and c.isalpha():
                low = c.lower()
            elif m := _WORD.fullmatch(c):
                low, tail = m[1].lower(), m[2]
            else:
                low = None
            if low is None or not self.direct:
                odd.append(c)
                found[c] = b""
                continue
            ids = young.get(low)
            if ids is None:
                ids = old.get(low)
                if ids is None:
                    ids = self._word(low)
                if low != c:
                    self._meet(low, ids)
            found[c] = ids + self._tail(tail) if tail else ids
        for at in range(0, len(odd), TOGETHER):
            some = odd[at : at + TOGETHER]
            found.update(zip(some, self._library(some)))
        for c, ids in found.items():
            self._meet(c, ids)
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held, self.met = self.young, {"": b""}, 0, bytearray(MET)
        return [found[c] if p is None else p for c, p in zip(chunks, parts)]

    def _meet(self, chunk: str, ids: bytes) -> None:
        k = hash(chunk) & (MET - 1)
        if self.met[k]:
            self._remember(chunk, ids)
        else:
            self.met[k] = 1

    def _remember(self, chunk: str, ids: bytes) -> None:
        if chunk not in self.young and len(chunk) < LONGEST:
            self.young[chunk] = ids
            self.held += sys.getsizeof(chunk) + sys.getsizeof(ids) + _ENTRY

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, without special tokens; null is empty."""
        if not text:
            return b""
        out = []
        for stretch in _stretches(text.replace("\n", " ")):
            chunks = stretch.split(" ")
            parts = list(map(self.young.get, chunks))
            out += self._learn(chunks, parts) if None in parts else parts
        return b"".join(out)


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
