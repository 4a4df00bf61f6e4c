"""Token ids of whole texts by a public word-level BPE file, word by word.

The file's tokenizer drops white space before anything else, so a text's ids
are its words' ids in a row and each word is encoded once.  Plain words are cut
into the pieces that the tokenizer's pattern gives and go straight to its merge
model; all other words, and texts with separators that Python and the tokenizer
take differently, go through the tokenizer itself.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

#: Words, and pieces of words, in a generation of a worker's tables; two
#: generations of words are held, so that frequent words stay.
CACHED = 300_000
#: Python splits words here and the tokenizer doesn't.
ODD = re.compile("[\x1c-\x1f]")
#: Letters, digits and signs of Latin-1 for which lower case is one character
#: and normal form changes nothing; special tokens need '<|'.
PLAIN = re.compile("(?!.*<\\|)[\x21-\x7eà-öø-ÿÀ-ÖØ-Þß]+")
SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w]|_)+")


BIG_ENDIAN = sys.byteorder == "big"


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for
    themselves, the others are numbered from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Table(dict):
    """Ids by word or piece; what it lacks is encoded, and kept."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.encode(word)
        return found


class Words:
    """Encodes texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cached = self.tokenizer.model, cached
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.words, self.before = Table(self._word), Table(self._word)
        self.pieces = Table(self._piece)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(letters)])
        if BIG_ENDIAN:
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is not None:
            return found
        if not (word.isprintable() and "<|" not in word if word.isascii() else PLAIN.fullmatch(word)):
            return self._whole(word)
        pieces = self.pieces
        if (low := word.lower()) == word:
            low = word  # one string in both tables
        core = low.rstrip(SIGNS)
        if core.isalpha():  # letters and then signs: most words
            return pieces[core] + pieces[low[len(core) :]] if len(core) < len(low) else pieces[core]
        return b"".join(map(pieces.__getitem__, PIECE.findall(low)))

    def encode(self, text: str) -> bytes:
        if ODD.search(text):
            return self._whole(text)
        if len(self.words) > self.cached:
            self.before, self.words = self.words, Table(self._word)
        if len(self.pieces) > self.cached:
            self.pieces = Table(self._piece)
        return b"".join(map(self.words.__getitem__, text.split()))


_OWN: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """This process's encoder: a worker keeps its tables from task to task."""
    if path not in _OWN:
        _OWN[path] = Words(path)
    return _OWN[path]
