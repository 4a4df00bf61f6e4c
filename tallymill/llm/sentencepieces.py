"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's symbols start as its characters.  Adjacent pairs that join to a piece
of the vocabulary stand on an agenda ordered by the piece's score, leftmost
first among equals; the best pair is joined, its new neighbours go on the
agenda, and pairs that lost a symbol are passed over.  Symbols left without a
piece become their UTF-8 bytes' pieces.

Two neighbouring characters that no piece holds side by side are never joined.
So where spaces stand only at the front of pieces and line breaks in none, a text
falls into stretches (spaces and the word behind them, or a line break), and
these into parts, that never meet on the agenda: each different one is merged
once and kept in a bounded table.  Every Arrow batch's new stretches are checked
against the sentencepiece library, and a difference is an error.  A vocabulary
without that property has its texts cut into parts, and checked, whole.

Edge cases: null text is empty; an empty text is the begin and end ids alone;
texts of any length and repeated rows are encoded like others; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import codecs
import re
from array import array
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import per_batch, texts_of
from .common import read

SPACE = "▁"
#: Stands at both ends of the symbols; joined to a symbol it is never a piece.
EDGE = "\U0010ffff" * 2
#: Stretches of a generation of a worker's table (two are held), and the longest that is kept.
CACHED, LONGEST = 300_000, 64
#: Characters of a text whose agenda is a list, at most, and the score of a pair that is no piece.
SHORT, NEVER = 32, float("inf")

#: The library puts U+FFFD for every byte that is part of no character.
codecs.register_error("tallymill-bytes", lambda e: ("�", e.start + 1))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary, by its path; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library, self.path, self.cached = (sp := SentencePieceProcessor(model_file=path)), path, cached
        every = range(sp.get_piece_size())
        plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in every if sp.is_byte(i)}
        self.unknown, self.begin, self.end = sp.unk_id(), sp.bos_id(), sp.eos_id()
        self.surface = [b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in every]
        for byte, i in self.bytes.items():
            self.surface[i] = bytes([byte])
        self.surface[self.unknown] = " ⁇ ".encode()
        self.control = np.array([sp.is_control(i) for i in every])
        self.spaced = {i for i in plain if self.surface[i].startswith(b" ")}
        apart = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids)
        self.stretches = re.compile(r" *[^ \n]+|\n| +") if apart else None
        self.pairs = {pair for p in self.ids for pair in map(add, p, p[1:])}
        self.parts: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.unchecked: dict[str, bytes] = {}

    def merge(self, text: str) -> list[int]:
        """The ids of text, where spaces are SPACE, by the agenda."""
        out: list[int] = []
        for s in self._short(text) if len(text) <= SHORT else self._long(text):
            if s in self.ids:
                out.append(self.ids[s])
            elif s:
                out += [self.bytes[b] for b in s.encode()] if self.bytes else [self.unknown]
        return out

    def _short(self, text: str) -> list[str]:
        """A short text's symbols: the agenda is a list beside them, a pair's score
        at its left symbol's place, and the best is looked for."""
        score, symbols = self.scores.get, [*text]
        agenda = [score(pair, NEVER) for pair in map(add, text, text[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            symbols[i] = piece = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(piece + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + piece, NEVER)
        return symbols

    def _long(self, text: str) -> list[str]:
        """The same of a long text, with some of them empty: the agenda is a heap,
        the symbols a list of neighbours."""
        score, symbols, n = self.scores.get, [*text, EDGE], len(text)
        after, ahead, agenda = list(range(1, n + 1)), list(range(-1, n)), []
        for i, piece in enumerate(map(add, text, text[1:])):
            if (s := score(piece)) is not None:
                agenda.append((s, i, i + 1, piece))
        heapify(agenda)
        while agenda:
            _, left, right, piece = heappop(agenda)
            if not symbols[left] or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, ""
            after[left] = far = after[right]
            ahead[far], near = left, ahead[left]
            if (s := score(joined := symbols[near] + piece)) is not None:
                heappush(agenda, (s, near, left, joined))
            if (s := score(joined := piece + symbols[far])) is not None:
                heappush(agenda, (s, left, far, joined))
        return symbols[:n]

    def _stretch(self, stretch: str) -> bytes:
        """A stretch's ids; one that isn't a word alone is cut between characters
        that no piece holds side by side."""
        found = self.before.get(stretch)
        if found is None:
            text = stretch.replace(" ", SPACE)
            if text[1:].isalpha() and len(text) <= SHORT:
                found = array("I", self.merge(text)).tobytes()
            else:
                cuts = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in self.pairs]
                found = b"".join([self._part(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])])
            self.unchecked[stretch] = found
        if len(stretch) <= LONGEST:
            self.known[stretch] = found
        return found

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = array("I", self.merge(part)).tobytes()
            if len(part) <= LONGEST:
                if len(self.parts) > self.cached:
                    self.parts = {}
                self.parts[part] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text with those of its begin and its end."""
        if not text:
            middle = b""
        elif self.stretches is None:
            middle = self._stretch(" " + text.replace(SPACE, " "))
        else:
            if len(self.known) > self.cached:
                self.before, self.known = self.known, {}
            known, one = self.known, self._stretch
            middle = b"".join([known.get(s) or one(s) for s in self.stretches.findall(" " + text.replace(SPACE, " "))])
        return np.array([self.begin], "<u4").tobytes() + middle + np.array([self.end], "<u4").tobytes()

    def check(self) -> None:
        """What was merged since the last check, against the library.  It puts a
        space before a text, so a stretch is given behind a line break."""
        fresh, self.unchecked = self.unchecked, {}
        if self.stretches is None:
            told, skip = self.library.encode([s[1:] for s in fresh], num_threads=1), 0
        else:
            told, skip = self.library.encode(["\n" + s for s in fresh], num_threads=1), 2
        for (stretch, ids), other in zip(fresh.items(), told):
            if np.array(other[skip:], "<u4").tobytes() != ids:
                raise ValueError(f"{self.path} isn't a merge-type vocabulary: the library has other pieces for {stretch[:80]!r}")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces' texts and bytes joined, without the space that
        the encoding put in front; characters don't go on past control ids."""
        at = np.flatnonzero(self.control[ids])
        runs = [ids[a:b].tolist() for a, b in zip([0, *(at + 1)], [*at, len(ids)]) if a < b]
        text = "".join([b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "tallymill-bytes") for run in runs])
        return text[1:] if runs and runs[0][0] in self.spaced else text


_OWN: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """This process's vocabulary: a worker keeps its table from task to task."""
    if path not in _OWN:
        _OWN[path] = Pieces(path)
    return _OWN[path]


def _texts_to_ids(batch: pa.RecordBatch, path: str) -> list[bytes]:
    pieces = pieces_of(path)
    ids = [pieces.encode(t) for t in texts_of(batch)]
    pieces.check()
    return ids


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids as little-endian unsigned 32-bit integers."""

    def run(batch: pa.RecordBatch, path: str) -> dict:
        return {"doc_id": batch.column("doc_id"), "ids": pa.array(_texts_to_ids(batch, path), pa.binary())}

    return per_batch(docs.select("doc_id", "text"), run, _schema(docs, "ids binary"), path or model_path())


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are no ids."""

    def run(batch: pa.RecordBatch, path: str) -> dict:
        pieces = pieces_of(path)
        texts = [pieces.decode(np.frombuffer(i or b"", "<u4")) for i in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())}

    return per_batch(rows.select("doc_id", "ids"), run, _schema(rows, "text string"), path or model_path())


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) in one pass."""

    def run(batch: pa.RecordBatch, path: str) -> dict:
        pieces, ids = pieces_of(path), _texts_to_ids(batch, path)
        texts = [pieces.decode(np.frombuffer(i, "<u4")) for i in ids]
        return {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(texts, pa.string())}

    return per_batch(docs.select("doc_id", "text"), run, _schema(docs, "ids binary, decoded string"), path or model_path())


def _schema(df: DataFrame, rest: str) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {rest}"


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
