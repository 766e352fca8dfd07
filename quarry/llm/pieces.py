"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the boundaries of a text. Each keeps a backpointer, the last piece of the best
path that ends there, and only the window since the last committed boundary is held: new paths go on
from the last ``longest`` boundaries (``longest``: characters of the longest piece), and as soon as
all of these lead back to one boundary, the ids up to it are given out.

For a unigram model the best path is that of the largest sum of scores. A BPE model's scores are
ranks of merges, and its ids come from merging in their order. Merges in one part of a text don't
depend on another until one joins both, so a path is what merging gives just when each two
neighbouring pieces, merged alone, stay those two. Of the pieces that end at a boundary exactly one
agrees in this way with the path before it; all others are dropped from the lattice.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import bound_batches, sliced, trim_memory

SPACE = "▁"
#: Stands for a SPACE character that the text itself holds; valid texts hold no lone surrogate.
_LITERAL = "\udfff"
_WINDOW = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
UNKNOWN_PENALTY = 10.0
CACHE_WINDOWS, CACHE_CHARS, CACHE_PAIRS = 200_000, 48, 500_000
_BPE = 2
#: Stands for the piece before the first one.
_START = -1


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class PieceModel:
    """Pieces of a SentencePiece file with their scores. Spaces are written SPACE, one is put in
    front of a text, and characters that no piece has are spelled in bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.vocabulary: dict[str, tuple[float, int]] = {}
        self.byte_id: dict[int, int] = {}
        self.unknown_id = 0
        self.prefix = True
        self.merges = False
        lowest = 0.0
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                piece, kind, i = x[1].decode(), x.get(3, _NORMAL), len(self.pieces)
                score = struct.unpack("<f", x[2])[0] if 2 in x else 0.0
                self.pieces.append(piece)
                if kind in (_NORMAL, _USER):
                    self.vocabulary[piece] = (score, i)
                    lowest = min(lowest, score)
                elif kind == _BYTE:
                    self.byte_id[int(piece[3:5], 16)] = i
                elif kind == _UNKNOWN:
                    self.unknown_id = i
            elif number == 2:
                self.merges = dict(_fields(value)).get(3, 1) == _BPE
            elif number == 3:
                self.prefix = bool(dict(_fields(value)).get(3, 1))
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.longest = max(map(len, self.vocabulary), default=1)
        self.shift = len(self.pieces).bit_length()
        # finds all pieces that end at a character, the longest first
        self.lattice = ahocorasick.Automaton()
        for piece, (score, i) in self.vocabulary.items():
            self.lattice.add_word(piece, (len(piece), i, score))
        self.lattice.make_automaton()
        # no piece crosses from another character to SPACE: all paths meet there, whatever the text
        self.windows = not any(SPACE in p.lstrip(SPACE) for p in self.vocabulary)
        self.value_of_byte = {i: b for b, i in self.byte_id.items()}
        self.agreeing: dict[int, bool] = {}
        window_ids = self._ids

        class Cache(dict):
            older: dict[str, bytes] = {}

            def __missing__(self, window: str) -> bytes:
                ids = self.older.get(window) or window_ids(window)
                if len(window) <= CACHE_CHARS:
                    if len(self) >= CACHE_WINDOWS:  # what was used since the last time stays
                        self.older = dict(self)
                        self.clear()
                    self[window] = ids
                return ids

        self.cache = Cache()

    def normalize(self, text: str) -> str:
        if not text:
            return ""
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short ``text`` by merges: of neighbours that form a piece, those of the
        highest score are joined first, of equal ones the leftmost, until none form a piece."""
        get, none = self.vocabulary.get, (-np.inf, 0)
        parts = list(text)
        scores = [get(a + b, none)[0] for a, b in zip(parts, parts[1:])]
        while scores:
            top = max(scores)
            if top == none[0]:
                break
            i = scores.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)[0]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)[0]
        return parts

    def _agree(self, left: int, right: int) -> bool:
        """Whether the pieces, merged alone, stay as they are."""
        pair = [self._string(i) for i in (left, right) if i != _START]
        found = self.merged("".join(pair)) == pair
        if len(self.agreeing) >= CACHE_PAIRS:
            self.agreeing.clear()
        self.agreeing[left << self.shift | right] = found
        return found

    def _string(self, code: int) -> str:
        """The string of a piece; a character that no piece has goes by its code point behind them."""
        return self.pieces[code] if code < len(self.pieces) else chr(code - len(self.pieces))

    def viterbi(self, text: str) -> Iterator[tuple[int, int, int | None]]:
        """The pieces of the best path over ``text``: start, end, id (None: spell it in bytes).

        Kept is only the window since the last committed boundary (see the module). Where the last
        ``longest`` boundaries don't yet lead back to one, the window grows until they do. For
        scores, of equal paths the longer last piece wins.
        """
        merges, known, agree, shift = self.merges, self.agreeing.get, self._agree, self.shift
        base, check = 0, 2 * self.longest
        best: list = [_START if merges else 0.0]  # of each boundary: code of the last piece, or score
        back: list[tuple[int, int | None]] = [(0, None)]  # of the last piece: start (in the window), id
        for last, (length, piece, score) in self.lattice.iter(text):
            end = last + 1 - base
            if end >= len(best):
                while len(best) < end:
                    self._alone(text[base + len(best) - 1], best, back)
                if end > check:
                    meet = self._meeting(best, back)
                    if meet:
                        yield from self._path(base, back, meet)
                        lift = 0 if merges else best[meet]
                        best = [x - lift for x in best[meet:]]
                        back = [(max(0, a - meet), i) for a, i in back[meet:]]
                        base += meet
                        end -= meet
                    check = 2 * max(self.longest, end)
                if not merges:
                    self._alone(text[last], best, back)
            elif merges:
                continue  # the boundary has its path
            start = end - length
            if start < 0:
                continue
            if merges:
                left = best[start]
                ok = known(left << shift | piece)
                if ok or (ok is None and agree(left, piece)):
                    best.append(piece)
                    back.append((start, piece))
            elif (x := best[start] + score) > best[end] or (x == best[end] and back[end][1] is None):
                best[end], back[end] = x, (start, piece)
        while base + len(best) <= len(text):
            self._alone(text[base + len(best) - 1], best, back)
        yield from self._path(base, back, len(text) - base)

    def _alone(self, character: str, best: list, back: list) -> None:
        """The next boundary, reached by a character that no piece has."""
        if self.merges:
            best.append(len(self.pieces) + ord(character))
        else:
            best.append(-np.inf if character in self.vocabulary else best[-1] + self.unknown_score)
        back.append((len(back) - 1, None))

    def _meeting(self, best: list, back: list) -> int:
        """The boundary that all paths from the last ``longest`` ones lead back to."""
        alive = {j for j in range(max(0, len(best) - self.longest), len(best)) if best[j] != -np.inf}
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(back[last][0])
        return alive.pop()

    @staticmethod
    def _path(base: int, back: list, to: int) -> list[tuple[int, int, int | None]]:
        out = []
        while to:
            start, piece = back[to]
            out.append((base + start, base + to, piece))
            to = start
        out.reverse()
        return out

    def _ids(self, window: str) -> bytes:
        ids: list[int] = []
        for start, end, i in self.viterbi(window):
            if i is not None:
                ids.append(i)
            elif self.byte_id:
                piece = window[start:end]
                ids += [self.byte_id[b] for b in (SPACE if piece == _LITERAL else piece).encode()]
            else:
                ids.append(self.unknown_id)
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers.

        All paths meet where no piece crosses, so the search commits there and starts anew; what it
        gives for a committed window depends on the window alone, and that of short ones is kept."""
        text = self.normalize(text)
        if not self.windows:
            return self._ids(text)
        return b"".join(map(self.cache.__getitem__, _WINDOW.findall(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ids; exact for what ``encode`` gives."""
        table = self._table()
        text = b"".join(map(table.__getitem__, struct.unpack(f"<{len(ids) // 4}i", ids)))
        if self.prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", errors="replace")

    def _table(self) -> list[bytes]:
        if not hasattr(self, "_bytes"):
            self._bytes = [bytes([self.value_of_byte[i]]) if i in self.value_of_byte else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        return self._bytes


#: Models of this worker while a task runs.
_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _forget_models() -> None:
    """For the end of a task: its worker lives on, for tasks of other operators too."""
    _MODELS.clear()
    trim_memory()


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with ids (binary, little-endian 32-bit) of each text.

    Null or empty text: no ids. Repeated rows are encoded each. Other columns come through, but for
    one named ids, which is replaced. An empty table stays empty. Texts of any length: memory is the
    text, its ids and the window of the search. For a BPE model the ids are SentencePiece's,
    but for a SPACE character in the text: it is spelled in bytes, so that decoding gives it back.
    """
    docs = docs.drop("ids")
    own = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["ids binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in sliced(batches):
            ids = [pieces.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*own, "ids"])
        del pieces
        _forget_models()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with decoded, the text of the column ids (null ids: the empty text)."""
    encoded = encoded.drop("decoded")
    own = encoded.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields] + ["decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in sliced(batches, "ids"):
            text = [pieces.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*own, "decoded"])
        del pieces
        _forget_models()

    bound_batches(encoded.sparkSession)
    return encoded.mapInArrow(run, schema)
