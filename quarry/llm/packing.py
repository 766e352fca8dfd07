"""Packing of tokenized documents into sequences by the online sum-of-squares rule."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.common import WORD_SEPARATORS, bound_batches, sliced, trim_memory

#: Pieces of text that the byte-level pattern splits alike alone and within their text.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: White space on which regex engines differ; texts that hold any take the plain path.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Fixed value: the pre-tokenization pattern of the byte-level vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_CHUNKS = 150_000
CACHE_CHARS = 48


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Ids of a byte-level BPE file of `tokenizers`, as little-endian unsigned 32-bit bytes.

    Words repeat, so the ids of up to CACHE_CHUNKS short chunks are kept; a chunk that is not kept
    goes through a BPE encoder over the same vocabulary. Texts that hold an added token's string or
    odd white space go through `tokenizers` whole.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self._whole, self.sizes = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        added = {t["content"] for t in spec.get("added_tokens", [])}
        self.spaced = any(set(t) & set(WORD_SEPARATORS) for t in added)
        byte = _bytes_of_symbols()
        ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
        self.encoder = tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = self._encode

        class Cache(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = encode(chunk)
                if len(chunk) <= CACHE_CHARS:
                    if len(self) >= CACHE_CHUNKS:
                        self.clear()
                    self[chunk] = ids
                return ids

        self.cache = Cache()

    def _encode(self, chunk: str) -> bytes:
        ids = self.encoder.encode_ordinary(chunk)
        return struct.pack(f"<{len(ids)}I", *ids)

    @property
    def whole(self):
        if self._whole is None:  # few texts need it
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text) or self.added.search(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, _CHUNK.findall(text)))

    def of_words(self, words: list[str], n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, one word's after the other's, how many each has, and which words are odd.

        A word stands for itself after a space, ``n_bytes`` is its length in UTF-8, and it holds no
        plain white space. A text of such words has their ids, unless one is odd: that text goes
        through ``__call__``, since `tokenizers` sees it whole.
        """
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
        text = " " + " ".join(words)
        odd = np.zeros(len(words), bool)
        if self.spaced:  # such a string may lie across words
            odd[:] = True
        elif _ODD.search(text) or self.added.search(text):
            odd[:] = [bool(_ODD.search(w) or self.added.search(w)) for w in words]
        plain = ~odd
        if odd.any():
            text = "".join(" " + w for w, o in zip(words, odd.tolist(), strict=True) if not o)
        ids = np.array(self.encoder.encode_ordinary(text), np.uint32)
        if self.sizes is None:
            self.sizes = np.zeros(self.encoder.n_vocab, np.int64)
            for piece, i in self.encoder._mergeable_ranks.items():
                self.sizes[i] = len(piece)
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(n_bytes[plain] + 1), side="right")
        counts = np.zeros(len(words), np.int64)
        counts[plain] = np.diff(ends, prepend=0)
        return ids, counts, odd


_ENCODERS: dict[str, ByteBPE] = {}


def byte_bpe(path: str) -> ByteBPE:
    """One encoder for each file and Python worker, until ``forget_encoders``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBPE(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """For the end of a task: its worker lives on, for tasks of other operators too."""
    _ENCODERS.clear()
    trim_memory()


class SumOfSquares:
    """Windows of ``size`` tokens, filled online.

    ``levels[h]`` counts the partially filled windows that hold h tokens. A piece goes to the level
    (0: a new window) after which the sum of the squared counts is least; of equal levels the
    fullest is taken. Pieces of a window are given out when it is full. At most ``most_open``
    windows stay open: with so many, a piece that would open another is cut, to fill the emptiest
    of them and go on with the rest. At the end the emptiest window is taken apart and its pieces
    are placed by the same rule among the others, cut where no level has room, until one window is
    left; that is cut at powers of two. ``placed`` and ``settled`` count the windows closed before
    the end and at it.
    """

    def __init__(self, size: int, emit: Callable[[list, int], None], most_open: int = 512):
        self.size, self.emit, self.most_open = size, emit, most_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size)]
        self.n_open = 0
        self.placed = self.settled = 0
        self._ending = False

    def best_level(self, length: int, new: bool) -> int | None:
        """The level to put ``length`` tokens in; 0, a new window, only if ``new``."""
        levels = self.levels
        change = 2 * (levels[length:] - levels[: self.size - length + 1]) + 2  # h leaves, h + length comes
        change[0] = 2 * levels[length] + 1 if new else np.iinfo(np.int64).max  # no level loses one
        change[-1] -= 2 * levels[self.size] + 1  # a full window is not counted
        change[1:][levels[1 : len(change)] == 0] = np.iinfo(np.int64).max
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        return None if change[at] == np.iinfo(np.int64).max else at

    def add(self, piece: tuple, new: bool = True) -> None:
        """piece: (document, start, length); cut already to at most one window."""
        doc, start, length = piece
        while length:
            if length == self.size:
                self._close([(doc, start, length)])
                return
            at = self.best_level(length, new)
            if new and at == 0 and self.n_open >= self.most_open:
                at = None
            if at is None and not self.n_open:
                at = 0
            take = length
            if at is None:  # no room for all of it: fill the emptiest window
                at = int(np.flatnonzero(self.levels)[0])
                take = min(length, self.size - at)
            self._put(at, (doc, start, take))
            start, length = start + take, length - take

    def _put(self, at: int, piece: tuple) -> None:
        window = []
        if at:
            window = self.open[at].pop()
            self.levels[at] -= 1
            self.n_open -= 1
        window.append(piece)
        held = at + piece[2]
        if held == self.size:
            self._close(window)
        else:
            self.open[held].append(window)
            self.levels[held] += 1
            self.n_open += 1

    def _close(self, window: list) -> None:
        self.placed += not self._ending
        self.settled += self._ending
        self.emit(window, self.size)

    def finish(self) -> None:
        """Closes what is open."""
        self._ending = True
        while self.n_open > 1:
            for piece in self._take(int(np.flatnonzero(self.levels)[0])):
                self.add(piece, new=False)
        if self.n_open:
            held = int(np.flatnonzero(self.levels)[0])
            self._tail(self._take(held), held)

    def _take(self, level: int) -> list:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _tail(self, pieces: list, held: int) -> None:
        """Sequences of lengths that are powers of two, the largest first."""
        pieces = pieces[::-1]
        while held:
            size = left = 1 << (held.bit_length() - 1)
            window = []
            while left:
                doc, start, length = pieces.pop()
                take = min(length, left)
                window.append((doc, start, take))
                left -= take
                if take < length:
                    pieces.append((doc, start + take, length - take))
            self.emit(window, size)
            held -= size


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Each partition of ``docs`` (doc_id, text) packs what it reads, in one pass and without a
    shuffle; state is the open windows. A document is its ids and ``end_id``; one of more than
    ``size`` ids is cut into full windows and a rest. ``ids`` are little-endian unsigned 32-bit.
    Null or empty text: the end id alone. Repeated rows are packed each; a null doc_id stays null;
    other columns are ignored. An empty table gives no pieces. Sequences are numbered within the
    partition, whose number stands above bit 40.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        end = struct.pack("<I", end_id)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        state = {"n": 0, "bytes": 0}
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def emit(window: list, _: int) -> None:
            at = 0
            for (doc_id, ids, n), start, length in window:
                data = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, length, data, n, base + state["n"], at))
                at += length
                state["bytes"] += len(data)
            state["n"] += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            state["bytes"] = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

        packer = SumOfSquares(size, emit)
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                cut = n - n % size
                for start in range(0, cut, size):
                    packer.add(((doc_id, ids, n), start, size))
                if cut < n:
                    # a held rest keeps its own bytes, not those of the whole document
                    rest = _Rest(ids[4 * cut :], cut) if cut else ids
                    packer.add(((doc_id, rest, n), cut, n - cut))
            if rows and (state["bytes"] > 4 << 20 or len(rows) > 20_000):
                yield out()
        packer.finish()
        if rows:
            yield out()
        del packer, encode
        forget_encoders()

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


class _Rest:
    """The last ids of a document, addressed by their place in the whole."""

    def __init__(self, data: bytes, start: int):
        self.data, self.shift = data, 4 * start

    def __getitem__(self, part: slice) -> bytes:
        return self.data[part.start - self.shift : part.stop - self.shift]
