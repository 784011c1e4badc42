"""Bounded-space online packing of token sequences into windows of a fixed length."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumaframe.llm.scratch import Scratch
from lumaframe.llm.shingles import text_slices
from lumaframe.llm.transducer import Memo, drops_white_space, stretches

#: Left-over windows that the last merge may read in one task; more go through another round first.
MERGE_WINDOWS = 4096
_COLUMNS = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "closed", "ids"]
_SCHEMA = "id {0}, start long, length long, doc_tokens long, sequence_id long, offset long, closed boolean, ids binary"


class WordIds(Memo):
    """The library's ids of each stretch, as little-endian unsigned 32-bit bytes.

    Where the tokenizer lowers letters, drops white space and looks at nothing
    across it, a text's ids are those of its stretches in a row; each is
    encoded once. Any other tokenizer gets each text whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_stretch = drops_white_space(json.load(f))

    def made(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, stretches(text))) if self.by_stretch else self.made(text)


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """A fixed number of open windows.

    A piece goes to the open window that it leaves the least room in. If it
    fits none and all windows are in use, the fullest is topped up with the
    piece's beginning and closed, so closed windows have no padding.
    """

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.open: list[list] = []  # [free, sequence number, pieces]
        self.made = 0

    def _new(self) -> list:
        self.made += 1
        return [self.size, self.made - 1, []]

    def add(self, key, start: int, ids: np.ndarray, total: int) -> Iterator[tuple]:
        """Rows of the windows that close: (number, key, start, ids, total, offset)."""
        while len(ids) >= self.size:
            yield self.made, key, start, ids[: self.size], total, 0
            self.made += 1
            ids, start = ids[self.size :], start + self.size
        while len(ids):
            fitting = [w for w in self.open if w[0] >= len(ids)]
            if fitting:
                window, n = min(fitting, key=lambda w: (w[0], w[1])), len(ids)
            elif len(self.open) < self.windows:
                self.open.append(window := self._new())
                n = len(ids)
            else:
                window = min(self.open, key=lambda w: (w[0], w[1]))
                n = window[0]
            window[2].append((key, start, ids[:n], total, self.size - window[0]))
            window[0] -= n
            ids, start = ids[n:], start + n
            if not window[0]:
                self.open.remove(window)
                yield from self._rows(window)

    def _rows(self, window: list) -> Iterator[tuple]:
        return ((window[1], *piece) for piece in window[2])

    def settle(self) -> Iterator[tuple]:
        """Deal what is in the open windows out again, one window at a time, so that at most one stays short."""
        pieces = [piece for window in sorted(self.open, key=lambda w: (w[0], w[1])) for piece in window[2]]
        self.open, self.windows = [], 1
        for key, start, ids, total, _ in pieces:
            yield from self.add(key, start, ids, total)

    def rest(self) -> Iterator[tuple]:
        for window in self.open:
            yield from self._rows(window)
        self.open = []


def _packed(items: Iterator[tuple], id_type: pa.DataType, size: int, windows: int, turn: int, last: bool) -> Iterator[pa.RecordBatch]:
    """items: (key, start, ids, total). Sequence ids hold the turn, the partition and the window's number there."""
    packer, held, weight = Packer(size, windows), [], 0
    base = (turn << 58) | (TaskContext.get().partitionId() << 32)

    def batch() -> pa.RecordBatch:
        number, key, start, ids, total, offset, closed = zip(*held, strict=True)
        columns = [pa.array(key, id_type), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(total, pa.int64()), pa.array([base + n for n in number], pa.int64()), pa.array(offset, pa.int64()), pa.array(closed, pa.bool_()), pa.array([i.tobytes() for i in ids], pa.binary())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=_COLUMNS)

    for item in items:
        for row in packer.add(*item):
            held.append((*row, True))
            weight += len(row[3])
        if weight > 1 << 18:
            weight = 0
            yield batch()
    if last:
        held.extend((*row, True) for row in packer.settle())
    held.extend((*row, last) for row in packer.rest())
    if held:
        yield batch()


def _pack_texts(batches: Iterator[pa.RecordBatch], path: str, end: int, size: int, windows: int) -> Iterator[pa.RecordBatch]:
    words, stop = _word_ids(path), np.array([end], "<u4").tobytes()
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return

    def items() -> Iterator[tuple]:
        for batch in (b for some in ((first,), batches) for b in some):
            for part in text_slices(batch, "text"):
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.frombuffer(words.of(text or "") + stop, "<u4")
                    yield key, 0, ids, len(ids)

    yield from _packed(items(), first.schema.field("id").type, size, windows, 0, False)


def _pack_pieces(batches: Iterator[pa.RecordBatch], size: int, windows: int, turn: int, last: bool) -> Iterator[pa.RecordBatch]:
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return

    def items() -> Iterator[tuple]:
        for batch in (b for some in ((first,), batches) for b in some):
            for row in batch.to_pylist():
                yield row["id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"]

    yield from _packed(items(), first.schema.field("id").type, size, windows, turn, last)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, size: int = 2048, end_id: int = 1, open_windows: int = 32, scratch: Scratch | None = None) -> DataFrame:
    """Cut and pack the ids of all texts, each followed by ``end_id``, into sequences of at most ``size``.

    ``tokenizer``: a tokenizer file of the library's, of any kind.

    Returns a row for each piece: id_col, start (ids of its document before
    it), length, doc_tokens, sequence_id, offset (its place in the sequence)
    and ids (little-endian unsigned 32-bit).

    Each partition is packed by itself in its row order; what its open windows
    hold at the end, at most ``open_windows`` of them, is dealt out again to
    fewer partitions until one task holds few enough windows to finish. A null
    or empty text is the end id alone. Null ids, repeated ids and repeated
    rows are packed like any other row, so no id is lost; other columns are
    ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = _SCHEMA.format(id_type)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = scratch.write(rows.mapInArrow(partial(_pack_texts, path=tokenizer, end=end_id, size=size, windows=open_windows), schema), "packed")
    done, turn = [made.where("closed")], 1
    while windows := (left := made.where("not closed")).select("sequence_id").distinct().count():
        last = windows <= MERGE_WINDOWS
        parts = 1 if last else -(-windows // (8 * open_windows))
        dealt = left.repartition(parts, F.xxhash64("sequence_id")).sortWithinPartitions(F.desc("length"), "id", "start")
        made = scratch.write(dealt.mapInArrow(partial(_pack_pieces, size=size, windows=open_windows, turn=turn, last=last), schema), "packed")
        done.append(made.where("closed"))
        turn += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select(F.col("id").alias(id_col), "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
