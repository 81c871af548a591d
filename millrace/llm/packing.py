"""Packing of encoded documents into sequences of a fixed length: bounded-space online best fit.

Every partition keeps a fixed number of open windows. A piece goes to the window that it fills best; where it fits none, the fullest
window takes as much of it as it holds and is emitted, full, and the rest goes on. Windows still open at the end are leftovers. They
meet in a reduction tree, some partitions at a time, largest pieces first, until one task holds the last few windows; those are poured
together, and what stays below a whole sequence is cut into lengths that are powers of two. So no id of padding is needed.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import received, saved, sent
from .token_counts import PATTERN

LENGTH = 2048
#: Windows that a partition keeps open.
WINDOWS = 64
#: Partitions whose leftovers meet in one task.
MEET = 32
#: Ids of emitted pieces that a task holds before it passes them on.
PASSED = 1 << 21
#: What an emitted sequence's number begins with: level, partition, then a count.
LEVEL_AT, PART_AT = 59, 34
PIECE = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def load_vocabulary(spark: SparkSession, path: str):
    """The ranks of a byte-level vocabulary (json of the `tokenizers` library), broadcast: a file of a fixed size, read by the driver."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    # fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for code points from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}
    ranks.pop(b"<|endoftext|>", None)  # a special token's string is ordinary text
    return sent(spark, ranks)


class Windows:
    """Open windows by the room they have left: (room, number), and their pieces."""

    def __init__(self, length: int, most: int, emit: Callable[[list], None]) -> None:
        self.length, self.most, self.emit = length, most, emit
        self.rooms: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}
        self.opened = 0

    def put(self, doc: object, ids: np.ndarray, start: int, tokens: int) -> None:
        """Places ids of a document, from `start` in it on."""
        at, end = 0, len(ids)
        while end - at >= self.length:  # whole windows need no place
            self.emit([(doc, start + at, ids[at : at + self.length], tokens)])
            at += self.length
        while at < end:
            need = end - at
            k = bisect_left(self.rooms, (need, -1))
            if k < len(self.rooms):
                room, number = self.rooms.pop(k)
            elif len(self.rooms) < self.most:
                self.opened += 1
                room, number = self.length, self.opened
                self.pieces[number] = []
            else:
                room, number = self.rooms.pop(0)
                need = room
            self.pieces[number].append((doc, start + at, ids[at : at + need], tokens))
            at += need
            if room == need:
                self.emit(self.pieces.pop(number))
            else:
                insort(self.rooms, (room - need, number))

    def close(self) -> None:
        """Pours what is open together, fullest first; the last ids are cut into sequences of powers of two."""
        left = [self.pieces[n] for _, n in sorted(self.rooms)]
        self.rooms, self.pieces = [], {}
        total = sum(len(p[2]) for window in left for p in window)
        sizes = [self.length] * (total // self.length) + [1 << b for b in range(self.length.bit_length(), -1, -1) if total % self.length >> b & 1]
        room, own = (sizes.pop(0) if sizes else 0), []
        for doc, start, ids, tokens in (p for window in left for p in window):
            at = 0
            while at < len(ids):
                take = min(room, len(ids) - at)
                own.append((doc, start + at, ids[at : at + take], tokens))
                at, room = at + take, room - take
                if not room:
                    self.emit(own)
                    room, own = (sizes.pop(0) if sizes else 0), []


class _Out:
    """Emitted sequences on their way to batches; those left open have no number."""

    def __init__(self, level: int, part: int) -> None:
        self.number = level << LEVEL_AT | part << PART_AT
        self.rows: list[tuple] = []
        self.held = 0

    def emit(self, window: list) -> None:
        offset = 0
        for doc, start, ids, tokens in window:
            self.rows.append((doc, start, ids.astype("<u4").tobytes(), tokens, self.number, offset))
            offset += len(ids)
        self.held += offset
        self.number += 1

    def leave(self, windows: Windows) -> None:
        for pieces in windows.pieces.values():
            self.rows += [(doc, start, ids.astype("<u4").tobytes(), tokens, None, None) for doc, start, ids, tokens in pieces]

    def batch(self, group: int) -> pa.RecordBatch:
        doc, start, ids, tokens, number, offset = zip(*self.rows, strict=True) if self.rows else ((),) * 6
        self.rows, self.held = [], 0
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(x, t) for x, t in zip((doc, start, ids, tokens, number, offset), kinds, strict=True)]
        names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "part"]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([group] * len(arrays[0]), pa.int64())], names)


def _pack(ranks, end_id: int, length: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=received(ranks), special_tokens={})
        part = TaskContext.get().partitionId()
        out = _Out(0, part)
        held = Windows(length, windows, out.emit)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = np.asarray([*(encoding.encode_ordinary(text) if text else ()), end_id], np.uint32)
                held.put(doc, ids, 0, len(ids))
                if out.held >= PASSED:
                    yield out.batch(part)
        out.leave(held)
        yield out.batch(part)

    return run


def _meet(level: int, length: int, windows: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = sorted(table.to_pylist(), key=lambda r: (-len(r["ids"]), r["doc_id"] is None, r["doc_id"], r["start"]))
        out = _Out(level, group)
        held = Windows(length, windows, out.emit)
        for r in rows:
            held.put(r["doc_id"], np.frombuffer(r["ids"], "<u4"), r["start"], r["doc_tokens"])
        if last:
            held.close()
        else:
            out.leave(held)
        return pa.Table.from_batches([out.batch(group)])

    return run


def pack(docs: DataFrame, ranks, end_id: int = 1, length: int = LENGTH, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: (doc_id, start, ids, doc_tokens, sequence_id, offset), ids as little-endian unsigned 32-bit numbers.

    A document is the ids of its text and `end_id`; null and empty texts are `end_id` alone. Every id lies in one piece; a sequence's
    pieces follow each other without a gap. All sequences have `length` ids (a power of two), but for the last few, which are powers of two. Strings of
    special tokens are ordinary text. Null ids and repeated rows are documents like any others; a very long text is cut into whole
    windows as it comes; an empty table gives no piece; other columns are ignored.

    Texts are encoded once and what is emitted is written to the shared folder. A partition's leftovers are `windows` * `length` ids at
    most, and MEET partitions' meet in a task."""
    schema = f"{PIECE}, part long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    level, found = 0, saved(rows.mapInArrow(_pack(ranks, end_id, length, windows), schema))
    done = []
    while True:
        done.append(found.filter("sequence_id is not null"))
        left = found.filter("sequence_id is null")
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            break
        level += 1
        last = parts < MEET
        groups = left.withColumn("part", F.floor(F.col("part") / MEET)).groupBy("part")
        found = saved(groups.applyInArrow(_meet(level, length, windows, last), schema))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.drop("part")
