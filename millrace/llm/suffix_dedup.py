"""Removal of byte strings that occur more than once, by a depth-limited radix sort of suffixes.

The first most-significant-digit pass is a shuffle: suffixes go to the bucket of their anchor (`_windows`), where all equal
ones meet. Within a task the following passes order suffixes only through the threshold: each pass splits the groups of equal
suffixes by their next block of bytes and drops those left alone, so that the groups after the last pass are exactly the
repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._windows import Windows, ids_repeat, keyed, longer, repeated_windows

#: Bytes of a digit.
DIGIT = 50
#: Suffixes that are ordered at once, about 100 bytes of memory each.
PASS = 1 << 20


def _digits(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each block data[begin:end]; blocks come in order, and a step hashes STEP_BYTES of data at a time."""
    out = np.empty(len(begin), np.uint64)
    cuts = np.searchsorted(begin, np.arange(0, len(data) + T.STEP_BYTES, T.STEP_BYTES))
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            lo = begin[a]
            out[a:b] = T.range_hashes(T.BYTE_VALUES[0][data[lo : end[a:b].max()]], begin[a:b] - lo, end[a:b] - lo, T.BASES[0])
    return out


def radix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which of the suffixes at `starts` (in order) agree through `width` bytes with another one of their group.

    A digit is a block of DIGIT bytes, compared by a 64-bit hash."""
    alive = np.arange(len(starts))
    rank = group.astype(np.int64)
    for depth in range(0, width, DIGIT):
        if not len(alive):
            break
        begin = starts[alive] + depth
        digit = _digits(data, begin, np.minimum(begin + DIGIT, begin - depth + width))
        order = np.lexsort((digit, rank))
        rank, digit = rank[order], digit[order]
        head = np.ones(len(order), bool)
        head[1:] = (rank[1:] != rank[:-1]) | (digit[1:] != digit[:-1])
        alone = head & np.append(head[1:], True)
        new = np.empty(len(order), np.int64)
        new[order] = np.where(alone, 0, np.cumsum(head))
        alive, rank = alive[new > 0], new[new > 0]
    out = np.zeros(len(starts), bool)
    out[alive] = True
    return out


#: Of a stretch: id, hash of the text, anchor, first and last window, content.
Row = tuple[int, int, int, int, int, bytes]


def _anchor_at(content: bytes, anchor: int, gram: int) -> int:
    """Where the gram that hashes to `anchor` first stands."""
    data = np.frombuffer(content, np.uint8)
    return int(np.flatnonzero(T.rolling_hashes(T.BYTE_VALUES[0][data], gram, T.BASES[0]).view(np.int64) == anchor)[0])


def _passes(rows: list[Row], width: int, gram: int, most: int) -> Iterator[list[Row]]:
    """rows, sorted by anchor, in parts that may be ordered one after the other, of about `most` suffixes each.

    Equal windows have their anchor at the same offset, so an anchor of more suffixes is cut by ranges of that offset: each stretch
    gives a part its windows of the range, and equal ones merge again there."""
    if sum(len(r[5]) for r in rows) <= most:
        yield rows
        return
    kinds: dict[int, set[bytes]] = {}
    for r in rows:
        kinds.setdefault(r[2], set()).add(r[5])
    suffixes = {a: sum(len(c) - width + 1 for c in cs) for a, cs in kinds.items()}
    few = [r for r in rows if suffixes[r[2]] <= most]
    part: list[Row] = []
    held = 0
    for _, own in groupby(few, lambda r: r[2]):
        group = list(own)
        n = suffixes[group[0][2]]
        if part and held + n > most:
            yield part
            part, held = [], 0
        part += group
        held += n
    if part:
        yield part
    for a, cs in kinds.items():
        if suffixes[a] <= most:
            continue
        known = next(iter(cs))
        at = _anchor_at(known, a, gram)
        word = known[at : at + gram]
        place = {c: p if (p := c.find(word)) >= 0 else _anchor_at(c, a, gram) for c in cs}
        own = [r for r in rows if r[2] == a]
        step = max(1, most // len(cs))
        for low in range(0, width - gram + 1, step):
            cut = []
            for doc, h, _, first, last, content in own:
                i, j = max(0, place[content] - low - step + 1), min(last - first, place[content] - low)
                if i <= j:
                    cut.append((doc, h, a, first + i, first + j, content[i : j + width]))
            yield cut


def _shard(width: int, gram: int, most: int = 1 << 19, ordered: int = PASS):
    """Stretches sorted by anchor to spans of windows that occur twice or more."""

    def solve(rows: list[Row]) -> list[tuple[int, int, int, int]]:
        count: dict[tuple[int, bytes], int] = {}
        kinds: dict[int, int] = {}
        for r in rows:
            key = (r[2], r[5])
            count[key] = count.get(key, 0) + 1
            kinds[r[2]] = kinds.get(r[2], 0) + (count[key] == 1)
        single = [(a, c) for (a, c), n in count.items() if n >= 1 and kinds[a] > 1]
        flags: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        if single:
            data = np.frombuffer(b"".join(c for _, c in single), np.uint8)
            size = np.array([len(c) for _, c in single])
            base = np.cumsum(size) - size
            n = size - width + 1
            piece = np.repeat(np.arange(len(single)), n)
            local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids = {a: i for i, a in enumerate(kinds)}
            group = np.array([ids[a] for a, _ in single])
            hit = radix_groups(data, base[piece] + local, group[piece], width)
            ends = np.cumsum(n)
            for i, key in enumerate(single):
                if count[key] == 1 and (found := hit[ends[i] - n[i] : ends[i]]).any():
                    flags[key] = T.runs(found).tolist()
        out = []
        for doc, h, a, first, last, content in rows:
            if count[a, content] >= 2:
                out.append((doc, h, first, last))
            else:
                out += [(doc, h, first + x, first + y - 1) for x, y in flags.get((a, content), ())]
        return out

    def batch_of(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        ids, hs, firsts, lasts = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], ["_id", "_h", "first", "last"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[Row] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size >= most and row[2] != rows[-1][2]:
                    yield from map(batch_of, map(solve, _passes(rows, width, gram, ordered)))
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield from map(batch_of, map(solve, _passes(rows, width, gram, ordered)))

    return run


def _keep(own: np.ndarray, hit: np.ndarray) -> str:
    """The text that is left: a character goes only if all its bytes do."""
    lead = (own & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    stays = np.zeros(int(char[-1]) + 1 if len(char) else 0, bool)
    stays[char[~hit]] = True
    return own[stays[char]].tobytes().decode("utf-8", "replace")


def _removed(spans: pa.Scalar, n: int, width: int) -> np.ndarray:
    found = spans.as_py()
    return T.covered(np.array([(x["first"], x["last"] + width) for x in found]), n) if found else np.zeros(n, bool)


def _digest(width: int):
    """(id, text, spans) rows to the counts of removed bytes, the digest of the rest, and the rest as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(1))
            n, gone, count, sha, kept = [], [], [], [], []
            for r in range(batch.num_rows):
                own = data[offsets[r] : offsets[r + 1]]
                hit = _removed(batch.column(2)[r], len(own), width)
                n.append(len(own))
                gone.append(int(hit.sum()))
                count.append(len(T.runs(hit)))
                sha.append(hashlib.sha256(own[~hit].tobytes()).hexdigest())
                kept.append(_keep(own, hit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def _rewrite(width: int, at: int, names: list[str]):
    """Rows of documents (their columns named `names`), their spans last, to the same rows with what is left of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            data, offsets = T.text_bytes(batch.column(at))
            texts = batch.column(at).to_pylist()
            for r in np.flatnonzero(batch.column(last).is_valid().to_numpy(zero_copy_only=False)).tolist():
                own = data[offsets[r] : offsets[r + 1]]
                texts[r] = _keep(own, _removed(batch.column(last)[r], len(own), width))
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(last)], names)

    return run


def _windows(width: int, hot: int) -> Windows:
    return Windows("byte", width, max(1, min(32, width // 4)), False, hot)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, hot: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs: its UTF-8 bytes without those covered by a
    string of `width` bytes that also starts anywhere else, in the same row included. `kept` is text, in which a character stays
    whole if any of its bytes does.

    Null and empty texts are empty. Null ids are kept, and so is the largest one, 2^63 - 1. Repeated rows count as separate occurrences, so that their long texts go
    from all of them. Other columns of docs are ignored. An empty table gives an empty result."""
    base = keyed(docs, id_col, text_col, ids_repeat(docs, id_col)).select("_id", "_h", "text", F.col("row")[id_col].cast("long").alias("own"))
    w = _windows(width, hot)
    spans = repeated_windows(base.drop("own"), w, _shard(width, w.gram), _shard(width, longer(w)))
    out = base.join(spans, ["_id", "_h"], "left").select("own", "text", "spans")
    return out.mapInArrow(_digest(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def without_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, hot: int = 50_000) -> DataFrame:
    """The rows of docs, other columns as they are whatever their names, with what `remove_repeated_bytes` keeps of their texts; null
    texts stay null."""
    base = keyed(docs, id_col, text_col, ids_repeat(docs, id_col))
    w = _windows(width, hot)
    spans = repeated_windows(base.select("_id", "_h", "text"), w, _shard(width, w.gram), _shard(width, longer(w)))
    out = base.join(spans, ["_id", "_h"], "left").select(*(F.col("row")[c].alias(f"c{i}") for i, c in enumerate(docs.columns)), "spans")
    return out.mapInArrow(_rewrite(width, docs.columns.index(text_col), docs.columns), docs.schema)
