"""Finding windows of a fixed number of symbols that occur more than once, without shipping every window.

Each window is represented by its anchor: the gram (a few consecutive symbols) of smallest hash inside it. Equal windows
have equal anchors, so a window can only repeat if its anchor does. Three steps follow from that:

1. Anchors (a few per cent of the positions) are counted by a plain aggregation; those met once are gone.
2. Documents with a repeated anchor emit the stretch of text around it that holds all windows anchored there, and the
   stretches are shuffled by anchor: a shard of the corpus in which equal windows always meet.
3. Within a shard the caller's exact method decides which windows repeat. Shards have at most `hot` stretches.

An anchor with more than `hot` occurrences (a sentence or passage that a third of all documents hold) takes another way. Of bytes, its
stretches are first cut by a longer string (`finer_rows`): a common sentence is rarely followed by the same text. For strings that are
still as frequent, equal stretches are merged by a partial aggregation, the windows of what is left are hashed to 128 bits and aggregated
by hash, and the verdict is joined back by stretch. No step gathers an unbounded group in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._tables import saved


@dataclass(frozen=True)
class Windows:
    """`width` symbols make a window, `gram` symbols an anchor; symbols are words or bytes. `earlier`: only windows that also
    start in a document of a smaller id count; else all that occur twice or more."""

    unit: str
    width: int
    gram: int
    earlier: bool
    hot: int = 4000


@dataclass
class Stretches:
    """Stretches of a batch step: row, anchor, first and last window (in symbols of the row), and place of their bytes."""

    row: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    byte_start: np.ndarray
    byte_end: np.ndarray


def stretches(data: np.ndarray, offsets: np.ndarray, w: Windows) -> Stretches:
    if w.unit == "word":
        starts, ends, rows = T.word_bounds(data, offsets)
        symbols = T.word_hashes(data, starts, ends)
        grams = T.gram_hashes(symbols, w.gram)
    else:
        rows = offsets
        grams = T.rolling_hashes(T.BYTE_VALUES[0][data], w.gram, T.BASES[0])
    arg = T.sliding_argmin(grams, w.width - w.gram + 1)
    m = len(arg)
    counts = np.diff(rows)
    row_of = np.repeat(np.arange(len(counts)), counts)[:m]
    ok = np.arange(m) + w.width <= rows[1:][row_of]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (arg[1:] != arg[:-1]) | (row_of[1:] != row_of[:-1])
    stop = ok.copy()
    stop[:-1] &= ~ok[1:] | (arg[1:] != arg[:-1]) | (row_of[1:] != row_of[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(stop)
    row = row_of[a]
    if w.unit == "word":
        bs, be = starts[a], ends[b + w.width - 1]
    else:
        bs, be = a, b + w.width
    return Stretches(row, grams[arg[a]].view(np.int64), a - rows[row], b - rows[row], bs, be)


def anchor_rows(w: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, h, text) rows to (id, h, anchor, n), one for each anchor of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(2))
            for lo, hi in T.steps(offsets):
                s = stretches(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], w)
                order = np.lexsort((s.anchor, s.row))
                row, anchor = s.row[order], s.anchor[order]
                head = np.ones(len(row), bool)
                head[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                at = np.flatnonzero(head)
                pick = pa.array(row[at] + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(anchor[at]), pa.array(np.diff(np.append(at, len(row))))],
                    ["_id", "_h", "anchor", "n"],
                )

    return run


def stretch_rows(w: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, h, text, anchors, hot) rows to (id, h, anchor, first, last, hot, content) for the anchors listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(2))
            lists = batch.column(3)
            at, anchors = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            hots = batch.column(4).values.to_numpy(zero_copy_only=False)
            for lo, hi in T.steps(offsets):
                part = data[offsets[lo] : offsets[hi]]
                s = stretches(part, offsets[lo : hi + 1] - offsets[lo], w)
                own, hot = anchors[at[lo] : at[hi]], hots[at[lo] : at[hi]]
                if not len(own):
                    continue
                wanted, first = np.unique(own, return_index=True)
                hot = hot[first]
                i = np.minimum(np.searchsorted(wanted, s.anchor), len(wanted) - 1)
                keep = np.flatnonzero(wanted[i] == s.anchor)
                buf, bs, be = part.tobytes(), s.byte_start[keep].tolist(), s.byte_end[keep].tolist()
                if w.unit == "word":
                    content = [b" ".join(buf[x:y].split()) for x, y in zip(bs, be, strict=True)]
                else:
                    content = [buf[x:y] for x, y in zip(bs, be, strict=True)]
                pick = pa.array(s.row[keep] + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pick),
                        batch.column(1).take(pick),
                        pa.array(s.anchor[keep]),
                        pa.array(s.first[keep].astype(np.int32)),
                        pa.array(s.last[keep].astype(np.int32)),
                        pa.array(hot[i[keep]]),
                        pa.array(content, pa.binary()),
                    ],
                    ["_id", "_h", "anchor", "first", "last", "hot", "content"],
                )

    return run


STRETCH = "_id long, _h long, anchor long, first int, last int, hot boolean, content binary"
STRETCH_COLUMNS = ["_id", "_h", "anchor", "first", "last", "content"]
SPANS = "_id long, _h long, first int, last int"


def longer(w: Windows) -> int:
    """Symbols of the anchors that `finer_rows` gives."""
    return w.gram - (w.gram - w.width) // 2


def finer_rows(w: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stretches of bytes to their two parts, whose anchors are longer: of the windows that hold the anchor in their second half all share
    what stands before it, of the others what follows. Equal windows have their anchor at the same place, so they stay together."""
    reach = longer(w) - w.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(5))
            anchor, first, last = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            for lo, hi in T.steps(offsets):
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                values = T.BYTE_VALUES[0][part]
                grams = T.rolling_hashes(values, w.gram, T.BASES[0]).view(np.int64)
                row = np.repeat(np.arange(hi - lo), np.diff(off))[: len(grams)]
                hit = np.flatnonzero(grams == anchor[lo:hi][row])
                hit = hit[hit + w.gram <= off[1:][row[hit]]]
                place = hit[np.unique(row[hit], return_index=True)[1]]  # the first of a row, where its windows have it
                before = place - off[:-1] - reach  # the last window that holds the anchor so far from its start
                most, buf = last[lo:hi].astype(np.int64) - first[lo:hi], part.tobytes()
                for start, end, key in ((np.zeros_like(before), np.minimum(before, most), place - reach), (np.maximum(before + 1, 0), most, place)):
                    own = np.flatnonzero(start <= end)
                    start, end, key, pick = start[own], end[own], key[own], pa.array(own + lo)
                    content = [buf[x:y] for x, y in zip((off[own] + start).tolist(), (off[own] + end + w.width).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pick),
                            batch.column(1).take(pick),
                            pa.array(T.range_hashes(values, key, key + longer(w), T.BASES[0]).view(np.int64)),
                            pa.array((first[own + lo] + start).astype(np.int32)),
                            pa.array((first[own + lo] + end).astype(np.int32)),
                            pa.array(content, pa.binary()),
                        ],
                        ["_id", "_h", "anchor", "first", "last", "content"],
                    )

    return run


def hot_parts(w: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`stretch_rows` and, of hot anchors, `finer_rows`, in one worker."""
    cut, finer = stretch_rows(w), finer_rows(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from finer(b.filter(b.column(5)).select([0, 1, 2, 3, 4, 6]) for b in cut(batches))

    return run


def window_rows(w: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(anchor, content, m, c) rows to (anchor, s1, s2, at, w1, w2, m, c): each window of a stretch with its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(1))
            for lo, hi in T.steps(offsets, 1 << 17):
                part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                hashes = []
                for which in (0, 1):
                    if w.unit == "word":
                        starts, ends, rows = T.word_bounds(part, offs)
                        h = T.gram_hashes(T.word_hashes(part, starts, ends, which), w.width, which)
                    else:
                        rows = offs
                        h = T.rolling_hashes(T.BYTE_VALUES[which][part], w.width, T.BASES[which])
                    hashes.append(h.view(np.int64))
                row_of = np.repeat(np.arange(hi - lo), np.diff(rows))[: len(hashes[0])]
                good = np.flatnonzero(np.arange(len(row_of)) + w.width <= rows[1:][row_of])
                pick = pa.array(row_of[good] + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pick),
                        batch.column(2).take(pick),
                        pa.array((good - rows[row_of[good]]).astype(np.int32)),
                        pa.array(hashes[0][good]),
                        pa.array(hashes[1][good]),
                        batch.column(3).take(pick),
                        batch.column(4).take(pick),
                    ],
                    ["anchor", "s", "at", "w1", "w2", "m", "c"],
                )

    return run


def _hot_spans(hot: DataFrame, w: Windows) -> DataFrame:
    """The spans of stretches at hot anchors: all by aggregation."""
    s = F.struct(F.xxhash64("content").alias("a"), F.hash("content").alias("b"), F.octet_length("content").alias("n"))
    merged = hot.groupBy("anchor", "content").agg(F.min("_id").alias("m"), F.count("*").alias("c"))
    # a hot anchor's stretches: repeated as a whole beyond their first document, or by windows
    windows = merged.select("anchor", "content", s.alias("s"), "m", "c").mapInArrow(
        window_rows(w), "anchor long, s struct<a:long,b:int,n:int>, at int, w1 long, w2 long, m long, c long"
    )
    total = windows.groupBy("w1", "w2").agg(F.min("m").alias("least"), F.sum("c").alias("all"))
    judged = windows.join(total, ["w1", "w2"])
    if w.earlier:
        # of the stretch's first document only windows that an earlier document holds; of later ones all
        flagged = judged.filter("least < m")
    else:
        flagged = judged.filter("all >= 2 and c < 2")
    flagged = flagged.groupBy("anchor", "s").agg(F.collect_list("at").alias("ats"))
    rows = hot.select("_id", "_h", "anchor", "first", "last", s.alias("s"))
    wide = merged.select("anchor", s.alias("s"), "m", "c").join(flagged, ["anchor", "s"], "left")
    joined = rows.join(wide, ["anchor", "s"])
    whole = F.expr("_id > m") if w.earlier else F.expr("c >= 2")
    spans = F.when(whole, F.array(F.struct(F.col("first").alias("first"), F.col("last").alias("last")))).otherwise(
        F.transform("ats", lambda x: F.struct((F.col("first") + x).alias("first"), (F.col("first") + x).alias("last")))
    )
    return joined.select("_id", "_h", F.explode(spans).alias("x")).select("_id", "_h", "x.first", "x.last")


def repeated_windows(
    docs: DataFrame,
    w: Windows,
    shard: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    finer: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """docs (_id, _h, text) to (_id, _h, spans array<struct<first, last>>): the places of windows that repeat, inclusive.

    `shard` gets the stretches of whole anchors, sorted by anchor, document and place, and gives SPANS rows; so does `finer`, for anchors
    of `longer(w)` bytes. Without it hot anchors are not cut."""

    def solved(at: DataFrame, how: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
        return at.select(*STRETCH_COLUMNS).repartition("anchor").sortWithinPartitions("anchor", "_id", "_h", "first").mapInArrow(how, SPANS)

    pairs = docs.mapInArrow(anchor_rows(w), "_id long, _h long, anchor long, n long")
    repeated = F.col("a") < F.col("b") if w.earlier else F.col("n") >= 2
    shared = (
        pairs.groupBy("anchor")
        .agg(F.min("_id").alias("a"), F.max("_id").alias("b"), F.sum("n").alias("n"))
        .filter(repeated)
        .select("anchor", (F.col("n") > w.hot).alias("hot"))
    )
    listed = saved(
        pairs.select("_id", "_h", "anchor")
        .join(shared, "anchor")
        .groupBy("_id", "_h")
        .agg(F.collect_set(F.struct("anchor", "hot")).alias("l"))  # rows of one key have equal texts: once is enough
        .select("_id", "_h", F.col("l.anchor").alias("anchors"), F.col("l.hot").alias("hots"))
    )
    found = docs.join(listed, ["_id", "_h"]).select("_id", "_h", "text", "anchors", "hots").mapInArrow(stretch_rows(w), STRETCH)
    spans = solved(found.filter("not hot"), shard)
    some = listed.filter(F.array_contains("hots", True))
    if not some.isEmpty():
        found = docs.join(some, ["_id", "_h"]).select("_id", "_h", "text", "anchors", "hots").mapInArrow(stretch_rows(w), STRETCH)
        if finer is None:
            hot = saved(found.filter("hot").select(*STRETCH_COLUMNS))
        else:
            parts = saved(docs.join(some, ["_id", "_h"]).select("_id", "_h", "text", "anchors", "hots").mapInArrow(hot_parts(w), STRETCH.replace(" hot boolean,", "")))
            often = saved(parts.groupBy("anchor").count().filter("count > 1").select("anchor", (F.col("count") > w.hot).alias("hot")))
            spans = spans.unionByName(solved(parts.join(often.filter("not hot"), "anchor"), finer))
            hot = None if often.filter("hot").isEmpty() else saved(parts.join(often.filter("hot"), "anchor").select(*STRETCH_COLUMNS))
        if hot is not None:
            spans = spans.unionByName(_hot_spans(hot, w))
    return saved(spans.groupBy("_id", "_h").agg(F.collect_set(F.struct("first", "last")).alias("spans")))


def ids_repeat(docs: DataFrame, id_col: str) -> bool:
    """Whether any two rows share an id; null ids aside."""
    ids = docs.select(F.col(id_col).cast("long").alias("_id")).filter("_id is not null")
    return not ids.groupBy("_id").count().filter("count > 1").isEmpty()


def keyed(docs: DataFrame, id_col: str, text_col: str, repeat: bool) -> DataFrame:
    """(_id, _h, text, row): docs' rows whole in `row`. _h, the 64-bit hash of the text, keeps different texts of one id apart: those of
    null ids, and all if ids repeat. Where ids tell rows apart it is 0, which takes no space in shuffles."""
    own = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    h = F.xxhash64(text) if repeat else F.when(own.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
    return docs.select(F.coalesce(own, F.lit((1 << 63) - 1)).alias("_id"), h.alias("_h"), text.alias("text"), F.struct("*").alias("row"))
