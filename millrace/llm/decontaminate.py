"""Benchmark items inside documents, by size-partitioned MinHash containment search and exact verification.

Items are partitioned by their number of shingles, in powers of two. An item's sketch is its k smallest shingle hashes, with k
set for its partition so large that a document which holds the wanted share of the item must hold some of the sketch: no leak
is missed, however long the document is. A document probes the sketches of all partitions with all its shingles; items with
enough hits are candidates, and exact shingle sets decide.

A benchmark of at most BLOCK_BYTES of text is sketched on the executors, gathered and broadcast, so that documents are searched
where they are. The sketches of a larger one stay a table, which the documents' shingles are joined with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._tables import received, saved, sent

#: Most bytes of benchmark text that is broadcast; a larger benchmark is joined. Sketches take about as much again.
BLOCK_BYTES = 8 << 20
#: Exact shingle sets of items that a task keeps.
KEPT_SETS = 256


@dataclass
class Sketches:
    """keys: sorted distinct sketch hashes; at: the n + 1 offsets of their items in `items`; needed: hits that make a candidate;
    words: each item's, joined by spaces, from which its exact shingles are made where it is a candidate."""

    keys: np.ndarray
    at: np.ndarray
    items: np.ndarray
    needed: np.ndarray
    ids: list[int]
    words: list[bytes]


def shingle_set(words: list[bytes], size: int) -> frozenset[bytes]:
    return frozenset(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))


def lowered(texts: pa.Array) -> pa.Array:
    """In lower case, letter by letter: the one rule for items and documents."""
    return pc.utf8_lower(texts)


def item_sketches(size: int, share: float):
    """(item_id, text) rows to (item_id, words, hashes, needed, partition): the sketch of each item of `size` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_bytes(lowered(batch.column(1)))
            starts, ends, rows = T.word_bounds(data, offsets, T.MARKS)
            grams = T.gram_hashes(T.word_hashes(data, starts, ends), size)
            buf, keep, joined, hashes, needed, partitions = data.tobytes(), [], [], [], [], []
            for r, (a, b) in enumerate(zip(rows.tolist(), rows[1:].tolist(), strict=False)):
                if b - a < size:
                    continue
                own = np.unique(grams[a : b - size + 1])
                n = len(own)
                partition = n.bit_length() - 1
                k = min(n, math.floor((1 - share) * 2 ** (partition + 1)) + 1)
                keep.append(r)
                joined.append(b" ".join(buf[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)))
                hashes.append(own[:k].view(np.int64))
                needed.append(max(1, k - (n - math.ceil(share * n - 1e-9))))  # what may be missing may all be in the sketch
                partitions.append(partition)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(joined, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(needed, pa.int64()), pa.array(partitions, pa.int32())],
                ["item_id", "words", "hashes", "needed", "partition"],
            )

    return run


SKETCH = "item_id long, words binary, hashes array<long>, needed long, partition int"


def gathered(rows: list) -> Sketches:
    """Sketch rows as one index."""
    key = np.concatenate([*(np.array(r.hashes, np.int64) for r in rows), np.zeros(0, np.int64)]).view(np.uint64)
    owner = np.repeat(np.arange(len(rows)), [len(r.hashes) for r in rows])
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    return Sketches(keys, np.append(first, len(order)), owner[order], np.array([r.needed for r in rows], np.int64), [r.item_id for r in rows], [bytes(r.words) for r in rows])


class Sets:
    """The exact shingles of items, made where they are asked for; the last KEPT_SETS stay."""

    def __init__(self, words: list[bytes], size: int) -> None:
        self.words, self.size, self.made = words, size, {}

    def __getitem__(self, item: int) -> frozenset[bytes]:
        own = self.made.pop(item, None)
        if own is None:
            own = shingle_set(self.words[item].split(b" "), self.size)
            if len(self.made) >= KEPT_SETS:
                del self.made[next(iter(self.made))]
        self.made[item] = own
        return own


def _hits(s: Sketches, sets: Sets, texts: pa.Array, size: int, share: float) -> tuple[list[int], list[int], list[int], list[int]]:
    """Rows, items, shared shingles and the items' shingles of all verified pairs."""
    data, offsets = T.text_bytes(lowered(texts))
    out: tuple[list[int], list[int], list[int], list[int]] = ([], [], [], [])
    for lo, hi in T.steps(offsets):
        if not len(s.keys):
            break
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, rows = T.word_bounds(part, offsets[lo : hi + 1] - offsets[lo], T.MARKS)
        grams = T.gram_hashes(T.word_hashes(part, starts, ends), size)
        at = np.minimum(np.searchsorted(s.keys, grams), len(s.keys) - 1)
        hit = np.flatnonzero(s.keys[at] == grams)
        row = np.searchsorted(rows, hit, "right") - 1
        whole = hit + size <= rows[row + 1]
        found = np.unique(np.stack([row[whole], at[hit[whole]]]), axis=1)
        width = s.at[found[1] + 1] - s.at[found[1]]
        pair_row = np.repeat(found[0], width)
        pair_item = s.items[np.repeat(s.at[found[1]] - np.cumsum(width) + width, width) + np.arange(width.sum())]
        pairs, n = np.unique(np.stack([pair_row, pair_item]), axis=1, return_counts=True)
        good = n >= s.needed[pairs[1]]
        buf, last, own = part.tobytes(), -1, frozenset()
        for r, item in pairs[:, good].T.tolist():
            if r != last:
                a, b = rows[r], rows[r + 1]
                own = shingle_set([buf[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)], size)
                last = r
            wanted = sets[item]
            both = len(own & wanted)
            if both >= share * len(wanted) - 1e-9:
                for values, x in zip(out, (lo + r, s.ids[item], both, len(wanted)), strict=True):
                    values.append(x)
    return out


def _search(shared, size: int, share: float):
    """(id, text) rows to (doc_id, item_id, shared, item_shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Sketches = received(shared)
        sets = Sets(s.words, size)
        for batch in batches:
            rows, *rest = _hits(s, sets, batch.column(1), size, share)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "shared", "item_shingles"])

    return run


def _clean(shared, at: int, size: int, share: float):
    """Rows of documents to those without a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Sketches = received(shared)
        sets = Sets(s.words, size)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[_hits(s, sets, batch.column(at), size, share)[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def _sketched(benchmark: DataFrame, item_col: str, size: int, share: float) -> tuple[DataFrame, bool]:
    """SKETCH rows of all items, and whether they may be broadcast."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").alias("item_text")).filter("item_text is not null")
    total = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    return items.mapInArrow(item_sketches(size, share), SKETCH), total <= BLOCK_BYTES


def _probe_rows(size: int):
    """(row, text) rows to (row, hash): the distinct shingle hashes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_bytes(lowered(batch.column(1)))
            for lo, hi in T.steps(offsets):
                part = data[offsets[lo] : offsets[hi]]
                starts, ends, rows = T.word_bounds(part, offsets[lo : hi + 1] - offsets[lo], T.MARKS)
                grams = T.gram_hashes(T.word_hashes(part, starts, ends), size)
                row = np.repeat(np.arange(hi - lo), np.diff(rows))[: len(grams)]
                whole = np.arange(len(grams)) + size <= rows[1:][row]
                row, grams = row[whole], grams[whole]
                order = np.lexsort((grams, row))
                head = np.append(True, (row[order][1:] != row[order][:-1]) | (grams[order][1:] != grams[order][:-1])) if len(order) else np.zeros(0, bool)
                pick = order[head]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[pick] + lo)), pa.array(grams[pick].view(np.int64))], ["row", "hash"])

    return run


def _verified(size: int, share: float):
    """(row, item, text, words) rows to (row, item_id, shared, item_shingles) of those that hold the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            texts = lowered(batch.column(2))
            for r in range(batch.num_rows):
                data, offsets = T.text_bytes(texts.slice(r, 1))
                starts, ends, _ = T.word_bounds(data, offsets, T.MARKS)
                buf = data.tobytes()
                own = shingle_set([buf[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], size)
                wanted = shingle_set(batch.column(3)[r].as_py().split(b" "), size)
                if (both := len(own & wanted)) >= share * len(wanted) - 1e-9:
                    for values, x in zip(out, (batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), both, len(wanted)), strict=True):
                        values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], ["row", "item_id", "shared", "item_shingles"])

    return run


def _joined(docs: DataFrame, sketches: DataFrame, text_col: str, size: int, share: float) -> tuple[DataFrame, DataFrame]:
    """docs, each row whole (`own`) with a number of its own (`_row`), and (row, item_id, shared, item_shingles) of what they hold, by a join of
    shingles with sketches: for benchmarks of any size."""
    numbered = saved(docs.select(F.struct("*").alias("own"), F.expr("uuid()").alias("_row")))
    items = saved(sketches.withColumn("item", F.expr("uuid()")))
    probes = numbered.select(F.col("_row").alias("row"), F.coalesce(F.col("own")[text_col], F.lit("")).alias("text")).mapInArrow(_probe_rows(size), "row string, hash long")
    pairs = probes.join(items.select("item", F.explode("hashes").alias("hash")), "hash").groupBy("row", "item").agg(F.count("*").alias("n"))
    likely = pairs.join(items.select("item", "item_id", "needed", "words"), "item").filter("n >= needed")
    whole = likely.join(numbered.select(F.col("_row").alias("row"), F.col("own")[text_col].alias("text")), "row").select("row", "item_id", "text", "words")
    return numbered, whole.mapInArrow(_verified(size, share), "row string, item_id long, shared long, item_shingles long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", size: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no benchmark item; by the rules of `contained_items`, without a shuffle
    where the benchmark can be broadcast."""
    sketches, small = _sketched(benchmark, item_col, size, share)
    if small:
        shared = sent(docs.sparkSession, gathered(sketches.collect()))  # of at most BLOCK_BYTES of text
        return docs.mapInArrow(_clean(shared, docs.columns.index(text_col), size, share), docs.schema)
    numbered, found = _joined(docs, sketches, text_col, size, share)
    return numbered.join(found.select(F.col("row").alias("_row")).distinct(), "_row", "left_anti").select("own.*")


def contained_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = 5, share: float = 0.8
) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): documents that hold at least `share` of the distinct shingles (of
    `size` words, in lower case, marks ignored) of a benchmark item.

    Items of fewer than `size` words, null items and null texts match nothing. Repeated rows of docs come back repeated; of
    repeated items each counts. Documents with a null id come back with a null. Other columns are ignored. An empty table on
    either side gives an empty result."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches, small = _sketched(benchmark, item_col, size, share)
    if small:
        shared = sent(docs.sparkSession, gathered(sketches.collect()))  # of at most BLOCK_BYTES of text
        out = own.mapInArrow(_search(shared, size, share), "doc_id long, item_id long, shared long, item_shingles long")
    else:
        numbered, found = _joined(own, sketches, "text", size, share)
        out = found.join(numbered.select(F.col("_row").alias("row"), "own.doc_id"), "row").select("doc_id", "item_id", "shared", "item_shingles")
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))
