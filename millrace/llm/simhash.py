"""Near duplicates by SimHash, compared in bit-sliced blocks.

Fingerprints are 64 bits from the XXH64 values of word shingles. Equal fingerprints collapse into one class first. Two classes
at `radius` bits or less share at least two of `radius` + 2 slices of the fingerprint exactly, so each class goes to one bucket
a pair of slices. Within a bucket the fingerprints stand vertically: plane j holds bit j of 64 fingerprints in one machine word.
A query's bit flips a plane into differences, carry-save counters add up the planes for all fingerprints at once, and the
comparison of a block ends as soon as all its counters exceed the radius.

Slices find pairs of a few bits only. Similar texts (`similar_texts`) meet by prefixes of their shingle sets instead: in one order of
all shingles, two sets of a similarity t share one of the first n - ceil(t n) + 1 of each. Pairs are dropped by bounds that no similar
pair exceeds (sizes, and differing bits of parity maps); what is left of a bucket connects texts that may be similar, a forest of it goes
on. The texts of each component meet once, and there their exact shingle sets decide on all pairs that no link connects yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._tables import saved
from .components import components


def fingerprints(size: int, seed: int):
    """(id, text) rows to (id, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(1))
            out = np.zeros(batch.num_rows, np.uint64)
            for lo, hi in T.steps(offsets):
                part = T.LOWER[data[offsets[lo] : offsets[hi]]]
                starts, ends, rows = T.word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
                if not len(starts):
                    continue
                buf = part.tobytes()
                joined = b" ".join(buf[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True))
                length = ends - starts + 1
                end = np.cumsum(length) - 1
                begin = end - length + 1
                counts = np.diff(rows)
                full = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))  # of a short text one shingle, all of it
                row = np.repeat(np.arange(hi - lo), full)
                first = rows[row] + np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
                last = np.minimum(first + size, rows[row + 1]) - 1
                h = np.fromiter((digest(joined[x:y], seed) for x, y in zip(begin[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(row))
                some = np.flatnonzero(full)
                heads = (np.cumsum(full) - full)[some]
                ones = np.empty((len(some), 64), np.int64)
                for piece in range(8):
                    bits = np.unpackbits(((h >> np.uint64(8 * piece)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
                    ones[:, 8 * piece : 8 * piece + 8] = np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
                over = (2 * ones > full[some][:, None]).astype(np.uint64)
                out[lo + some] = (over << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def slices(parts: int) -> list[np.uint64]:
    """Masks that cut 64 bits into so many slices of nearly equal width."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def bucket_rows(radius: int, shared: int):
    """(fp) rows to (bucket, fp), one for each choice of `shared` slices out of radius + shared."""
    masks = slices(radius + shared)
    choices = [np.bitwise_or.reduce(c) for c in combinations(masks, shared)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, m in enumerate(choices):
                key = T.mix((fp & m) + np.uint64(i << 40 | 1))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["bucket", "fp"])

    return run


def planes_of(fp: np.ndarray) -> np.ndarray:
    """(blocks, 64) words: bit i of word [b, j] is bit j of fingerprint 64 b + i."""
    padded = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")  # block, fingerprint, bit
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def within(planes: np.ndarray, query: int, radius: int, start: int = 0) -> Iterator[tuple[int, int]]:
    """(block, word of those fingerprints at most `radius` bits from the query) of each block from `start` that has any."""
    levels = radius.bit_length()
    live = np.arange(start, len(planes))
    counters = np.zeros((levels, len(live)), np.uint64)
    over = np.zeros(len(live), np.uint64)
    full = ~np.uint64(0)
    for j in range(64):
        carry = planes[live, j] ^ (full if query >> j & 1 else np.uint64(0))
        for level in range(levels):  # carry-save: one half adder a level
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        over |= carry
        if j % 8 == 7:
            past = over | _above(counters, radius)
            keep = past != full
            if not keep.all():
                live, counters, over = live[keep], counters[:, keep], over[keep]
                if not len(live):
                    return
    near = ~(over | _above(counters, radius))
    yield from zip(live.tolist(), near.tolist(), strict=True)


def lanes(found: Iterator[tuple[int, int]], n: int) -> list[int]:
    """The places, below n, of the bits set in (block, word) pairs."""
    out = []
    for block, word in found:
        while word:
            low = word & -word
            word ^= low
            if (k := 64 * block + low.bit_length() - 1) < n:
                out.append(k)
    return out


def _above(counters: np.ndarray, radius: int) -> np.ndarray:
    """Which bit-sliced numbers exceed the radius."""
    above = np.zeros(counters.shape[1:], np.uint64)
    equal = ~above
    for level in reversed(range(len(counters))):
        if radius >> level & 1:
            equal = equal & counters[level]
        else:
            above |= equal & counters[level]
            equal = equal & ~counters[level]
    return above


#: Of buckets up to this many fingerprints, the differences of all pairs at one distance in the order stand in planes together.
SMALL = 48


def bucket_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest that connects what is linked among distinct fingerprints, in which each tree's links are of near pairs."""
    n = len(fp)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    planes = planes_of(fp)
    links = []
    for i, q in enumerate(fp.tolist()):
        for k in lanes(within(planes, q, radius, i // 64), n):
            if i < k and (a := root(i)) != (b := root(k)):
                parent[b] = a
                links.append((i, k))
    return links


def link_rows(radius: int):
    """(bucket, fp) rows sorted by bucket to (a, b) fingerprint links."""

    def flush(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Whole buckets, one after the other."""
        a, b = [], []
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(cuts, len(bucket)))
        for gap in range(1, SMALL):
            many = np.repeat((size > gap) & (size <= SMALL), size)
            if not many.any():
                break
            i = np.flatnonzero(many[: len(fp) - gap] & (bucket[gap:] == bucket[: len(fp) - gap]))
            if not len(i):
                continue
            near = i[lanes(within(planes_of(fp[i] ^ fp[i + gap]), 0, radius), len(i))]
            a.append(fp[near])
            b.append(fp[near + gap])
        for c, n in zip(cuts[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            own = fp[c : c + n]
            if links := np.array(bucket_links(own, radius)).reshape(-1, 2).tolist():
                i, k = zip(*links, strict=True)
                a.append(own[list(i)])
                b.append(own[list(k)])
        a, b = (np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bucket, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            bucket = np.concatenate([held_bucket, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(bucket):
                continue
            cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
            if cut:
                yield flush(bucket[:cut], fp[:cut])
            held_bucket, held_fp = bucket[cut:], fp[cut:]
        if len(held_bucket):
            yield flush(held_bucket, held_fp)

    return run


def refined_rows(radius: int, shared: int):
    """(bucket, fp) rows of large buckets to finer ones: `radius` + 1 further slices, of which one at least agrees too."""
    masks = slices(4 * (radius + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(radius + 1):
                m = np.bitwise_or.reduce(masks[i :: radius + 1])
                key = T.mix(bucket ^ T.mix((fp & m) + np.uint64(i + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1)], ["bucket", "fp"])

    return run


def near_fingerprints(classes: DataFrame, radius: int = 4, shared: int = 2, large: int = 20_000) -> DataFrame:
    """Distinct fingerprints (fp long) to links (a, b) that connect all pairs at `radius` bits or less.

    A bucket of more than `large` fingerprints is dealt out again by finer slices, in which every near pair meets once more."""
    dealt = classes.select("fp").mapInArrow(bucket_rows(radius, shared), "bucket long, fp long")
    wide = dealt.groupBy("bucket").count().filter(F.col("count") > large).select("bucket")
    usual = dealt.join(wide, "bucket", "left_anti")
    finer = dealt.join(wide, "bucket", "left_semi").mapInArrow(refined_rows(radius, shared), "bucket long, fp long")
    return usual.unionByName(finer).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(link_rows(radius), "a long, b long").distinct()


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row: texts in lower case (A-Z), shingles of `size` words with repeats, a bit is 1 if set in over half
    the shingles' XXH64. Shorter texts are one shingle; null texts and those without a word have fingerprint 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        fingerprints(size, seed), "doc_id long, fp long"
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs; component_id is the smallest doc_id reachable over links of
    `radius` bits or less, the own one included.

    Repeated rows come back repeated. Null ids count for no component's smallest id; a component of null ids alone has a null
    component_id. Other columns of docs are ignored. An empty table gives an empty result."""
    prints = saved(simhash(docs, id_col, text_col, size, seed))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(near_fingerprints(classes, radius))
    of_class = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_class.select("fp", "component").join(least, "component").select("fp", "component_id")
    return prints.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Similar texts: words of a parity map, the least; larger sets have 2, 4, ... times as many, so that a map has as many bits as the set has
#: shingles, and at most WIDE << MOST_LEVEL words. Within WIDE_RADIUS bits (of 64 * WIDE) a pair of a similarity of 0.8 usually lies, within
#: SURE_RADIUS bits most pairs are similar: these two only choose which pairs of a large bucket are looked at first.
WIDE = 8
WIDE_RADIUS = 110
SURE_RADIUS = 45
#: Shingles are ordered by how many fall in their slot, those of frequent ones last.
SLOTS = 1 << 16
MOST_LEVEL = 6
#: Shingles of the texts that are compared in one task, twice that at most.
TOGETHER = 1 << 21


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their rows, repeats included; a text of fewer words is one shingle."""
    part = T.LOWER[data]
    starts, ends, rows = T.word_bounds(part, offsets)
    words = T.word_hashes(part, starts, ends)
    counts = np.diff(rows)
    grams = T.gram_hashes(words, size)
    row = np.repeat(np.arange(len(counts)), counts)[: len(grams)]
    whole = np.arange(len(grams)) + size <= rows[1:][row]
    short = np.flatnonzero((counts > 0) & (counts < size))
    own = np.concatenate([grams[whole], T.range_hashes(words, rows[short], rows[short + 1], T.GRAM_BASES[1])])
    return own, np.concatenate([row[whole], short])


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and their rows."""
    own, row = _shingles(data, offsets, size)
    order = np.lexsort((own, row))
    own, row = own[order], row[order]
    first = np.append(True, (own[1:] != own[:-1]) | (row[1:] != row[:-1]))[: len(own)]
    return own[first], row[first]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def slot_counts(size: int):
    """(text) rows to (slot, n) of a task: its shingles by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(0))
            for lo, hi in T.steps(offsets):
                own, _ = _shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                n += np.bincount(_slots(own), minlength=SLOTS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["slot", "n"])

    return run


def slot_ranks(rows: DataFrame, size: int) -> np.ndarray:
    """Each slot's place in the order of how many shingles (of rows' texts) it has: SLOTS counts, whatever the input."""
    found = rows.select("text").mapInArrow(slot_counts(size), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SLOTS, np.int64)
    n[found["slot"].to_numpy()] = found["n"].to_numpy()
    ranks = np.empty(SLOTS, np.uint16)
    ranks[np.argsort(n, kind="stable")] = np.arange(SLOTS)
    return ranks


def prefix_rows(size: int, similarity: float, ranks: np.ndarray):
    """(id, none, h, t, text) rows to (id, none, h, t, cls, n, fp, prefix): a hash of the shingle set, its size, its parity map (how
    often each bit number occurs, modulo 2), and those of its shingles one of which each similar set's prefix shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(4))
            cls, n, words = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            maps, taken, length = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], np.zeros(batch.num_rows, np.int32)
            for lo, hi in T.steps(offsets):
                own, row = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                full = np.bincount(row, minlength=hi - lo)
                level = np.clip(np.ceil(np.log2(np.maximum(full, 1) / (64 * WIDE))), 0, MOST_LEVEL).astype(np.int64)
                words[lo:hi] = WIDE << level
                bits = 64 * WIDE << level
                place = np.repeat(np.cumsum(bits) - bits, full) + (own >> np.uint64(20)).astype(np.int64) % np.repeat(bits, full)
                odd = (np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)
                maps.append(np.packbits(odd, bitorder="little").view(np.uint64))
                if not len(own):
                    continue
                heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                some = row[heads]
                count = full[some]
                n[lo + some] = count
                cls[lo + some] = T.mix(np.add.reduceat(T.mix(own ^ np.uint64(0x5851F42D4C957F2D)), heads) + count.astype(np.uint64))
                order = np.argsort(row * SLOTS + ranks[_slots(own)], kind="stable")  # of one slot by hash
                most = count - np.ceil(similarity * count - 1e-9).astype(np.int64) + 1
                nth = np.arange(len(row)) - np.repeat(heads, count)
                taken.append(own[order][nth < np.repeat(most, count)])
                length[lo + some] = most
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(np.concatenate(taken).view(np.int64)))
            fp = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(words)).astype(np.int32)), pa.array(np.concatenate(maps).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(cls.view(np.int64)), pa.array(n), fp, lists], ["id", "none", "h", "t", "cls", "n", "fp", "prefix"])

    return run


def near_planes(planes: np.ndarray, queries: np.ndarray, radius: int, at_once: int = 64) -> Iterator[np.ndarray]:
    """Of each group of `at_once` queries (of several words) its (queries, blocks) words, whose bits stand for the fingerprints of the
    planes that are at most `radius` bits away."""
    levels, full = radius.bit_length(), ~np.uint64(0)
    for q in range(0, len(queries), at_once):
        own = queries[q : q + at_once]
        live = np.arange(len(planes))
        left = np.ascontiguousarray(planes.T)
        counters = np.zeros((levels, len(own), len(live)), np.uint64)
        over = np.zeros((len(own), len(live)), np.uint64)
        for j in range(len(left)):
            carry = left[j][None, :] ^ (full * ((own[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)))[:, None]
            for level in range(levels):  # carry-save: one half adder a level
                counters[level], carry = counters[level] ^ carry, counters[level] & carry
            over |= carry
            if j % 32 == 31:  # blocks leave once all their fingerprints are too far from all queries
                keep = ((over | _above(counters, radius)) != full).any(axis=0)
                if not keep.all():
                    live, left, counters, over = live[keep], left[:, keep], counters[:, :, keep], over[:, keep]
                    if not len(live):
                        break
        near = np.zeros((len(own), len(planes)), np.uint64)
        if len(live):
            near[:, live] = ~(over | _above(counters, radius))
        yield near


def similar_pairs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs within WIDE_RADIUS among the fingerprints of a large bucket: a forest of surely similar pairs and, between its
    trees, one of the others."""
    n = len(fp)
    tree = np.arange(n)
    a, b = [], []
    planes = np.concatenate([planes_of(np.ascontiguousarray(fp[:, k])) for k in range(fp.shape[1])], axis=1)
    for radius in (SURE_RADIUS, WIDE_RADIUS):
        for group, near in enumerate(near_planes(planes, fp, radius)):
            hit = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n]
            for i in range(64 * group, 64 * group + len(hit)):
                k = i + 1 + np.flatnonzero(hit[i % 64, i + 1 :])
                k = k[tree[k] != tree[i]]
                if not len(k):
                    continue
                k = k[np.unique(tree[k], return_index=True)[1]]
                tree[np.isin(tree, tree[k])] = tree[i]
                a.append(np.full(len(k), i))
                b.append(k)
    return np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])


def may_be_similar(fp: np.ndarray, n: np.ndarray, i: np.ndarray, k: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of places no bound rules out: sets of a similarity t differ in (1 - t) / (1 + t) of their sizes' sum at most, their
    parity maps in no more bits, and the smaller one has at least t times the larger one's size."""
    least, both = np.minimum(n[i], n[k]), n[i].astype(np.int64) + n[k]
    differ = np.bitwise_count(fp[i] ^ fp[k]).sum(axis=1, dtype=np.int64)
    return (differ * (1 + similarity) <= (1 - similarity) * both + 1e-6) & (least >= similarity * (both - least) - 1e-6)


def all_pairs(fp: np.ndarray, cuts: np.ndarray, at_once: int = 1 << 18, near=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of the same bucket (cut at `cuts`) that are `near` by their places, or else within WIDE_RADIUS; about `at_once`
    pairs are looked at together."""
    near = near or (lambda i, k: np.bitwise_count(fp[i] ^ fp[k]).sum(axis=1) <= WIDE_RADIUS)
    ends = np.repeat(cuts[1:], np.diff(cuts))
    partners = ends - np.arange(len(ends)) - 1  # later ones of the bucket
    upto = np.cumsum(partners)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + at_once, "right")))
        own = partners[lo:hi]
        i = np.repeat(np.arange(lo, hi), own)
        k = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        lo = hi
        if len(i):
            met = near(i, k)
            yield i[met], k[met]


class Maps:
    """Parity maps of several sizes. A map of twice the words folds to one of half as many by the exclusive or of its halves, so two maps
    are compared at the size of the smaller one."""

    def __init__(self, lists: pa.ListArray):
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        self.level = np.log2(np.maximum(np.diff(offsets) // WIDE, 1)).astype(np.int64)
        self.place, self.folds = [], []
        for at in range(int(self.level.max(initial=0)) + 1):
            rows = np.flatnonzero(self.level >= at)
            place = np.zeros(len(self.level), np.int64)
            place[rows] = np.arange(len(rows))
            fold = np.empty((len(rows), WIDE << at), np.uint64)
            for level in np.unique(self.level[rows]).tolist():
                own = np.flatnonzero(self.level == level)
                wide = values[offsets[own][:, None] + np.arange(WIDE << level)]
                fold[place[own]] = np.bitwise_xor.reduce(wide.reshape(len(own), 1 << (level - at), WIDE << at), axis=1)
            self.place.append(place)
            self.folds.append(fold)

    def may_be_similar(self, n: np.ndarray, i: np.ndarray, k: np.ndarray, similarity: float) -> np.ndarray:
        """`may_be_similar`, by the largest map that both have."""
        met = np.minimum(n[i], n[k]) >= similarity * np.maximum(n[i], n[k]) - 1e-6
        met[met] = may_be_similar(self.folds[0], n, i[met], k[met], similarity)
        common = np.where(met, np.minimum(self.level[i], self.level[k]), 0)
        for level in range(1, len(self.folds)):
            for own in np.array_split(at := np.flatnonzero(common == level), 1 + (len(at) << level >> 17)):
                place = self.place[level]
                sides, a = np.concatenate([i[own], k[own]]), np.arange(len(own))
                met[own] = may_be_similar(self.folds[level][place[sides]], n[sides], a, a + len(own), similarity)
        return met


class Trees:
    """A forest over places, which grows by pairs and keeps those that joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.of = np.arange(n)  # as of the last `add`
        self.a: list[int] = []
        self.b: list[int] = []

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def add(self, i: np.ndarray, k: np.ndarray) -> None:
        for x, y in zip(i.tolist(), k.tolist(), strict=True):
            if (u := self._root(x)) != (v := self._root(y)):
                self.parent[max(u, v)] = min(u, v)
                self.a.append(x)
                self.b.append(y)
        if len(i):
            of = np.array(self.parent)
            while (up := of[of] != of).any():
                of[up] = of[of[up]]
            self.of = of


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column and then their second in tables of whole keys, of `most` rows or a few more where keys are small. Rows that repeat
    the two of the row before them go."""
    held, size, last = [], 0, (None, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cls = (batch.column(x).to_numpy(zero_copy_only=False) for x in (0, 1))
        new = np.append((key[0], cls[0]) != last, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))
        last = (key[-1], cls[-1])
        if not new.all():
            batch, key = batch.filter(pa.array(new)), key[new]
            if not len(key):
                continue
        if size + len(key) > most and (key[0] != key[-1] or held and held[-1].column(0)[-1].as_py() != key[0]):
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cuts(key: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))


def _edges(cls: np.ndarray, trees: Trees) -> pa.RecordBatch:
    a, b = (cls[np.array(x, np.int64)] for x in (trees.a, trees.b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def candidate_rows(most: int, similarity: float):
    """(bucket, cls, n, fp) rows sorted by bucket and class to a forest (a, b) of each bucket that connects all its classes that may be
    similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, most):
            bucket, cls, n = (rows.column(i).to_numpy() for i in range(3))
            maps = Maps(rows.column(3).chunk(0))
            cuts, trees = _cuts(bucket), Trees(len(bucket))
            size = np.diff(cuts)
            for c, m in zip(cuts[:-1][size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                i, k = (c + x for x in similar_pairs(maps.folds[0][c : c + m]))
                met = maps.may_be_similar(n, i, k, similarity)
                trees.add(i[met], k[met])

            def near(i: np.ndarray, k: np.ndarray, n=n, maps=maps, trees=trees) -> np.ndarray:
                apart = trees.of[i] != trees.of[k]
                apart[apart] = maps.may_be_similar(n, i[apart], k[apart], similarity)
                return apart

            for i, k in all_pairs(maps.folds[0], cuts, near=near):
                trees.add(i, k)
            yield _edges(cls, trees)

    return run


def _meetings(own: np.ndarray, row: np.ndarray, m: int) -> Iterator[np.ndarray]:
    """Of each row the number of shingles that it shares with each of the m rows, when it is asked for by `send`."""
    _, shingle, often = np.unique(own, return_inverse=True, return_counts=True)
    again = often[shingle] > 1
    shingle, row = np.unique(shingle[again], return_inverse=True)[1], row[again]
    holders = row[np.argsort(shingle, kind="stable")]
    starts = np.append(0, np.cumsum(np.bincount(shingle)))
    held = shingle[np.argsort(row, kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(row, minlength=m)))
    i = yield np.zeros(0, np.int64)
    while True:
        shared = np.zeros(m, np.int64)
        mine = held[first[i] : first[i + 1]]
        upto = np.cumsum(starts[mine + 1] - starts[mine])
        for part in np.split(mine, np.flatnonzero(np.diff(upto >> 22)) + 1):
            count = starts[part + 1] - starts[part]
            at = np.repeat(starts[part] - np.cumsum(count) + count, count) + np.arange(count.sum())
            shared += np.bincount(holders[at], minlength=m)
        i = yield shared


def linked_rows(most: int, size: int, similarity: float):
    """(block, cls, part, text) rows sorted by block and class to a forest (a, b) of each block that connects its classes whose shingle
    sets have the Jaccard similarity; of a block of two parts only pairs between them are looked at."""

    def flush(cls: np.ndarray, part: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        m = len(cls)
        found = [(own, row + lo) for lo, hi in T.steps(offsets) for own, row in [shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)]]
        own, row = (np.concatenate(x) for x in zip(*found, strict=True))
        n = np.bincount(row, minlength=m)
        order = np.argsort(n, kind="stable")
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        n, cls, part = n[order], cls[order], part[order]
        ends = np.searchsorted(n, n / similarity + 1e-6, "right").tolist()
        crossing = part.min() != part.max()
        meetings, trees = _meetings(own, place[row], m), Trees(m)
        next(meetings)
        for i in range(m - 1):
            k = i + 1 + np.flatnonzero(trees.of[i + 1 : ends[i]] != trees.of[i])
            if crossing:
                k = k[part[k] != part[i]]
            if len(k):
                both = meetings.send(i)[k]
                k = k[both >= similarity * (n[i] + n[k] - both) - 1e-9]
                trees.add(np.full(len(k), i), k)
        yield _edges(cls, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, most):
            block, cls, part = (rows.column(i).to_numpy() for i in range(3))
            for lo, hi in zip((cuts := _cuts(block))[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield from flush(cls[lo:hi], part[lo:hi], *T.text_bytes(rows.column(3).chunk(0).slice(lo, hi - lo)))

    return run


ROW = ["id", "none", "h", "t"]


def _of_hashes(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows whose h is among the hashes, and a few others, so that the rest need no shuffle: a map of 16 bits or more a hash, made of
    words of 64, is broadcast (two bytes a hash, and its words' keys)."""
    words = max(1, hashes.count() // 4)
    word, bit = F.pmod("h", F.lit(words)), F.pmod(F.shiftright("h", 40), F.lit(64)).cast("int")
    bits = hashes.select(word.alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftright(h, 40), 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(bits), "word").filter(F.getbit("bits", bit) == 1).drop("word", "bits")


def similar_texts(rows: DataFrame, size: int = 5, similarity: float = 0.8, large: int = 4096) -> DataFrame:
    """rows (id, none, h, t, text) to (id, none, h, t, component): components of texts whose distinct shingles of `size` words (A-Z in
    lower case) have a Jaccard similarity of `similarity` or more. No link is left out; shingles are told apart by 64-bit hashes.

    Texts of equal shingle sets are one class. Classes that share a shingle of their prefixes meet in its bucket; of buckets of the same
    classes one stays. A forest of those that may be similar goes on, and the texts of each of its components meet once. A bucket of more
    than `large` classes, and a component of more or of over TOGETHER shingles, is dealt out by pairs of its parts."""
    ranks = slot_ranks(rows, size)
    prints = saved(rows.mapInArrow(prefix_rows(size, similarity, ranks), "id long, none boolean, h long, t long, cls long, n int, fp array<long>, prefix array<long>"))
    classes = saved(prints.groupBy("cls").agg(F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("prefix").alias("prefix"), F.min(F.struct("none", "id", "h", "t")).alias("first")))
    dealt = classes.select(F.explode("prefix").alias("bucket"), "cls").repartition("bucket")
    members = dealt.groupBy("bucket").agg(F.count("*").alias("of"), F.bit_xor("cls").alias("x"), F.bit_xor(F.xxhash64("cls")).alias("y")).filter("of > 1")
    counts = members.groupBy("of", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("of") / large).cast("int").alias("parts"))
    shared = saved(dealt.join(counts, "bucket").select("bucket", "cls", "parts"))

    def spread(at: DataFrame, key: str) -> DataFrame:
        """Rows once for each pair of parts that theirs is one of; `block` tells the pairs of a key apart."""
        spread = at.withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return spread.withColumn("block", F.when(F.col("parts") == 1, F.col(key)).otherwise(F.xxhash64(key, F.least("part", "with"), F.greatest("part", "with"))))

    met = spread(shared, "bucket").select("block", "cls").join(classes.select("cls", "n", "fp"), "cls").select("block", "cls", "n", "fp")
    edges = saved(met.repartition("block").sortWithinPartitions("block", "cls").mapInArrow(candidate_rows(large, similarity), "a long, b long").distinct())
    groups = saved(components(edges).withColumnRenamed("node", "cls").join(classes.select("cls", "n", "first"), "cls"))
    parts = groups.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / large), F.ceil(F.sum("n") / TOGETHER)).cast("int").alias("parts"))
    asked = spread(groups.join(parts, "component"), "component").select("block", "cls", "part", "first.*")
    texts = _of_hashes(rows, groups.select("first.h")).join(asked, ROW).select("block", "cls", "part", "text")
    links = texts.repartition("block").sortWithinPartitions("block", "cls").mapInArrow(linked_rows(large, size, similarity), "a long, b long")
    joined = components(links).withColumnRenamed("node", "cls")
    return prints.select(*ROW, "cls").join(joined, "cls", "left").select(*ROW, F.coalesce("component", "cls").alias("component"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns as they are, of one document a group of similar texts (`similar_texts`): the one of the smallest id,
    null ids last; of rows that share it the one of the smallest hash of its text and columns.

    Null and empty texts, and those without a word, are one group. Repeated rows are copies of each other. An empty table gives an
    empty result."""
    own, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    others = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keys = [F.coalesce(own, F.lit(0).cast("long")).alias("id"), own.isNull().alias("none"), F.xxhash64(text).alias("h"), F.xxhash64(*others).alias("t")]
    found = saved(similar_texts(docs.select(*keys, text.alias("text")), size, similarity))
    stays = found.groupBy("component").agg(F.min(F.struct("none", "id", "h", "t")).alias("k")).select("k.*").withColumn("stays", F.lit(True))
    gone = found.join(stays, ROW, "left").filter("stays is null").select(ROW).distinct()
    again = found.groupBy(ROW).count().filter("count > 1").select(ROW)
    packed = docs.select(F.struct("*").alias("row"), *keys).join(gone, ROW, "left_anti")
    if again.isEmpty():
        return packed.select("row.*")
    once = packed.join(again, ROW, "left_semi").dropDuplicates(ROW)
    return packed.join(again, ROW, "left_anti").unionByName(once).select("row.*")
