"""Removal of word passages that an earlier document already holds, by suffix automata of reference shards.

The corpus is its own reference. A broadcast automaton of all of it would grow with the corpus, so the reference is cut into
shards by content (`_windows`): each shard holds all places where a given run of words occurs, is bounded, and meets there
exactly the documents that could match it. In a shard, documents come in order of their ids; each is streamed through the
suffix automaton of the earlier ones for its matching statistics (the longest match ending at each word), places where the
statistic reaches the window are marked, and then the document itself is added.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._windows import Windows, ids_repeat, keyed, repeated_windows


class SuffixAutomaton:
    """Of word sequences; each `add` starts anew at the root, so that matches never span two sequences."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:  # the prefix is known: only the state's length may need a split
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def matching(self, words: list[bytes]) -> list[int]:
        """The length of the longest known sequence that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        out = []
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            out.append(n)
        return out


#: Of a stretch: id, hash of the text, anchor, first and last window, content.
Row = tuple[int, int, int, int, int, bytes]


def _shared(rows: list[Row], width: int) -> list[Row]:
    """The stretches of one anchor, without windows that no other text of theirs holds. What stands around a common passage is
    each document's own; without it the stretches at the passage's ends are the same again, and the automaton stays small."""
    texts = list(dict.fromkeys(r[5] for r in rows))
    size = np.array([len(c) for c in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, at = T.word_bounds(data, np.append(0, np.cumsum(size)))
    windows = T.gram_hashes(T.word_hashes(data, starts, ends), width)
    own = np.arange(len(windows)) + width <= np.repeat(at[1:], np.diff(at))[: len(windows)]
    _, kind, n = np.unique(windows[own], return_inverse=True, return_counts=True)
    again = np.zeros(len(starts), bool)
    again[np.flatnonzero(own)] = n[kind] > 1
    begin, end = starts.tolist(), ends.tolist()
    buf = data.tobytes()
    parts = {c: [(i, j - 1, buf[begin[at[k] + i] : end[at[k] + j + width - 2]]) for i, j in T.runs(again[at[k] : at[k + 1]]).tolist()] for k, c in enumerate(texts)}
    many = Counter(r[5] for r in rows)
    out = []
    for doc, h, a, first, last, content in rows:
        if many[content] > 1:  # all its windows are another document's too
            out.append((doc, h, a, first, last, content))
        else:
            out += [(doc, h, a, first + i, first + j, c) for i, j, c in parts[content]]
    return out


def _shard(width: int, many: int = 256):
    """Stretches sorted by anchor and document to spans of windows that a document of a smaller id holds. An anchor with more than
    `many` stretches is read whole first, and only what its stretches share goes through the automaton."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Row]]:
        rows: list[Row] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if rows and rows[-1][2] != row[2]:
                    yield rows
                    rows = []
                rows.append(row)
        if rows:
            yield rows

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Row]]:
        """Whole anchors, some thousand rows at a time."""
        part: list[Row] = []
        for rows in anchors(batches):
            part += _shared(rows, width) if len(rows) > many else rows
            if len(part) >= 10_000:
                yield part
                part = []
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            anchor: int | None = None
            seen: dict[bytes, int] = {}
            waiting: list[tuple[int, bytes]] = []  # what was seen but isn't in the automaton yet, from `added` on
            added = 0
            auto: SuffixAutomaton | None = None
            ids, hs, firsts, lasts = [], [], [], []
            for doc, h, a, first, last, content in part:
                if a != anchor:
                    anchor, seen, waiting, added, auto = a, {}, [], 0, None
                before = seen.get(content)
                if before is not None:
                    if before < doc:
                        ids.append(doc)
                        hs.append(h)
                        firsts.append(first)
                        lasts.append(last)
                        continue
                if seen:
                    auto = auto or SuffixAutomaton()
                    while added < len(waiting) and waiting[added][0] < doc:
                        auto.add(waiting[added][1].split(b" "))
                        added += 1
                    hit = [i - width + 1 for i, n in enumerate(auto.matching(content.split(b" "))) if n >= width]
                    lo = prev = None
                    for x in [*hit, None]:
                        if lo is not None and x != prev + 1:
                            ids.append(doc)
                            hs.append(h)
                            firsts.append(first + lo)
                            lasts.append(first + prev)
                            lo = None
                        lo = x if lo is None else lo
                        prev = x
                if before is None:
                    seen[content] = doc
                    waiting.append((doc, content))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())],
                ["_id", "_h", "first", "last"],
            )

    return run


def _cut(width: int):
    """(id, h, text, spans) rows to (id, h, n_words, n_removed, kept words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(1))
            spans = batch.column(2)
            n, gone, kept = [], [], []
            for lo, hi in T.steps(offsets):
                part = data[offsets[lo] : offsets[hi]]
                starts, ends, rows = T.word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
                buf = part.tobytes()
                for r in range(hi - lo):
                    s, e = starts[rows[r] : rows[r + 1]], ends[rows[r] : rows[r + 1]]
                    found = spans[lo + r].as_py()
                    n.append(len(s))
                    if not found:
                        gone.append(0)
                        kept.append(b" ".join(buf[s[0] : e[-1]].split()) if len(s) else b"")
                        continue
                    hit = T.covered(np.array([(x["first"], x["last"] + width) for x in found]), len(s))
                    gone.append(int(hit.sum()))
                    kept.append(b" ".join(buf[x:y] for x, y in zip(s[~hit].tolist(), e[~hit].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, hot: int = 50_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of docs: its words without those covered by a window of
    `width` words that also starts in a document of a smaller id.

    Null and empty texts have no words. A null id counts as the largest id, 2^63 - 1, and comes back null. Rows that share an id never
    remove each other's words. Other columns of docs are ignored. An empty table gives an empty result."""
    w = Windows("word", width, min(5, width), True, hot)
    base = keyed(docs, id_col, text_col, ids_repeat(docs, id_col)).select("_id", "_h", "text", F.col("row")[id_col].cast("long").alias("own"))
    spans = repeated_windows(base.drop("own"), w, _shard(width))
    out = base.join(spans, ["_id", "_h"], "left").select("own", "text", "spans")
    return out.mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
