"""Quality rules: counts of a text, and a linear-chain conditional random field over its lines.

Every line with a word is described by a few binned measures. The field's weights (a bin's leaning to content, and what follows
what) are trained by its likelihood on lines of a bounded sample of labelled documents. A line of a document of low quality stands
for boilerplate, one of high quality for content; since such documents never switch, what follows what is learnt from sequences
that splice lines of the one kind into the other. Viterbi decoding marks each line of a text content or boilerplate, and the share
of words in content decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._tables import received, sent

#: Labelled documents drawn of each label, lines taken of each, the lines of a training sequence, steps of the training, and its prior.
SAMPLE = 600
LINES = 192
SEQUENCE = 48
STEPS = 200
DECAY = 1e-3
#: A text is kept if this share of its words is in content lines.
LEAST_CONTENT = 0.5

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_BYTE = np.arange(256)
UPPER, LETTER = (_BYTE >= 65) & (_BYTE <= 90), ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
DIGIT, STOP, SHOUT = (_BYTE >= 48) & (_BYTE <= 57), np.isin(_BYTE, list(b".?!:;")), np.isin(_BYTE, list(b"!|"))
CODE_POINT = (_BYTE & 0xC0) != 0x80
#: Cuts of each measure into bins: words, mean word bytes, and shares of capitals, symbols, digits, marks, stops, doubled and repeated words, and whether the line came before.
CUTS = ((3, 6, 12, 40), (2.5, 4, 6, 9), (0.02, 0.1, 0.3, 0.6), (0.001, 0.02, 0.06, 0.15), (0.02, 0.1, 0.3), (0.01, 0.05, 0.2), (0.01, 0.1, 0.4), (0.01, 0.08, 0.3), (0.2, 0.4, 0.6, 0.8), (0.5,))
WIDTH = max(map(len, CUTS)) + 1


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[ends] - total[starts]


def _seen_before(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries repeat an earlier one of the same owner."""
    own = key ^ T.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    again = np.zeros(len(own), bool)
    again[order[1:]] = own[order[1:]] == own[order[:-1]]
    return again


class Lines:
    """The counts of each text of a step, and of its lines with a word their text, words and bins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(offsets) - 1
        starts, ends, at = T.word_bounds(data, offsets)
        self.n_words = np.diff(at)
        word_doc = np.repeat(np.arange(n), self.n_words)
        hashes = T.word_hashes(data, starts, ends)
        doc = lambda values: np.bincount(word_doc, weights=values, minlength=n).astype(np.int64)
        self.word_chars = doc(_sums(CODE_POINT[data], starts, ends))
        self.n_symbols = doc(_sums(SYMBOL[data], starts, ends))
        # words in windows of three that occur twice or more
        h = T.gram_hashes(hashes, 3)
        whole = np.flatnonzero(word_doc[: len(h)] == word_doc[2:]) if len(h) else np.zeros(0, np.int64)
        own = h[whole] ^ T.mix(word_doc[whole].astype(np.uint64) + np.uint64(1))
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        many = np.zeros(len(own), bool)
        many[order[1:]] |= same
        many[order[:-1]] |= same
        hit = np.zeros(len(starts), bool)
        for k in range(3):
            hit[whole[many] + k] = True
        self.n_repeat_words = doc(hit)
        # lines: cut at newlines and at texts' starts
        cuts = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
        line_of = np.searchsorted(cuts, starts, "right") - 1
        head = np.flatnonzero(np.append(True, line_of[1:] != line_of[:-1])) if len(starts) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(starts)) if len(head) else head
        self.doc = word_doc[head]
        self.words = tail - head
        a = cuts[line_of[head]]
        b = np.minimum(np.append(cuts, len(data))[line_of[head] + 1], offsets[self.doc + 1]) if len(head) else a
        b = b - ((b > a) & (data[np.maximum(b - 1, 0)] == 10)) if len(head) else b
        again = _seen_before(self.doc, T.range_hashes(T.BYTE_VALUES[0][data], a, b, T.BASES[0]))
        self.n_dup_lines = np.bincount(self.doc[again], minlength=n)
        line_word = np.repeat(np.arange(len(head)), self.words)
        of_line = lambda values: np.bincount(line_word, weights=values, minlength=len(head))
        size = np.maximum(of_line(ends - starts), 1)
        doubled = np.append(False, (hashes[1:] == hashes[:-1]) & (line_word[1:] == line_word[:-1])) if len(starts) else np.zeros(0, bool)
        words = np.maximum(self.words, 1)
        measures = [
            self.words,
            size / words,
            of_line(_sums(UPPER[data], starts, ends)) / np.maximum(of_line(_sums(LETTER[data], starts, ends)), 1),
            of_line(_sums(SYMBOL[data], starts, ends)) / size,
            of_line(_sums(DIGIT[data], starts, ends)) / size,
            of_line(_sums(SHOUT[data], starts, ends)) / size,
            of_line(STOP[data[ends - 1]] if len(ends) else np.zeros(0)) / words,
            of_line(doubled) / words,
            of_line(_seen_before(line_word, hashes)) / words,
            again,
        ]
        self.bins = np.stack([i * WIDTH + np.searchsorted(c, m, "right") for i, (c, m) in enumerate(zip(CUTS, measures, strict=True))], axis=1)


class Field:
    """emit: (bins, 2) weights of boilerplate and content; follow: (2, 2) of what comes after what; first: (2,) of the first line."""

    def __init__(self) -> None:
        self.emit, self.follow, self.first = np.zeros((len(CUTS) * WIDTH, 2)), np.zeros((2, 2)), np.zeros(2)

    def decode(self, lines: Lines, n: int) -> np.ndarray:
        """Whether each line is content, by the best sequence of each text."""
        score = self.emit[lines.bins].sum(axis=1)
        count = np.bincount(lines.doc, minlength=n)
        begin = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        longest = int(count.max(initial=0))
        active = np.searchsorted(-count[order], -np.arange(1, longest + 1), "right")  # texts of more than t lines
        back = np.zeros(score.shape, np.int8)
        best = np.zeros((n, 2))
        for t in range(longest):
            k = order[: active[t]]
            i = begin[k] + t
            if t == 0:
                best[k] = self.first + score[i]
                continue
            way = best[k][:, :, None] + self.follow[None]
            back[i] = way.argmax(axis=1)
            best[k] = way.max(axis=1) + score[i]
        out = np.zeros(len(score), np.int8)
        state = best.argmax(axis=1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            k = order[: active[t]]
            i = begin[k] + t
            out[i] = state[k]
            state[k] = back[i, state[k]]
        return out == 1


def fit(bins: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> Field:
    """(sequences, lines, measures), labels and mask of (sequences, lines): by gradient ascent (Adam) on the mean log-likelihood."""
    f = Field()
    s, t = labels.shape
    if not s:
        return f
    hot = np.eye(2)[labels] * mask[:, :, None]
    params = [f.emit, f.follow, f.first]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    total = mask.sum()
    both = mask[:, 1:] & mask[:, :-1]
    flat = bins[mask]

    def soft(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for step in range(1, STEPS + 1):
        score = f.emit[bins].sum(axis=2) * mask[:, :, None]
        ahead, behind = np.zeros((s, t, 2)), np.zeros((s, t, 2))
        ahead[:, 0] = f.first + score[:, 0]
        for i in range(1, t):
            new = soft(ahead[:, i - 1, :, None] + f.follow[None], 1) + score[:, i]
            ahead[:, i] = np.where(mask[:, i, None], new, ahead[:, i - 1])
        for i in range(t - 2, -1, -1):
            new = soft(f.follow[None] + (score[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
            behind[:, i] = np.where(mask[:, i + 1, None], new, 0)
        z = soft(ahead[:, -1], 1)
        p = np.exp(ahead + behind - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + f.follow + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        off = hot - p
        g_emit = np.zeros_like(f.emit)
        for m in range(bins.shape[2]):
            np.add.at(g_emit, flat[:, m], off[mask])
        g_follow = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum(axis=(0, 1)) - pair.sum(axis=(0, 1))
        grads = [g_emit / total, g_follow / total, off[:, 0].sum(axis=0) / total]
        for q, g, (m1, m2) in zip(params, grads, moment, strict=True):
            g = g - DECAY * q
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            q += 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return f


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) rows to (id, label, bins): the bins of the first LINES lines, one after the other."""
    for batch in batches:
        data, offsets = T.text_bytes(batch.column(2))
        bins: list[np.ndarray] = []
        for lo, hi in T.steps(offsets):
            x = Lines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            at = np.searchsorted(x.doc, np.arange(hi - lo + 1))
            bins += [x.bins[i : min(k, i + LINES)].ravel().astype(np.int16) for i, k in zip(at.tolist(), at[1:].tolist(), strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins, pa.list_(pa.int16()))], ["id", "label", "bins"])


def spliced(good: list[np.ndarray], bad: list[np.ndarray], seed: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bins, labels) of sequences in which a run of boilerplate stands somewhere in content, or of content in boilerplate."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(min(1, len(good), len(bad)) * max(len(good), len(bad))):
        a, b, y = good[i % len(good)], bad[i % len(bad)], 1
        if rng.random() < 0.5:
            a, b, y = b, a, 0
        a, b = a[: SEQUENCE // 2], b[: rng.integers(1, SEQUENCE // 2)]
        k = int(rng.integers(0, len(a) + 1))
        out.append((np.concatenate([a[:k], b, a[k:]]), np.repeat([y, 1 - y, y], [k, len(b), len(a) - k])))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """From about SAMPLE documents of each label, drawn by a hash of their ids; the bins of at most LINES lines of each come to the driver.

    Rows of labels without an id or a label of 0 or 1 count for nothing; of several for one id the larger label holds."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    place = F.shiftrightunsigned(F.xxhash64(F.lit(4), F.col("id")), 11).cast("double") / float(1 << 53)
    wanted = F.when(F.col("label") == 1, F.lit(SAMPLE / counts.get(1, 1))).otherwise(F.lit(SAMPLE / counts.get(0, 1)))
    drawn = F.broadcast(marked.filter(place < wanted))  # about 2 * SAMPLE ids: a bounded side
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    found = own.join(drawn, "id").select("id", "label", "text").mapInArrow(_binned, "id long, label int, bins array<short>")
    rows = sorted((r.id, r.label, r.bins) for r in found.toLocalIterator() if r.bins)
    by_label: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for _, label, flat in rows:
        by_label[label].append(np.array(flat, np.int64).reshape(-1, len(CUTS)))
    sequences = [(x[i : i + SEQUENCE], np.full(len(x[i : i + SEQUENCE]), label)) for label in (0, 1) for x in by_label[label] for i in range(0, len(x), SEQUENCE)]
    sequences += spliced(by_label[1], by_label[0])
    bins = np.zeros((len(sequences), SEQUENCE, len(CUTS)), np.int64)
    mask = np.zeros((len(sequences), SEQUENCE), bool)
    marks = np.zeros((len(sequences), SEQUENCE), np.int64)
    for i, (x, y) in enumerate(sequences):
        bins[i, : len(x)], mask[i, : len(x)], marks[i, : len(x)] = x[:SEQUENCE], True, y[:SEQUENCE]
    return fit(bins, marks, mask)


def _judge(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = received(shared)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(1))
            parts: dict[str, list] = {x: [] for x in [*names, "share"]}
            for lo, hi in T.steps(offsets, 1 << 20):
                x = Lines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for k in names:
                    parts[k].append(getattr(x, k))
                good = np.bincount(x.doc, weights=x.words * field.decode(x, hi - lo), minlength=hi - lo)
                parts["share"].append(good / np.maximum(x.n_words, 1))
            v = {k: np.concatenate([*p, np.zeros(0)]) for k, p in parts.items()}
            failed = (v["n_words"] < 50) | (100 * v["n_repeat_words"] > 50 * v["n_words"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(v[k].astype(np.int64)) for k in names),
                    pa.array(failed),
                    pa.array(~failed & (v["share"] >= least)),
                    pa.array(v["share"].astype(float)),
                ],
                ["doc_id", *names, "base_failed", "kept", "content_share"],
            )

    return run


def apply_rules(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_CONTENT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share) for each row of docs.

    Null and empty texts have no words and fail. Null ids and repeated rows come back as they are. A field that was trained on
    nothing marks every line boilerplate. Other columns are ignored. An empty table gives an empty result."""
    shared = sent(docs.sparkSession, field)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(
        _judge(shared, least),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double",
    )
