"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed into phrases, each the longest match in the
labelled text from where the last phrase ended. The fewer phrases, normalised by the length of the labelled text, the nearer the
language. Automata are small (a bounded reference text a language) and stand as dense tables, so that many places of many texts
are parsed at once: texts are cut into lanes of LANE symbols that step together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._tables import received, sent

#: Bytes of labelled text a language: the bounded sample learnt from. The documents drawn for it are of at most REFERENCE_CHARS
#: characters and, where those don't reach REFERENCE_BYTES, so many longer ones.
REFERENCE_BYTES = 24_000
REFERENCE_DOCS = 200
REFERENCE_CHARS = 4_000
LONGER_DOCS = 16
#: Symbols that are parsed in one go; every lane starts a phrase.
LANE = 512
#: The most languages that are told apart: their tables are broadcast.
MOST_LANGUAGES = 256
LETTER = r"\p{L}"
#: Mean bytes of a phrase under which no learnt language explains a text (texts of a learnt one have 3 or more, see the tests).
LEAST_PHRASE = 1.5
UNKNOWN = "und"


class Automaton:
    """The suffix automaton of a byte sequence, as a dense table of places: row state, column symbol class."""

    def __init__(self, symbols: list[int], classes: int) -> None:
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in symbols:
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
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = clone
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
            last = cur
        # states are numbered by their row's start; the last class is padding, which stays where it is; from the last state no
        # symbol leads on: texts start there, and so do phrases after a symbol that the language lacks
        self.table = np.full((len(nxt) + 1, classes), -1, np.int32)
        for s, edges in enumerate(nxt):
            for c, t in edges.items():
                self.table[s, c] = t * classes
        self.table[:, classes - 1] = np.arange(len(nxt) + 1) * classes
        self.size = max(2, len(symbols))

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """Phrases of each column of classes. A symbol that the language lacks is a phrase by itself."""
        flat = self.table.ravel()
        end = self.table[-1, -1]
        state = np.full(lanes.shape[1], end, np.int32)
        count = np.zeros(lanes.shape[1], np.int64)
        first = np.where(self.table[0] < 0, end, self.table[0])
        for row in lanes:
            to = flat[state + row]
            miss = to < 0
            count += miss
            state = np.where(miss, first[row], to)
        return count


def fold(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes, in which everything in ASCII but letters is a space, and their offsets."""
    data, offsets = T.text_bytes(pc.utf8_lower(texts))
    return np.where((data >= 0x80) | ((data >= 97) & (data <= 122)), data, np.uint8(32)), offsets


class Model:
    """classes: of each byte; the languages in order, and their automata."""

    def __init__(self, references: dict[str, bytes]) -> None:
        seen = np.zeros(256, bool)
        for text in references.values():
            seen[np.frombuffer(text, np.uint8)] = True
        known = np.flatnonzero(seen)
        self.n = len(known) + 2  # one class for all other bytes, one for padding
        self.classes = np.full(256, len(known), np.int32)
        self.classes[known] = np.arange(len(known))
        self.languages = sorted(references)
        self.automata = [Automaton(self.classes[np.frombuffer(references[x], np.uint8)].tolist(), self.n) for x in self.languages]

    def rates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages): normalised phrases, bits a byte, of each row; 0 for empty rows."""
        size = np.diff(offsets)
        lanes = -(-size // LANE)
        row = np.repeat(np.arange(len(size)), lanes)
        begin = offsets[row] + LANE * (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        end = np.minimum(begin + LANE, offsets[row + 1])
        order = np.argsort(begin - end, kind="stable")  # the longest first
        places = begin[order][None, :] + np.arange(LANE)[:, None]
        symbols = np.where(places < end[order][None, :], self.classes[data[np.minimum(places, max(0, len(data) - 1))]] if len(data) else 0, self.n - 1)
        out = np.zeros((len(size), len(self.automata)))
        for k, a in enumerate(self.automata):
            per_row = np.bincount(row[order], weights=a.phrases(symbols) if len(row) else None, minlength=len(size))
            out[:, k] = per_row * np.log2(a.size) / np.maximum(size, 1)
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """From all labelled documents that aren't empty, each language of which is learnt.

    About REFERENCE_DOCS of at most REFERENCE_CHARS characters are drawn by a hash for each language and taken whole, one after
    the other, until REFERENCE_BYTES are reached; longer ones, about LONGER_DOCS, fill up what is missing, to the byte."""
    length = F.length(text_col)
    text = F.substring(text_col, 1, REFERENCE_BYTES)  # no more of one document is needed
    labelled = docs.filter(F.col(lang_col).isNotNull() & (length >= 1)).withColumn("_longer", length > REFERENCE_CHARS)
    counted = labelled.groupBy(lang_col).agg(F.count_if(~F.col("_longer")), F.count_if("_longer"))
    counts = {r[0]: (r[1], r[2]) for r in counted.limit(MOST_LANGUAGES + 1).toLocalIterator()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Model({})
    place = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col(id_col)), 11).cast("double") / float(1 << 53)
    wanted = F.lit(0.0)
    for lang, (n, longer) in counts.items():
        share = F.when(F.col("_longer"), F.lit(LONGER_DOCS / max(1, longer))).otherwise(F.lit(REFERENCE_DOCS / max(1, n)))
        wanted = F.when(F.col(lang_col) == lang, share).otherwise(wanted)
    sample = labelled.filter(place < wanted).select(lang_col, text.alias("_text"), id_col, "_longer")
    parts: dict[str, tuple[list[tuple], list[tuple]]] = {x: ([], []) for x in counts}
    for lang, head, key, longer in sample.toLocalIterator():
        parts[lang][longer].append((key is None, key, head))
    out = {}
    for lang, found in parts.items():
        if not any(found):  # a tiny table: whatever comes first
            for head, longer in labelled.filter(F.col(lang_col) == lang).select(text, "_longer").limit(REFERENCE_DOCS).collect():
                found[longer].append((False, 0, head))
        usual, more = (fold(pa.array([t for _, _, t in sorted(x, key=lambda x: (x[0], x[1] or 0, x[2]))], pa.string())) for x in found)
        data, offsets = usual
        whole = int(np.searchsorted(offsets, min(REFERENCE_BYTES, offsets[-1])))
        own = data[: offsets[whole]].tobytes()
        out[lang] = own + more[0][: max(0, REFERENCE_BYTES - len(own))].tobytes()
    return Model(out)


def _judge(model: Model, texts: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """lang_pred, score and rate of each text."""
    data, offsets = fold(texts)
    pred, score, rate = [], [], []
    for lo, hi in T.steps(offsets, 1 << 20):
        r = model.rates(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if not model.languages:
            r = np.zeros((hi - lo, 1))
        best = r.argmin(axis=1)
        low = r[np.arange(hi - lo), best]
        rest = np.sort(r, axis=1)[:, 1] if r.shape[1] > 1 else np.full(hi - lo, np.inf)
        sure = np.where(np.isfinite(rest), rest / np.maximum(low + rest, 1e-12), 1.0)
        ok = letters[lo:hi] & bool(model.languages)
        pred += [model.languages[b] if o else UNKNOWN for b, o in zip(best.tolist(), ok.tolist(), strict=True)]
        score.append(np.where(ok, np.clip(sure, 0, 1), 0.0))
        rate.append(low)
    return pred, np.concatenate([*score, np.zeros(0)]), np.concatenate([*rate, np.zeros(0)])


def _predict(shared):
    """(id, text, letters) rows to (id, lang_pred, score, rate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(shared)
        for batch in batches:
            pred, score, rate = _judge(model, batch.column(1), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "rate"])

    return run


def _accept(shared, at: int, names: list[str], least: float):
    """Rows of documents, whether they have a letter last, to those rows that a language explains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(shared)
        most = np.log2(max(a.size for a in model.automata)) / least
        for batch in batches:
            last = batch.num_columns - 1
            texts = batch.column(at).fill_null("") if batch.column(at).null_count else batch.column(at)
            pred, _, rate = _judge(model, texts, batch.column(last).to_numpy(zero_copy_only=False))
            keep = pa.array([p != UNKNOWN and r <= most for p, r in zip(pred, rate.tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(last)], names).filter(keep)

    return run


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_PHRASE) -> DataFrame:
    """The rows of docs, all columns as they are whatever their names, whose text a language explains: its phrases in the best language
    are of `least` bytes or more on average. Null texts and those without a letter go.

    Where nothing was learnt, no text with a letter goes."""
    letters = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(LETTER)
    if not model.languages:
        return docs.filter(letters)
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*columns, letters.alias("letters")).mapInArrow(_accept(sent(docs.sparkSession, model), docs.columns.index(text_col), docs.columns, least), docs.schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rate) for each row of docs: the language of fewest normalised phrases; score is the runner-up's
    share of both rates (0.5: a tie, won by the first name); rate is bits a byte.

    Null texts and those without a letter are `und` with score 0, as are all where nothing was learnt. Null ids and repeated rows
    come back as they are. Other columns are ignored. An empty table gives an empty result."""
    shared = sent(docs.sparkSession, model)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text.rlike(LETTER).alias("letters"))
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, rate double")


def held_out(id_col: str, parts: int, part: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part
