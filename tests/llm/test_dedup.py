"""Operators 5, 7 and 10 against brute force, on the smallest tables and on odd ones."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from millrace.llm import _text, _windows, simhash, substring_dedup, suffix_dedup
from millrace.llm._text import STEP_BYTES, runs, sliding_argmin, text_bytes, word_bounds
from millrace.llm._windows import Windows, stretches
from millrace.llm.components import components
from millrace.llm.substring_dedup import SuffixAutomaton, remove_repeated_words
from millrace.llm.suffix_dedup import radix_groups, remove_repeated_bytes, without_repeated_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = (1 << 63) - 1  # what a null id counts as


def sha(b):
    return hashlib.sha256(b).hexdigest()


def words_expected(rows, width):
    first = {}
    for k, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, BIG + 1), BIG if k is None else k)
    out = []
    for k, t in rows:
        w = WORD.findall(t or "")
        hit = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (BIG if k is None else k):
                hit[i : i + width] = [True] * width
        out.append((k, len(w), sum(hit), sha(" ".join(x for x, h in zip(w, hit, strict=True) if not h).encode())))
    return sorted(out, key=str)


def bytes_expected(rows, width):
    count = Counter()
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for k, b in data:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                hit[i : i + width] = True
        rest = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out.append((k, len(b), int(hit.sum()), len(runs(hit)), sha(rest)))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(3)
    words = ["a", "bé", "c,", "dd", "ß", "the"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(40) for _ in range(3)]
    rows = [(i, f"{prose(rng.randrange(30))}\t{rng.choice(shared)}\n{prose(rng.randrange(30))}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "a"), (None, shared[0]), (BIG, "last " + shared[1]), (7, rows[7][1]), (8, "other text of a known id " + shared[1]), (104, prose(4000)), (105, "be " * 300), (106, " x y")]
    return rows


@pytest.mark.parametrize("hot", [50_000, 2])
def test_repeated_words(spark, documents, hot):
    rows = odd_rows()
    got = remove_repeated_words(documents(*rows), width=8, hot=hot).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == words_expected(rows, 8)


@pytest.mark.parametrize("hot", [50_000, 2])
def test_repeated_bytes(spark, documents, hot):
    rows = odd_rows()
    got = remove_repeated_bytes(documents(*rows), width=40, hot=hot).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == bytes_expected(rows, 40)


@pytest.mark.parametrize("width", [99, 100])
def test_common_sentences_need_no_hashed_windows(spark, documents, monkeypatch, width):
    """A sentence of 60 bytes in each text, with 12 kinds of text around it: its anchors are hot, but no longer string is."""
    rng = random.Random(15)
    sentence = "this one sentence of sixty bytes stands in all of the texts."
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    around = [(own(70), own(70)) for _ in range(12)]
    rows = [(i, own(90) + a + sentence + b + own(80)) for i in range(120) for a, b in [(rng.choice(around)[0] if i % 2 else own(70), rng.choice(around)[1] if i % 3 else own(70))]]
    monkeypatch.setattr(_windows, "_hot_spans", lambda *_: pytest.fail("windows are hashed"))
    got = remove_repeated_bytes(documents(*rows), width=width, hot=40).drop("kept").collect()
    want = bytes_expected(rows, width)
    assert sorted(map(tuple, got), key=str) == want and sum(r[2] > 0 for r in want) > 20


def low_bits_agree(passage):
    """A text that holds the passage and one that doesn't, whose XXH64 agree in their lower 24 bits."""
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & ((1 << 24) - 1)
    with_it = {low(t): t for i in range(20_000) for t in [f"{i} start {passage} end"]}
    return next((with_it[h], t) for i in range(20_000) for t in [" ".join(f"w{i}x{j}" for j in range(70))] if (h := low(t)) in with_it)


@pytest.mark.parametrize("key", [None, 9])
def test_texts_of_one_id_stay_apart(spark, documents, key):
    passage = " ".join(f"shared{j}" for j in range(20))
    a, b = low_bits_agree(passage)
    rows = [(1, passage), (key, a), (key, b), *[(key, "again " + passage)] * 5]
    assert sorted(map(tuple, remove_repeated_words(documents(*rows), width=8).drop("kept").collect()), key=str) == words_expected(rows, 8)
    assert sorted(map(tuple, remove_repeated_bytes(documents(*rows), width=40).drop("kept").collect()), key=str) == bytes_expected(rows, 40)
    assert b in {r.text for r in without_repeated_bytes(documents(*rows), width=40).collect()}


def of_one_passage(rng, n):
    """n texts with one passage each, their own words around it, some of them alike or with a word changed."""
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for i in range(n):
        p = passage[rng.randrange(10) :]
        if i % 5 == 0:
            p = [*p[:30], rng.choice(words), *p[31:]]
        own = [rng.choice(words) for _ in range(rng.randrange(12))]
        out.append((i, " ".join([*own, *p, *own[:4]]) if i % 7 else out[-1][1] if out else ""))
    return out


def shard_spans(rows, w, shard):
    """What a task of one shard gives for all stretches of rows, without Spark."""
    data, offsets = text_bytes(pa.array([t for _, t in rows]))
    s = stretches(data, offsets, w)
    buf = data.tobytes()
    content = [b" ".join(buf[x:y].split()) if w.unit == "word" else buf[x:y] for x, y in zip(s.byte_start.tolist(), s.byte_end.tolist(), strict=True)]
    got = sorted(zip(s.anchor.tolist(), [rows[r][0] for r in s.row], [0] * len(s.row), s.first.tolist(), s.last.tolist(), content, strict=True))
    cols = [[r[i] for r in got] for i in (1, 2, 0, 3, 4, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_id", "_h", "anchor", "first", "last", "content"])
    out = set()
    for b in shard(iter([batch])):
        for doc, _, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out |= {(doc, x) for x in range(first, last + 1)}
    return out


@pytest.mark.parametrize("ordered", [1 << 20, 2_000, 60])
def test_large_anchors_are_ordered_in_passes(ordered):
    rows = of_one_passage(random.Random(4), 300)
    data = [(k, t.encode()) for k, t in rows]
    count = Counter(b[i : i + 60] for _, b in data for i in range(len(b) - 59))
    expected = {(k, i) for k, b in data for i in range(len(b) - 59) if count[b[i : i + 60]] > 1}
    w = Windows("byte", 60, 15, False)
    assert shard_spans(rows, w, suffix_dedup._shard(60, 15, ordered=ordered)) == expected


@pytest.mark.parametrize("many", [256, 1])
def test_large_anchors_share_a_small_automaton(many):
    rows = of_one_passage(random.Random(5), 400)
    words = [(k, t.split()) for k, t in rows]
    first = {}
    for k, t in words:
        for i in range(len(t) - 7):
            first.setdefault(tuple(t[i : i + 8]), k)
    expected = {(k, i) for k, t in words for i in range(len(t) - 7) if first[tuple(t[i : i + 8])] < k}
    assert shard_spans(rows, Windows("word", 8, 5, True), substring_dedup._shard(8, many=many)) == expected


def test_parts_of_an_anchor_are_bounded():
    """Stretches of one anchor, each with its own text around it: no pass orders many more suffixes than it may."""
    rng = random.Random(6)
    rows = of_one_passage(rng, 300)
    data, offsets = text_bytes(pa.array([t for _, t in rows]))
    s = stretches(data, offsets, Windows("byte", 60, 15, False))
    buf = data.tobytes()
    got = sorted((a, r, 0, f, e, buf[x:y]) for a, r, f, e, x, y in zip(s.anchor.tolist(), s.row.tolist(), s.first.tolist(), s.last.tolist(), s.byte_start.tolist(), s.byte_end.tolist(), strict=True))
    got = [(r, h, a, f, e, c) for a, r, h, f, e, c in got]
    parts = list(suffix_dedup._passes(got, 60, 15, 500))
    assert all(sum(len(c) - 59 for c in {(r[2], r[5]): r[5] for r in p}.values()) <= 500 for p in parts)
    assert sum(r[4] - r[3] + 1 for p in parts for r in p) == sum(r[4] - r[3] + 1 for r in got)


def test_memory_of_anchor_steps_is_small():
    """A worker's arrays for a batch of 8 MB stay below 80 MB (61 MB; 153 MB before)."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 4000).astype(np.uint8).tobytes().decode() for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([0] * 2000), pa.array(texts)], ["_id", "_h", "text"])
    w = Windows("byte", 200, 32, False)
    tables = dict(_text._powers)
    _text._powers.clear()
    tracemalloc.start()
    try:
        found = {r for b in _windows.anchor_rows(w)(iter([batch])) for r in zip(*(b.column(i).to_pylist() for i in (0, 2)), strict=True) if r[0] % 500 == 0}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        _text._powers.update(tables)
    expected = set()
    for k in range(0, 2000, 500):
        data = np.frombuffer(texts[k].encode(), np.uint8)
        at = np.arange(len(data) - 32 + 1)
        grams = _text.range_hashes(_text.BYTE_VALUES[0][data], at, at + 32, _text.BASES[0])
        least = [i + int(np.argmin(grams[i : i + 169] >> np.uint64(28))) for i in range(4000 - 200 + 1)]
        expected |= {(k, int(x)) for x in grams[least].view(np.int64)}
    assert found == expected
    assert peak < 80e6


def test_argmin_of_long_texts_in_halves():
    order = np.random.default_rng(2).integers(0, 1 << 63, 5_000).astype(np.uint64)
    order[1_000:1_200] = order[1_000]
    assert (sliding_argmin(order, 30, 100) == sliding_argmin(order, 30)).all()


def test_real_tables(spark, real):
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    assert sorted(map(tuple, remove_repeated_words(real).drop("kept").collect()), key=str) == words_expected(rows, 13)
    assert sorted(map(tuple, remove_repeated_bytes(real).drop("kept").collect()), key=str) == bytes_expected(rows, 400)


def test_empty_tables(spark, documents):
    none = documents((1, "x")).limit(0)
    assert remove_repeated_words(none).count() == remove_repeated_bytes(none).count() == simhash.near_duplicates(none).count() == 0


def test_rewriting_keeps_columns_and_characters(spark, documents):
    rows = [(1, "é" * 60 + "tail"), (2, "x" + "é" * 60), (3, None)]
    got = {r.doc_id: r for r in without_repeated_bytes(documents(*rows), width=40).collect()}
    assert [got[k].text for k in (1, 2, 3)] == ["tail", "x", None] and got[1].size == "x" and got[1].anchor == 1


def test_suffix_automaton():
    rng = random.Random(1)
    a, known = SuffixAutomaton(), []
    for _ in range(12):
        seq = [rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(1, 15))]
        for i, n in enumerate(a.matching(seq)):
            best = max((k for k in range(i + 2) for s in known for j in range(len(s) - k + 1) if k and s[j : j + k] == seq[i + 1 - k : i + 1]), default=0)
            assert n == best
        a.add(seq)
        known.append(seq)


def test_radix_groups():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    starts = np.arange(0, 340)
    group = starts % 3
    want = Counter((int(g), data[s : s + 12].tobytes()) for s, g in zip(starts, group, strict=True))
    assert radix_groups(data, starts, group, 12).tolist() == [want[int(g), data[s : s + 12].tobytes()] > 1 for s, g in zip(starts, group, strict=True)]


def test_helpers():
    x = np.array([5, 3, 3, 9, 1, 7], np.uint64) << np.uint64(40)
    assert sliding_argmin(x, 3).tolist() == [1, 1, 4, 4]
    s, e, rows = word_bounds(np.frombuffer(b"ab c de", np.uint8), np.array([0, 0, 4, 7]))
    assert (s.tolist(), e.tolist(), rows.tolist()) == ([0, 3, 5], [2, 4, 7], [0, 0, 2, 3])
    assert STEP_BYTES > 0


def fingerprint(text, size=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, min(1, len(words))))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_near_duplicates(spark, documents, real):
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()] + [(-1, None), (-2, " \n"), (-3, "A b"), (-4, "a B"), (-4, "a B"), (-5, "Éa"), (-6, "éa"), (-7, "a very long text " * 40_000)]
    got = simhash.near_duplicates(documents(*rows)).collect()
    fp = {k: fingerprint(t) for k, t in rows}
    assert len(got) == len(rows) and all(r.fingerprint == format(fp[r.doc_id], "016x") for r in got)
    ids = sorted(fp)
    want = classes(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {r.doc_id: r.component_id for r in got} == want


def word_shingles(text, size=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, min(1, len(words))))}


def similar_classes(texts):
    """Classes of places whose shingle sets have a Jaccard similarity of 0.8 or more."""
    sets = [word_shingles(t) for t in texts]
    near = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9
    return classes(range(len(sets)), [(i, k) for i, x in enumerate(sets) for k, y in enumerate(sets[:i]) if near(x, y)])


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_similar_texts(spark, documents, real):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    rows += [(10_000 + i, edited(base, i % 14, rng)) for i in range(90)]  # similarities from 1 to 0.7
    rows += [(-1, None), (-2, " \n"), (-3, "A b"), (-4, "a B"), (-4, "a B"), (-5, "Éa"), (-6, "éa"), (None, rows[3][1]), (None, "only here"), (None, "only here"), (1, "another text of a known id"), (20_000, "long " + " ".join(base) * 40)]
    of = similar_classes([t for _, t in rows])
    best = {}
    for i, (k, t) in enumerate(rows):
        best.setdefault(of[i], []).append((k is None, k or 0, t or ""))
    want = sorted(str(min(x)[:2]) for x in best.values())
    got = simhash.without_near_duplicates(documents(*rows))
    assert sorted(str((r.doc_id is None, r.doc_id or 0)) for r in got.collect()) == want and got.columns == documents((1, "x")).columns
    keys = documents(*rows).selectExpr("coalesce(doc_id, 0) as id", "doc_id is null as none", "xxhash64(coalesce(text, '')) as h", "1L as t", "coalesce(text, '') as text")
    usual, finer = ({tuple(r) for r in simhash.similar_texts(keys, large=n).collect()} for n in (4096, 3))
    assert len(finer) == len(usual) and len({r[-1] for r in finer}) == len({r[-1] for r in usual})


def test_similar_texts_of_one_template(spark, documents):
    """Texts of one template share most bands, so that buckets hold far more than SMALL classes: what a spanning forest of candidates
    misses stays below one in ten."""
    rng = random.Random(8)
    template = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(400):
        words = [f"v{k}x{i}" if rng.random() < 0.12 else w for i, w in enumerate(template)]
        texts.append(" ".join(words))
        if k % 2:
            at = rng.randrange(140)
            texts.append(" ".join([*words[:at], f"n{k}", *words[at + 1 :]]))  # a near copy of its own
    expected = similar_classes(texts)
    pairs = [(k, c) for k, c in expected.items() if k != c]
    kept = {r.doc_id for r in simhash.without_near_duplicates(documents(*((k, t, "en", "s") for k, t in enumerate(texts)))).collect()}
    assert len(pairs) >= 200 and {c for c in expected.values()} <= kept  # no first one of a group goes
    assert sum(k not in kept for k, _ in pairs) >= 0.9 * len(pairs)


def template_texts(rng, n, words=150, share=0.12):
    """Texts that each change a share of one template's words at random: their similarities lie on both sides of 0.8."""
    return [" ".join(f"v{rng.randrange(10**9)}" if rng.random() < share * rng.random() else f"w{k}" for k in range(words)) for _ in range(n)]


@pytest.mark.parametrize("large", [4096, 40])
def test_no_link_of_similar_texts_is_left_out(spark, large):
    """Large buckets, short and long texts: the components are those of brute force, whatever the buckets' parts."""
    rng = random.Random(11)
    texts = template_texts(rng, 150) + template_texts(rng, 60, 12, 0.2) + template_texts(rng, 20, 900, 0.04) + ["", "a b", "A b", "b a"]
    for k in range(80):  # texts of one template are at 0.76 or less, but each has one at 0.8 or more
        at = rng.sample(range(4, 146, 6), 5)
        texts += [" ".join(f"u{k}x{i}" if i in at[:n] else f"t{i}" for i in range(150)) for n in (2, 4 + k % 2)]
    for k in range(60):  # pairs at 0.8 and a little more or less
        own = [f"c{k}x{i}" for i in range(40 + k)]
        at = rng.randrange(5, len(own) - 5)
        texts += [" ".join(own), " ".join([*own[:at], "other", *own[at + 1 :]])]
    expected = similar_classes(texts)
    df = spark.createDataFrame([(i, False, 1, 1, t) for i, t in enumerate(texts)], "id long, none boolean, h long, t long, text string")
    groups = {}
    for r in simhash.similar_texts(df, large=large).collect():
        groups.setdefault(r.component, set()).add(r.id)
    want = {}
    for i, c in expected.items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and 100 < len(want) < len(texts) - 100


def test_prefixes_of_similar_sets_meet():
    """Every pair of the similarity shares a shingle of its prefixes and passes the bounds, whatever the order of the slots."""
    rng = random.Random(12)
    texts = template_texts(rng, 150, 60, 0.2) + template_texts(rng, 60, 9, 0.3)
    sets = [word_shingles(t) for t in texts]
    one = pa.array([0] * len(texts))
    batch = pa.RecordBatch.from_arrays([one, one, one, one, pa.array(texts)], ["id", "none", "h", "t", "text"])
    for seed in range(3):
        ranks = np.random.default_rng(seed).permutation(simhash.SLOTS).astype(np.uint16)
        (out,) = simhash.prefix_rows(5, 0.8, ranks)(iter([batch]))
        prefix, n, fp = (out.column(c).to_pylist() for c in ("prefix", "n", "fp"))
        assert n == [len(x) for x in sets]
        fp, n = np.array(fp, np.int64).view(np.uint64), np.array(n)
        near = [(i, k) for i in range(len(sets)) for k in range(i) if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])]
        assert len(near) > 30 and all(set(prefix[i]) & set(prefix[k]) for i, k in near)
        assert simhash.may_be_similar(fp, n, *np.array(near).T, 0.8).all()


def test_large_groups_are_one_tree():
    rng = np.random.default_rng(5)
    one = rng.integers(0, 1 << 63, simhash.WIDE, dtype=np.uint64)
    group = np.repeat(one[None], 300, axis=0)
    for x in group[1:]:
        x[rng.integers(simhash.WIDE)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    other = rng.integers(0, 1 << 63, (200, simhash.WIDE), dtype=np.uint64)
    a, b = simhash.similar_pairs(np.concatenate([group, other]))
    assert len(a) == 299 and set(classes(range(500), zip(a.tolist(), b.tolist(), strict=True)).values()) == {0, *range(300, 500)}
    fp = np.concatenate([group[:20], other[:5], group[20:30]])
    pairs = [p for i, k in simhash.all_pairs(fp, np.array([0, 12, 25, 35]), at_once=9) for p in zip(i.tolist(), k.tolist(), strict=True)]
    want = [(i, k) for lo, hi in ((0, 12), (12, 25), (25, 35)) for i in range(lo, hi) for k in range(i + 1, hi) if np.bitwise_count(fp[i] ^ fp[k]).sum() <= simhash.WIDE_RADIUS]
    assert sorted(pairs) == want


def test_pairs_of_one_template_make_no_quadratic_table(spark, monkeypatch):
    """150 texts at 0.77 to 0.8 of each other, hardly a link among them: what is written grows with the texts, not with their pairs."""
    rng = random.Random(13)
    texts = []
    for k in range(150):
        at = set(rng.sample(range(3, 470, 7), 6))
        texts.append(" ".join(f"q{k}x{i}" if i in at else f"t{i}" for i in range(480)))
    kept, plain = [], simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df: kept.append(out := plain(df)) or out)
    df = spark.createDataFrame([(i, False, 1, 1, t) for i, t in enumerate(texts)], "id long, none boolean, h long, t long, text string")
    got = {r.id: r.component for r in simhash.similar_texts(df).collect()}
    want = similar_classes(texts)
    assert all((got[i] == got[k]) == (want[i] == want[k]) for i in got for k in range(i))
    pairs = [t.count() for t in kept if t.columns == ["a", "b"]]
    assert pairs and max(pairs) < 10 * len(texts)


def test_maps_of_long_texts():
    """Sets of thousands of shingles: those of the similarity pass at any two sizes of maps, unrelated ones don't; maps fold."""
    rng = random.Random(14)
    sizes = [300, 500, 540, 1000, 1050, 2100, 5000, 8100, 8500]
    texts = []
    for n in sizes:
        own = [f"v{rng.randrange(10**9)}" for _ in range(n)]
        texts += [" ".join(own), " ".join(own + [f"z{i}" for i in range(n // 5)]), edited(own, n // 60, rng)]
    one = pa.array([0] * len(texts))
    batch = pa.RecordBatch.from_arrays([one, one, one, one, pa.array(texts)], ["id", "none", "h", "t", "text"])
    (out,) = simhash.prefix_rows(5, 0.8, np.arange(simhash.SLOTS).astype(np.uint16))(iter([batch]))
    maps, n = simhash.Maps(out.column("fp")), out.column("n").to_numpy()
    assert sorted(set(maps.level.tolist())) == [0, 1, 2, 3, 4, 5]
    sets = [word_shingles(t) for t in texts]
    i, k = np.triu_indices(len(texts), 1)
    near = np.array([len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 for a, b in zip(i, k, strict=True)])
    met = maps.may_be_similar(n, i, k, 0.8)
    assert near.sum() >= 12 and met[near].all()
    assert not met[np.array([not sets[a] & sets[b] for a, b in zip(i, k, strict=True)])].any()


def test_clashing_columns_survive(spark):
    odd = ["_id", "_h", "row", "spans", "id", "none", "h", "t", "cls", "c0", "text_", "component", "stays", "_letters"]
    docs = spark.createDataFrame([(k, x, *[7 * k] * len(odd)) for k, x in ((1, "the same words stand here twice"), (2, "the same words stand here twice"), (3, "other words are in this one"))], ["doc_id", "text", *odd])
    for out in (simhash.without_near_duplicates(docs), without_repeated_bytes(docs, width=20)):
        got = out.collect()
        assert out.columns == docs.columns and len(got) >= 2 and all(r[c] == 7 * r.doc_id for r in got for c in odd)


def test_null_ids_join_components(spark, documents):
    got = simhash.near_duplicates(documents((None, "a b c"), (5, "a b c"), (None, "z"))).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, 5), (5, 5), (None, None)], key=str)


def near_numbers(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for b in rng.integers(0, 1 << 63, n).tolist():
        for _ in range(4):
            x = b
            for j in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << j
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_bit_sliced_comparison():
    fp = near_numbers(70)
    planes = simhash.planes_of(fp)
    for q in fp[:40].tolist():
        assert simhash.lanes(simhash.within(planes, q, 4), len(fp)) == [i for i, x in enumerate(fp.tolist()) if (x ^ q).bit_count() <= 4]
    links = simhash.bucket_links(fp, 4)
    assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= 4 for a, b in links)
    n = range(len(fp))
    assert classes(n, links) == classes(n, [(a, b) for a in n for b in range(a) if (int(fp[a]) ^ int(fp[b])).bit_count() <= 4])


def test_large_buckets_are_refined_without_losses(spark):
    fp = near_numbers(60, 1)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    usual = {tuple(r) for r in components(simhash.near_fingerprints(df)).collect()}
    assert usual == {tuple(r) for r in components(simhash.near_fingerprints(df, large=1)).collect()} and usual


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(300, 301), (301, 300), (302, 302)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300}
