"""Operators 3, 4 and 9: held-out accuracy, brute-force counts, and odd rows."""

import itertools
import math
import os
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from millrace.llm import language_id, quality_classifier, quality_rules
from millrace.llm.queries import op3_language_id, op4_quality_rules, op9_quality_classifier

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIDDLE = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_language_of_held_out_documents(spark):
    got = op3_language_id(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_cross_parsing_is_greedy_longest_match():
    model = language_id.Model({"a": b"abracadabra alakazam", "b": b"lorem ipsum dolor"})
    text = b"abra kazam lorem xyz dolorabra"
    data = np.frombuffer(text, np.uint8)

    def phrases(ref, s):
        n = i = 0
        while i < len(s):
            k = 1
            while i + k < len(s) and s[i : i + k + 1] in ref:
                k += 1
            i, n = i + k, n + 1
        return n

    rates = model.rates(data, np.array([0, len(data)]))[0]
    refs = {"a": b"abracadabra alakazam", "b": b"lorem ipsum dolor"}
    want = [phrases(refs[x], text) * math.log2(len(refs[x])) / len(text) for x in model.languages]
    assert np.allclose(rates, want)


def test_odd_texts_have_no_language(spark, documents):
    model = language_id.Model({"en": b"the cat and the dog", "de": b"der hund und die katze"})
    docs = documents((1, None), (2, ""), (3, "123 !?"), (4, "the dog"), (5, "Der Hund"), (None, "the"), (6, "ж"), (4, "the dog"), (7, "the dog and " * 5000))
    got = sorted((str(r.doc_id), r.lang_pred) for r in language_id.identify(docs, model).collect())
    assert [x for x in got if x[0] != "6"] == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("5", "de"), ("7", "en"), ("None", "en")]
    kept = language_id.accepted(docs, model)  # no language explains a letter of another script
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "5", "7", "None"]
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(docs)).collect()} == {"und"}  # nothing labelled
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_languages_of_long_documents_are_learnt(spark, documents):
    en, de = "the cat and the dog went out to the house ", "der hund und die katze gingen aus dem haus "
    docs = documents((1, en * 300, "en"), (2, en * 2000, "en"), (3, de, "de"), (4, de * 200, "de"), (5, "the dog and the house", None), (6, "die katze und das haus", None))
    model = language_id.train(docs)
    assert model.languages == ["de", "en"] and all(a.size <= language_id.REFERENCE_BYTES for a in model.automata)
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()} == {1: "en", 2: "en", 3: "de", 4: "de", 5: "en", 6: "de"}


def test_texts_of_a_language_are_explained(spark):
    """Phrases of held-out texts with a letter are far longer than the least; noise and other scripts are below it."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = language_id.train(docs.filter(~language_id.held_out("doc_id", 5, 0)))
    bits = math.log2(model.automata[0].size)
    rates = [r.rate for r in language_id.identify(docs, model).collect() if r.lang_pred != "und"]
    assert bits / max(rates) > 1.5 * language_id.LEAST_PHRASE
    noise = spark.createDataFrame([(1, "Ω≈ж привет мир это другой язык"), (2, "qxzj wvkq zxqv jjqz kxwq vvzq")], "doc_id long, text string")
    assert language_id.accepted(noise, model).filter("doc_id = 1").count() == 0
    assert language_id.accepted(docs, model).count() == docs.filter("text rlike '\\\\p{L}'").count()


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A driver that alone can import the package: models reach the workers by value."""
    script = tmp_path / "run.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from millrace.llm import decontaminate, language_id, quality_classifier, quality_rules
docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
print("ROWS", language_id.identify(docs, language_id.train(docs)).count(), quality_rules.apply_rules(docs, quality_rules.train(docs, labels)).count(),
      quality_classifier.score(docs, quality_classifier.train(docs, labels)).count(),
      decontaminate.contained_items(docs, spark.createDataFrame([(1, "the cat and the dog")], "item_id long, text string")).count())
"""
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 2 2 2 1" in done.stdout, done.stderr[-2000:]


def test_nothing_learnt_rejects_nothing(spark, documents):
    docs = documents((1, "the dog"), (2, "123"), (3, None), (4, "ж"))
    assert sorted(r.doc_id for r in language_id.accepted(docs, language_id.train(docs)).collect()) == [1, 4]


def test_quality_counts_are_exact(spark, documents, small):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = [*real, (None, "a b c a b c\nx\nx\n\n x"), (901, None), (902, ""), (903, "\n\n"), (904, "# * |\n# * |"), (905, "é ü " * 30), (905, "a\r\nb\r\na"), (906, "w " * 60)]
    got = sorted(map(tuple, quality_rules.apply_rules(documents(*rows), quality_rules.Field()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for k, t in rows:
        t = t or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for j in range(3)}
        want.append((k, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 2 * len(hit) > len(w)))
    assert got == sorted(want, key=str)


def test_field_finds_boilerplate(spark):
    got = op4_quality_rules(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.97 * len(got)
    assert all(r.kept for r in got if r.quality == 1)


@pytest.fixture(scope="module")
def half_trained(spark):
    """A field trained on half of the labelled rows, and the texts of the other half by label."""
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    out = language_id.held_out("doc_id", 2, 0)
    rows = docs.join(labels.filter(out), "doc_id").select("text", "quality").collect()
    return quality_rules.train(docs, labels.filter(~out)), *([r.text for r in rows if r.quality == q and WORD.search(r.text)] for q in (0, 1))


def test_held_out_documents_are_judged(spark, documents, half_trained):
    field, bad, good = half_trained
    docs = documents(*enumerate([*bad, *good]))
    got = [r for r in quality_rules.apply_rules(docs, field).collect() if not r.base_failed]
    assert sum(r.kept == (r.doc_id >= len(bad)) for r in got) >= 0.95 * len(got)


def test_sequences_switch_within_a_text(spark, documents, half_trained):
    """Held-out lines of both kinds joined to one text: each line is marked, and shares of content lie between."""
    field, bad, good = half_trained
    right = total = 0
    shares = []
    for i, (b, g) in enumerate(zip(bad, good, strict=False)):
        bad_lines, good_lines = ([x for x in t.split("\n") if WORD.search(x)][:6] for t in (b, g))
        k = i % (len(good_lines) + 1)
        text = "\n".join([*good_lines[:k], *bad_lines, *good_lines[k:]])
        want = [True] * k + [False] * len(bad_lines) + [True] * (len(good_lines) - k)
        lines = quality_rules.Lines(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        got = field.decode(lines, 1).tolist()
        right, total = right + sum(x == y for x, y in zip(got, want, strict=True)), total + len(want)
        shares.append((lines.words * np.array(got)).sum() / lines.words.sum())
    assert right >= 0.9 * total and sum(0.1 < x < 0.9 for x in shares) >= 0.6 * len(shares)


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(1)
    f = quality_rules.Field()
    f.emit[:], f.follow[:], f.first[:] = rng.normal(size=f.emit.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    texts = ["a b\nc, d!\n# |\nX Y", "one", "x\ny"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    lines = quality_rules.Lines(np.frombuffer(raw, np.uint8), offsets)
    got = f.decode(lines, 3)
    score = f.emit[lines.bins].sum(axis=1)
    for d in range(3):
        own = np.flatnonzero(lines.doc == d)
        value = lambda s: f.first[s[0]] + sum(score[i, x] for i, x in zip(own, s, strict=True)) + sum(f.follow[a, b] for a, b in zip(s, s[1:], strict=False))  # noqa: B023, E731
        assert tuple(got[own].astype(int)) == max(itertools.product((0, 1), repeat=len(own)), key=value)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 2, (30, 6))
    bins = np.repeat(labels[:, :, None], len(quality_rules.CUTS), axis=2) + np.arange(len(quality_rules.CUTS)) * quality_rules.WIDTH
    f = quality_rules.fit(bins, labels, np.ones((30, 6), bool))
    assert (f.emit[0, 0] > f.emit[0, 1]) and (f.emit[1, 1] > f.emit[1, 0])


def test_quality_of_held_out_documents(spark):
    got = op9_quality_classifier(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_odd_texts_get_scores(spark, documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    docs = documents((1, "good text here"), (2, "## bad ##"), (3, None), (4, ""), (None, "x"), (1, "good text here"), (5, "word " * 20000))
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    field = quality_rules.train(docs, labels)
    assert quality_rules.apply_rules(docs, field).count() == 7 and quality_rules.apply_rules(docs.limit(0), field).count() == 0
    assert quality_rules.train(docs.limit(0), labels).emit.any() == quality_rules.train(docs, labels.limit(0)).emit.any() == False  # noqa: E712


def test_folding_equals_the_softmax():
    rng = np.random.default_rng(3)
    table, out, bias = rng.normal(size=(1 << quality_classifier.ROWS_BITS, 4)), rng.normal(size=(2, 4)), rng.normal(size=2)
    raw = np.frombuffer(b"a few words, twice twice", np.uint8)
    rows, _ = quality_classifier.features(raw, np.array([0, len(raw)]))
    z = out @ table[rows].mean(axis=0) + bias
    want = 1 / (1 + math.exp(z[0] - z[1]))
    got = quality_classifier.Model(table @ (out[1] - out[0]), bias[1] - bias[0]).scores(raw, np.array([0, len(raw)]))
    assert got == pytest.approx([want])
