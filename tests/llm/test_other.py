"""Operators 1, 2, 6 and 8, the pipeline, and the queries' registration."""

import random
import re
from collections import defaultdict

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate, html_extract, mixing, queries, token_counts

MARKS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href=/a>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>The &amp; title</h1></header><p>First  para
with <b>bold<br>and</b> <a href="x">a link</a>.<p>Second&nbsp;one<script>var a = "<p>no</p>";</script></p><ul><li>One<li>Two</ul>
<form><input value=1>Search</form><!-- <p>hidden</p> --><blockquote>1 &lt; 2</blockquote></article>
<section id="comments"><p>Nice!</p></section></main><aside>Side</aside><div class='ad banner'>Buy</div><footer>(c)</footer></body></html>"""


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (PAGE, "The & title\nFirst para with bold and a link.\nSecond one\nOne\nTwo\n1 < 2"),
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<p>a<p>b", "a\nb"),
        ("<div><div>" * 3000 + "deep", "deep"),
        ("<p>unclosed <b>tags <i>here", "unclosed tags here"),
        ("<script>only code", ""),
        ("a < b and c <", "a < b and c <"),
        ("<body><div id=menu><a href=1>x</a></div><div><p>Long enough text of the page.</p><p>More of it.</p></div></body>", "Long enough text of the page.\nMore of it."),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ],
)
def test_main_text(source, text):
    assert html_extract.main_text(source) == text


ARTICLE = "<h1>T</h1>" + "".join(f"<p>{'word ' * 70}{i}.</p>" for i in range(3))


@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
@pytest.mark.parametrize("outer", ['<div class="layout-sidebar-right">', '<div class="page menu-open">', '<div id="app" class="cookie-accepted">', '<section class="topic-social-policy">', '<form id="aspnetForm">', '<div class="sidebar">', '<div class="comments">'])
def test_no_name_around_the_content_loses_it(inner, outer):
    page = "<html><body><nav><a href=x>menu</a></nav>{}<div class='site-footer'>foot</div><form><input>Search</form></body></html>"
    bare = html_extract.main_text(page.format(inner.format(ARTICLE)))
    assert bare.startswith("T\nword word") and bare.endswith("2.") and len(bare) == 1060
    assert html_extract.main_text(page.format(f"{outer}{inner.format(ARTICLE)}</{outer[1:].split()[0]}>")) == bare


def test_names_within_the_content():
    page = "<body><article><p>Long enough text of it.<p class='share-price'>Price<p id=notice-of-motion>Motion<div class=share-buttons>Share it</div><p class=notice>Cookies</article></body>"
    assert html_extract.main_text(page) == "Long enough text of it.\nPrice\nMotion"
    page = "<body><div class=comments><article class=comment><p>{}</p></article></div><article>{}</article></body>"
    assert html_extract.main_text(page.format("c " * 2000, ARTICLE)).startswith("T\nword")


@pytest.mark.parametrize("bad", ["a<b ", '<b ">" ', "<div>", "<!-- ", "</title ", "<script ", "<b '", '<a x=">'])
def test_time_follows_the_page(bad):
    import time

    start = time.process_time()
    html_extract.main_text("<title>" + bad * (200_000 // len(bad)))
    html_extract.main_text("<p>" + bad * (200_000 // len(bad)) + ">")
    assert time.process_time() - start < 15


def test_real_pages(spark, small):
    import html

    rows = {r.page_id: r for r in html_extract.extract(spark.read.parquet(f"{small}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert rows[r.page_id].text == "\n".join(x for x in blocks if x) and rows[r.page_id].n_chars == len(rows[r.page_id].text)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (2, "u", "<p>x", 3), (2, "u", "<p>x", 3)], "page_id long, url string, html string, text int")
    got = html_extract.extract(pages)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, None, "", 0), (None, "u", "", 0), (2, "u", "x", 1), (2, "u", "x", 1)]))
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_token_counts(spark, real):
    ranks = token_counts.load_ranks(spark, queries.VOCABULARY)
    own = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks.value, special_tokens={})
    docs = real.select("text").unionByName(spark.createDataFrame([(None,), ("",), ("don't  <|endoftext|>",)], "text string"))
    lengths = sorted(len(own.encode_ordinary(r.text or "")) for r in docs.collect())
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs, ranks))
    answers = token_counts.context_answers(sums)
    for r in answers.collect():
        longer = [x for x in lengths if x >= r.n_tokens]
        assert (r.docs_from, r.tokens_from) == (len(longer), sum(longer))
        assert r.tokens_truncated == sum(min(x, r.n_tokens) for x in lengths)
        assert (r.docs_within, r.tokens_within) == (len([x for x in lengths if x <= r.n_tokens]), sum(x for x in lengths if x <= r.n_tokens))
    for q in (0.1, 0.5, 0.99, 1.0):
        assert token_counts.quantile(answers, q).first()[0] == next(x for i, x in enumerate(lengths) if (i + 1) / len(lengths) >= q - 1e-12)
    assert token_counts.truncated_total(sums, 333).first()[0] == sum(min(x, 333) for x in lengths)
    clashing = docs.select("text", *(F.lit(1).alias(c) for c in ("n_tokens", "n_docs", "tokens", "bucket")))
    assert sorted(map(tuple, token_counts.length_histogram(clashing, ranks).collect())) == sorted(map(tuple, token_counts.length_histogram(docs, ranks).collect()))
    twice = {r.n_tokens: r.n_docs for r in token_counts.length_histogram(docs.unionByName(docs), ranks).collect()}
    assert sum(twice.values()) == 2 * len(lengths) and all(twice[x] == 2 * lengths.count(x) for x in twice)
    none = token_counts.length_histogram(docs.limit(0), ranks)
    assert none.count() == 0 and token_counts.truncated_total(token_counts.suffix_sums(none), 5).first()[0] == 0


def expected_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if most * sizes[s] < level * weight[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def check_mix(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    sizes = {s: sum(r.size for r in own) for s, own in by.items()}
    want = expected_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    for s, own in by.items():
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(want[s])
        # dependent rounding keeps the words within about one document of the target
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
        for r in own:
            if r.size:
                assert r.copies in (int(want[s] / sizes[s] + 1e-9), int(want[s] / sizes[s] + 1e-9) + 1)


def test_mixing(spark, real, documents):
    rows = mixing.mix(real).collect()
    check_mix(rows)
    again = mixing.mix(real.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    # one source holds most, some are tiny, empty or null
    skewed = real.withColumn("source", F.when(F.col("doc_id") < 3, "tiny").when(F.col("doc_id") == 5, F.lit(None)).otherwise("big"))
    check_mix(mixing.mix(skewed).collect())
    odd = documents((1, "a b", "en", "z"), (1, "a b", "en", "z"), (2, None, "en", "y"), (None, "a " * 50, "en", None), (3, "", "en", None), (4, "x " * 3000, "en", "z"))
    check_mix(mixing.mix(odd).collect())
    assert mixing.mix(odd.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(documents((1, "", "en", "a"))).collect()} == {0}


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"s{k:04d}" if k else None: rng.choice([0, 1, 5, 40, 1000, 30_000]) for k in range(700)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = expected_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_rounding_keeps_probabilities(spark):
    """Over many sources each unit goes up about as often as its fraction says, and every source's words meet their sum."""
    units = spark.range(8000).selectExpr("cast(id div 40 as string) as source", "1 + id % 40 as size", "struct(id as doc_id) as key", "cast(0.3 as double) as p")
    ups = [r.key.doc_id for r in mixing.round_dependently(units, 7).collect()]
    words, rate = defaultdict(int), defaultdict(int)
    for k in ups:
        words[k // 40] += 1 + k % 40
        rate[k % 40] += 1
    assert len(ups) == len(set(ups)) and len(words) == 200
    assert sum(abs(w - 246) for w in words.values()) / 200 <= 2 and max(abs(w - 246) for w in words.values()) <= 40
    assert all(0.18 <= n / 200 <= 0.42 for n in rate.values()) and 0.28 <= len(ups) / 8000 <= 0.32


def test_rounding_through_a_tree(spark):
    """A source of many more units than the root takes, one of them huge, and small sources beside it."""
    units = spark.range(5000).selectExpr("if(id < 4900, 'big', cast(id % 3 as string)) as source", "if(id = 7, 40000, 1 + (id * id) % 977) as size", "struct(id as doc_id) as key", "0.1 + 0.8 * (id % 7) / 7.0 as p").withColumn("p", F.col("p").cast("double"))
    size, want = {}, defaultdict(float)
    for r in units.collect():
        size[r.key.doc_id] = (r.source, r.size)
        want[r.source] += r.size * r.p
    ups = [r.key.doc_id for r in mixing.round_dependently(units, 3).collect()]
    got = defaultdict(int)
    for k in ups:
        got[size[k][0]] += size[k][1]
    assert len(ups) == len(set(ups)) and abs(got["big"] - want["big"]) <= 0.001 * want["big"]
    assert all(abs(got[s] - want[s]) <= 977 / 2 for s in "012")  # 33 units each: half the largest one


def shingles(text, n=5):
    w = MARKS.findall("".join(c.lower()[0] for c in text or ""))  # letter by letter
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 1])
def test_contained_items(spark, small, documents, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()] + [(900, None), (901, ""), (902, "too few words"), (None, "five words of an item"), (903, "seven words make an item of three shingles"), (904, "Η ΟΔΟΣ ΤΩΝ ΘΕΩΝ ΕΙΝΑΙ ΜΑΚΡΟΣ ΚΑΙ ΚΑΛΟΣ"), (905, "İKİ ÜÇ DÖRT BEŞ ALTI YEDİ")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    words = items[0][1].split()
    for k in range(0, len(words), 3):  # edits of all degrees
        docs.append((5000 + k, "before " * 200 + " ".join([*words[:k], "changed", *words[k + 1 :]]).upper() + "! after"))
        docs.append((6000 + k, " ".join(words[k:])))
    docs += [(None, "x five, words of an item y"), (7000, None), (7001, ""), (7002, "too few words"), (7001, "five words of an item"), (7003, "Η ΟΔΟΣ ΤΩΝ ΘΕΩΝ ΕΙΝΑΙ ΜΑΚΡΟΣ ΚΑΙ ΚΑΛΟΣ"), (7004, "x İKİ ÜÇ DÖRT BEŞ ALTI YEDİ y"), (7005, "filler words " * 30_000 + items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontaminate.contained_items(documents(*docs), bench).collect()), key=str)
    sets = [(i, shingles(t)) for i, t in items]
    want = sorted(((k, i, len(s & x), len(x)) for k, t in docs for s in [shingles(t)] for i, x in sets if x and len(s & x) >= 0.8 * len(x) - 1e-9), key=str)
    assert got == want and len(want) > 5
    clean = decontaminate.without_leaks(documents(*docs), bench)
    hit = {(k, t) for k, t in docs for s in [shingles(t)] for _, x in sets if x and len(s & x) >= 0.8 * len(x) - 1e-9}
    assert sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == sorted((str(k), str(t)) for k, t in docs if (k, t) not in hit)
    assert decontaminate.contained_items(documents(*docs).limit(0), bench).count() == decontaminate.contained_items(documents(*docs), bench.limit(0)).count() == 0


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], small).persist())
    named, single, cut, clean, mixed = tables[1:]
    assert all(sorted(t.columns) == sorted(docs.columns) for t in tables[:-1])
    assert named.count() == docs.filter("text rlike '\\\\p{L}'").count()
    from test_dedup import similar_classes

    rows = named.select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[k].doc_id for k in similar_classes([r.text for r in rows]).values()})
    assert cut.count() == single.count() and cut.filter("n_chars <> length(text)").count() == 0
    bench = [shingles(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in cut.collect() for s in [shingles(r.text)] if any(x and len(s & x) >= 0.8 * len(x) - 1e-9 for x in bench)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - bad
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, mixed.collect()))


def test_pipeline_cuts_passages_of_fifty_words(spark, small):
    """Passages of 51 words that several documents share go, the rest of the texts and clean documents stay."""
    rng = random.Random(6)
    words = [x for r in spark.read.parquet(f"{small}/documents.parquet").filter("lang = 'en'").collect() for x in r.text.split() if x.isalpha()]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(51) for _ in range(8)]
    rows = [(k, f"{prose(80)} {passages[k % 8] if k < 40 else prose(51)} {prose(80)}", "en", "s", 1) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_strings(spark, docs, small).collect()}
    assert all(passages[k % 8] not in got[k] and got[k].split()[:79] == rows[k][1].split()[:79] for k in range(40))
    assert all(got[k] == rows[k][1] for k in range(40, 80))


def test_stages_leave_clashing_columns_alone(spark, small):
    odd = ["_id", "_h", "row", "spans", "id", "none", "h", "t", "_letters", "letters", "own", "_row", "hash", "c0"]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    more = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(odd)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, small)
        assert out.columns == more.columns and all(r[c] == i for r in out.collect() for i, c in enumerate(odd))
    assert corpus_pipeline.mix_sources(spark, more, small).count() == 60


def test_pipeline_takes_odd_tables(spark, documents, small):
    docs = documents((None, None), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "die katze und der hund", "de", None)).select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, small).persist()
        assert table.count() <= 6


def test_registration():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline", n)]
    assert len(names) == 14 and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    result = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(result.fetchall(), key=repr)
