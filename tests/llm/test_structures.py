"""Operators 11 to 13 against brute force, an exact round trip, and their SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import merkle, packing, prefix_trie, queries
from millrace.llm._tables import numbered


def same(got, expected):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, expected)))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_numbered(spark):
    df = spark.createDataFrame([(k % 7, None if k % 5 else k) for k in range(200)], "a long, b long").withColumn("row", F.monotonically_increasing_id())
    order = F.col("a"), F.col("b").asc_nulls_first(), F.col("row")
    rows = sorted(numbered(df, *order).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(200))
    assert [(r.a, r.b is not None, r.b or 0) for r in rows] == sorted((r.a, r.b is not None, r.b or 0) for r in rows)
    assert numbered(df.limit(0), *order).count() == 0


# packing


@pytest.fixture(scope="module")
def ranks(spark):
    return packing.load_vocabulary(spark, queries.PACKED)


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.PACKED)
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def checked(pieces, docs, length):
    """Every id of docs (id, ids) in one piece, windows without gaps; gives the lengths of sequences."""
    ids, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids[p.doc_id, p.doc_tokens].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        windows[p.sequence_id].append((p.offset, len(p.ids) // 4))
    assert sorted(k[0] for k in ids) == sorted(k for k, _ in docs)
    for k, x in docs:
        own = sorted(ids[k, len(x)])
        assert [s for s, _ in own] == [sum(len(y) for _, y in own[:i]) for i in range(len(own))]
        assert [t for _, y in own for t in y] == x
    for own in windows.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
    sizes = [sum(n for _, n in own) for own in windows.values()]
    assert max(sizes, default=0) <= length
    return sizes


@pytest.mark.parametrize(("length", "windows", "partitions"), [(2048, 64, 1), (64, 4, 7), (16, 2, 40), (8, 1, 3)])
def test_packing_round_trip(spark, documents, ranks, length, windows, partitions):
    rnd = random.Random(length)
    words = ["a", "the", "naïve", "été", "汉字", "don't", "<|endoftext|>", "  ", "\n\n", "🙂", "12345", "x" * 300]
    texts = ["", None, *(" ".join(rnd.choices(words, k=rnd.choice((1, 2, 5, 9, 400)))) for _ in range(90)), "long " * 5000]
    docs = documents(*enumerate(texts)).repartition(partitions)
    got = packing.pack(docs, ranks, length=length, windows=windows).collect()
    sizes = checked(got, list(enumerate(encoded(texts))), length)
    assert all(n & (n - 1) == 0 for n in sizes)  # nothing to pad
    assert sum(n < length for n in sizes) <= length.bit_length()


def test_packing_odd_rows(spark, documents, ranks):
    docs = documents((None, "one"), (None, "two three"), (4, "same"), (4, "same"), (-1, None))
    got = packing.pack(docs, ranks).collect()
    assert sum(len(p.ids) // 4 for p in got) == sum(map(len, encoded(["one", "two three", "same", "same", None])))
    assert {p.doc_id for p in got} == {None, -1, 4}
    assert sorted((p.doc_id is not None, p.doc_id or 0) for p in got if p.start == 0) == [(False, 0), (False, 0), (True, -1), (True, 4), (True, 4)]
    assert packing.pack(docs.limit(0), ranks).count() == 0


def test_packing_keeps_documents_whole_where_they_fit(spark, ranks):
    out = []
    w = packing.Windows(10, 2, out.append)
    for k, n in enumerate((6, 7, 4, 3, 8, 9)):
        w.put(k, np.arange(n, dtype=np.uint32), 0, n)
    # 4 fits 6 best, 3 fits 7 best; of 8 and 9 the fullest window takes what it holds
    assert [[(p[0], len(p[2])) for p in x] for x in out] == [[(0, 6), (2, 4)], [(1, 7), (3, 3)]]
    w.put(6, np.arange(5, dtype=np.uint32), 0, 5)
    assert [(p[0], len(p[2])) for p in out[-1]] == [(5, 9), (6, 1)]


# trie


def brute_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append(((t is not None, t or 0), r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    own = {c: [(a[1], a[3]) for a in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        leaves = saved = 0
        todo = [p]
        while todo:
            q = todo.pop()
            leaves += not kids[q]
            saved += (len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0)
            todo += kids[q]
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved, H(ends)))
    return out


@pytest.mark.parametrize(("limit", "stretch", "chunk"), [(20_000, 4096, 4096), (12, 5, 3)])
def test_trie(spark, monkeypatch, limit, stretch, chunk):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rnd = random.Random(1)
    rows = []
    for c in range(40):
        for t in range(60 if c == 7 else rnd.choice((0, 1, 2, 3, 5, 9, 12))):
            rows.append((c if rnd.random() > 0.02 else None, rnd.choice((t, t, t, None)), rnd.choice(("u", "a", None)), rnd.choice(("x", "yy", "é", "", None, "z" * 5000))))
    rows += [(c, t, "u", "same" if t < 3 or c % 3 else str(c)) for c in range(40, 90) for t in range(4)]
    rows += [(100 + k, t, "u", str(t)) for k in range(3) for t in range(50)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("weight", F.lit(1))
    same(prefix_trie.trie(df, limit).collect(), brute_trie(rows))


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(df).count() == 0
    df = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(df).count() == 0


def test_decomposition_of_paths_and_stars():
    rnd = random.Random(3)
    for shape in ("path", "star", "random"):
        up = [-1, *({"path": i - 1, "star": 0, "random": rnd.randrange(i)}[shape] for i in range(1, 400))]
        own = [rnd.randrange(9) for _ in up]
        total, weight = list(own), [1] * len(up)
        for i in range(len(up) - 1, 0, -1):
            total[up[i]] += total[i]
            weight[up[i]] += weight[i]
        assert [t[0] for t in prefix_trie._decomposed({"up": up, "weight": weight}, [own])] == total


# manifest


def brute_manifest(rows, fanout):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: H(*map(enc, (r.doc_id, r.source, r.lang, n, r.text)))

    def tree(nodes):
        paths, spot = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(spot):
                first = k - k % fanout
                paths[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + fanout])))
                spot[i] = k // fanout
            nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        return nodes[0], paths

    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = {lang: sorted(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars)), r) for r in rows if r.lang == lang) for lang in langs}
    trees = {lang: tree([k[2] for k, _ in v]) for lang, v in by.items()}
    root, tops = tree([trees[lang][0] for lang in langs])
    for lang, above in zip(langs, tops, strict=True):
        for (key, r), path in zip(by[lang], trees[lang][1], strict=True):
            forged = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            folded = leaf(r, r.n_chars + 1) if forged else key[2]
            for left, right in path + above:
                folded = H(left, folded, right)
            yield r.doc_id, key[2], trees[lang][0], root, H(*(a + b for a, b in path + above)), folded, folded == root


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 4), (3, 10), (5, 1)])
def test_manifest(spark, fanout, block):
    rnd = random.Random(fanout)
    langs = ["de"] * 40 + ["", "é", "zz", None, "en", "~"]
    rows = [(k, rnd.choice(("text", "", None, "ü\n" * 3000)), rnd.choice(langs), rnd.choice(("s", None)), rnd.choice((3, None, 2**63 - 1))) for k in range(150)]
    rows += [(None, "x", "de", None, 1), (None, "y", "de", None, 1), (-5, None, None, None, None), *rows[:9]]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("text", "lang", "source")), T.StructField("n_chars", T.LongType())])
    df = spark.createDataFrame(rows, schema).withColumn("tree", F.lit("x")).withColumn("node", F.lit(0)).repartition(5)
    got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, fanout=fanout, block=block)
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = got.select(*columns).collect()
    same(got, brute_manifest(df.collect(), fanout))
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_manifest_of_one_and_none(spark, documents):
    one = merkle.manifest(documents((1, "x"))).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == H() and one.verified
    assert merkle.manifest(documents((1, "x")).limit(0)).count() == 0
