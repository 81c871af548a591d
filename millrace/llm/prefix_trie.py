"""The prefix trie of conversations, with totals of every subtree.

Turns are numbered by ranges; a turn's element is a pair of 64-bit hashes of its depth, role and text, and a prefix is the exclusive or
of its elements, so that prefixes of a conversation of any length are made in stretches that are joined by their totals. Equal prefixes
are one node, named by its smallest member and its depth; parent edges come from the prefix without its last turn.

Totals of subtrees come from a centroid decomposition of the parent-edge forest. A node weighs its members, so that the weight of any
subtree is known from the aggregation that makes the nodes: the turns that its members still have. In a component the nodes of over half
its weight are a chain from the top down, and the last of them is the centroid. What hangs below it falls apart into components, whose
totals together are added along the chain from the centroid to the top; the rest stays a component without it. Weights halve each time,
however deep or wide the trie is. Components of more than `limit` are split by joins, smaller ones in tasks, many to a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import numbered, saved

#: Turns of a conversation whose prefixes are made in one group.
STRETCH = 4096
#: Weight of a component that is solved within a task.
LIMIT = 20_000
#: Ids that are joined to one string before a node's digest is made.
CHUNK = 4096


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, v, n_bytes): turns in order, whole conversations one after the other; v is a digest of role and text.

    Null turns come first; rows of one turn stand by role and by the digest of role and text; null roles and texts are empty; rows
    without a conv_id belong to no conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("v"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = numbered(saved(turns), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("v"), F.col("row"))
    return placed.select("conv_id", "rank", "v", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of all rebuilt conversations, turnless ones included, and their turns (conv_id, depth from 1, v, n_bytes, length).

    Conversation c begins with the first h turns of conversation c - c % 5 and goes on with its own after its first h."""
    convs = turns.groupBy("conv_id").agg(F.min("rank").alias("start"), F.count("*").alias("n"))
    convs = saved(convs.select("*", (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base")))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shared = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = saved(convs.join(sizes, "base", "left").withColumn("shared", shared).withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    placed = turns.join(convs, "conv_id").withColumn("place", F.col("rank") - F.col("start"))
    own = placed.filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("shared") + 1).alias("depth"), "v", "n_bytes", "length")
    heads = placed.filter("place < 8").select(F.col("conv_id").alias("base"), "place", "v", "n_bytes")  # h is 8 at most
    heads = heads.join(convs.select("base", "conv_id", "shared", "length"), "base").filter("place < shared")
    both = own.unionByName(heads.select("conv_id", (F.col("place") + 1).alias("depth"), "v", "n_bytes", "length"))
    return convs.select("conv_id", "length"), saved(both)


def prefixes(turns: DataFrame) -> DataFrame:
    """turns with (a, b), the hash of the prefix that ends there, and (pa, pb), that of the prefix before; written once."""
    element = lambda seed: F.xxhash64(F.lit(seed), "depth", "v")
    cut = turns.select("conv_id", "depth", "n_bytes", "length", F.floor((F.col("depth") - 1) / STRETCH).alias("stretch"), element(1).alias("ea"), element(2).alias("eb"))
    so_far = W.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    own = cut.select("*", F.bit_xor("ea").over(so_far).alias("xa"), F.bit_xor("eb").over(so_far).alias("xb"))
    before = W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    whole = cut.filter(F.col("length") > STRETCH).groupBy("conv_id", "stretch").agg(F.bit_xor("ea").alias("ta"), F.bit_xor("eb").alias("tb"))
    carried = whole.select("conv_id", "stretch", F.bit_xor("ta").over(before).alias("ca"), F.bit_xor("tb").over(before).alias("cb"))
    both = own.join(carried, ["conv_id", "stretch"], "left")
    a, b = F.col("xa").bitwiseXOR(F.coalesce("ca", F.lit(0))), F.col("xb").bitwiseXOR(F.coalesce("cb", F.lit(0)))
    return saved(both.select("conv_id", "depth", "n_bytes", "length", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("ea")).alias("pa"), b.bitwiseXOR(F.col("eb")).alias("pb")))


def nodes(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """A row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_bytes, weight, a, b); written once."""
    left = F.col("length") - F.col("depth") + 1
    found = steps.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.sum(left).alias("weight"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("n_bytes"), "weight", F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    found = saved(found.unionByName(root))
    kids = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    both = found.join(parents, ["depth", "pa", "pb"], "left").join(kids, ["depth", "a", "b"], "left")
    return saved(both.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_bytes", "weight", "a", "b"))


def _decomposed(rows: dict, own: list[list[int]]) -> list[list[int]]:
    """Totals of each node's subtree: rows of whole components, each with the place of its parent among them (-1: none) and its weight."""
    parent, weight = rows["up"], rows["weight"]
    below: list[list[int]] = [[] for _ in parent]
    for i, p in enumerate(parent):
        if p >= 0:
            below[p].append(i)
    gone = [False] * len(parent)
    totals = [[0] * len(own) for _ in parent]
    tops = [i for i, p in enumerate(parent) if p < 0]
    while tops:
        top = tops.pop()
        whole, chain, x = weight[top], [top], top
        while (x := next((u for u in below[x] if not gone[u] and 2 * weight[u] > whole), -1)) >= 0:
            chain.append(x)
        x = chain[-1]
        inside, k = [x], 0
        while k < len(inside):
            inside += [u for u in below[inside[k]] if not gone[u]]
            k += 1
        for j, values in enumerate(own):
            total = sum(values[i] for i in inside)
            for i in chain:
                totals[i][j] += total
        gone[x] = True
        for i in chain[:-1]:
            weight[i] -= weight[x]
        tops += [u for u in below[x] if not gone[u]]
        if len(chain) > 1:
            tops.append(top)
    return totals


def _solve(columns: list[str]):
    def run(table: pa.Table) -> pa.Table:
        c, d, pc, weight, at = (table.column(n).to_pylist() for n in ("c", "d", "pc", "weight", "top"))
        spot = {key: i for i, key in enumerate(zip(c, d, strict=True))}
        up = [-1 if (t["c"], t["d"]) == key else spot[p, key[1] - 1] for key, p, t in zip(spot, pc, at, strict=True)]
        totals = _decomposed({"up": up, "weight": weight}, [table.column(n).to_pylist() for n in columns])
        arrays = {"c": table.column("c"), "d": table.column("d")}
        for j, n in enumerate(columns):
            arrays[n] = pa.array([s + t[j] for s, t in zip(table.column(f"{n}_sum").to_pylist(), totals, strict=True)], pa.int64())
        return pa.table(arrays)

    return run


def subtree_totals(tree: DataFrame, steps: DataFrame, columns: list[str], limit: int = LIMIT) -> DataFrame:
    """(c, d) and the totals of `columns` over each node's subtree, itself included.

    tree: (c, d, pc, weight, *columns), a node (c, d) below (pc, d - 1), with the weight of its subtree, more than that of any child.
    steps: (m, d, c, pc), the node and its parent of member m at depth d; every node is a step of its own c."""
    sums = [f"{n}_sum" for n in columns]
    root = tree.filter("d = 0").select("c").first()  # one row, or none of an empty tree
    # no node is before the root; as a column of rows, not a constant, it is a key of joins
    top = F.struct(F.least("c", F.lit(root and root[0]).cast("long")).alias("c"), F.least("d", F.lit(0).cast("long")).alias("d")).alias("top")
    state = tree.select("c", "d", "pc", "weight", *columns, *(F.lit(0).cast("long").alias(s) for s in sums), top)
    small, done = [], []
    while True:
        large = saved(state.groupBy("top").agg(F.max("weight").alias("whole")).filter(F.col("whole") > limit))
        if large.isEmpty():
            small.append(state)
            break
        small.append(state.join(large, "top", "left_anti"))
        state = state.join(large, "top")
        heavy = 2 * F.col("weight") > F.col("whole")
        centroid = saved(state.filter(heavy).groupBy("top").agg(F.min_by(F.struct("c", "d"), "weight").alias("x"), F.min("weight").alias("x_weight")))
        steps_at = steps.select(F.col("m"), F.col("d").alias("step"), F.struct(F.col("c"), F.col("d")).alias("child"), F.col("pc").alias("over"))
        asked = state.join(centroid, "top").withColumn("step", F.when(F.col("d") > F.col("x.d"), F.col("x.d") + 1))
        found = asked.join(steps_at, (asked.c == steps_at.m) & (asked.step == steps_at.step), "left").drop(steps_at.step)
        below = F.coalesce(F.col("over") == F.col("x.c"), F.lit(False))
        is_x = (F.col("c") == F.col("x.c")) & (F.col("d") == F.col("x.d"))
        marked = saved(found.select(*state.columns, "x_weight", "child", below.alias("below"), is_x.alias("is_x")))
        total = marked.filter("below or is_x").groupBy("top").agg(*(F.sum(n).alias(f"{n}_total") for n in columns))
        on_path = ~F.col("below") & heavy
        joined = marked.join(total, "top")
        added = [F.when(on_path, F.col(s) + F.col(f"{n}_total")).otherwise(F.col(s)).alias(s) for n, s in zip(columns, sums, strict=True)]
        after = F.when(on_path & ~F.col("is_x"), F.col("weight") - F.col("x_weight")).otherwise(F.col("weight")).alias("weight")
        split = saved(joined.select("c", "d", "pc", after, *columns, *added, F.when(F.col("below"), F.col("child")).otherwise(F.col("top")).alias("top"), "is_x"))
        done.append(split.filter("is_x").select("c", "d", *(F.col(s).alias(n) for n, s in zip(columns, sums, strict=True))))
        state = split.filter("not is_x").drop("is_x")
    rest = small[0]
    for df in small[1:]:
        rest = rest.unionByName(df)
    bins = max(1, -(-tree.count() // limit))
    rest = rest.withColumn("bin", F.pmod(F.xxhash64("top.c", "top.d"), F.lit(bins)))
    out = rest.groupBy("bin").applyInArrow(_solve(columns), "c long, d long, " + ", ".join(f"{n} long" for n in columns))
    for df in done:
        out = out.unionByName(df)
    return out


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to a digest a node; a node's pieces follow each other, over batches too."""
    key, state, out = None, None, []
    for batch in batches:
        for c, d, ids in zip(*(batch.column(n).to_pylist() for n in ("c", "d", "ids")), strict=True):
            if (c, d) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (c, d), hashlib.sha256(ids.encode())
        if len(out) >= 10_000:
            yield _digests(out)
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    yield _digests(out)


def _digests(rows: list) -> pa.RecordBatch:
    c, d, h = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.string())], ["c", "d", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(c, d, ends_sha256) of ends (c, d, m): the digest of a node's m, ascending, joined by commas.

    Ids are joined in pieces of CHUNK at most, side by side; only the digest itself goes over a node's pieces one after the other."""
    placed = numbered(saved(ends), F.col("c"), F.col("d"), F.col("m"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda x: x.cast("string")), ",")
    pieces = placed.groupBy("c", "d", F.floor(F.col("rank") / CHUNK).alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition("c", "d").sortWithinPartitions("c", "d", "piece").mapInArrow(_streamed, "c long, d long, ends_sha256 string")


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row a node of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256).

    Null turns stand first, null roles and texts are empty, repeated rows are turns like any others, and rows of one turn stand by role
    and digest. Rows without a conv_id are of no conversation. Empty and very long texts only differ in their bytes. Other columns are
    ignored. An empty table gives an empty result, without a root."""
    convs, turns = rebuilt(numbered_turns(conversations))
    paths = prefixes(turns)
    found = nodes(convs, paths)
    named = paths.select(F.col("conv_id").alias("m"), "depth", "a", "b", "length").join(found.select("depth", "a", "b", F.col("conv_id").alias("c"), F.col("parent_conv_id").alias("pc")), ["depth", "a", "b"])
    steps = saved(named.select("m", F.col("depth").alias("d"), "c", "pc", "length"))
    leaf = (F.col("n_children") == 0).cast("long")
    tree = found.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("pc"), "weight", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    totals = subtree_totals(tree, steps, ["n_leaves", "saved_tokens"], limit)
    root = found.filter("depth = 0").select("conv_id").first()
    zero = F.lit(0).cast("long").alias("d")
    turnless = convs.filter("length = 0").select(F.lit(root and root[0]).cast("long").alias("c"), zero, F.col("conv_id").alias("m"))
    ends = steps.filter("d = length").select("c", "d", "m").unionByName(turnless)
    digests = end_digests(ends).withColumnsRenamed({"c": "conv_id", "d": "depth"})
    out = found.join(totals.withColumnsRenamed({"c": "conv_id", "d": "depth"}), ["conv_id", "depth"]).join(digests, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
