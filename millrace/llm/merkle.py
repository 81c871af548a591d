"""A Merkle manifest of a dataset: a tree of digests for each partition value, a tree of their roots, and every row's proof.

A tree's leaves are cut into aligned blocks of BLOCK, a power of the fanout. Each block hashes its own subtree; then blocks exchange
roots as in a butterfly: in round r the blocks that agree in all digits (base fanout) but the r-th swap what they hold, and each hashes
the common ancestor by itself. After as many rounds as the tree has levels above its blocks, every block knows all siblings above it,
and the root, so that no pass goes back down. Where a tree is ragged, any block of a neighbouring group answers for it; askers are
dealt evenly over its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import numbered, saved

FANOUT = 2
#: Leaves of a block; with a fanout f the largest power of f up to this.
BLOCK = 1024
UPS = "array<struct<left:string,right:string>>"
PROVED = "doc_id long, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The nodes of each level from the leaves up: `height` levels above them, or until one is left."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        out.append([_digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def encoded(c: Column) -> Column:
    """A value as it goes into a leaf: `-` if null, else its UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """nodes (tree, node, nodes, digest): node of 0 to nodes - 1, the lowest exchanged level of each tree; to the same with `root` for
    digest and `ups`: for each level the siblings' digests on the left and on the right, joined.

    A round is two joins by (tree, node), on one row a node; trees that have reached their root rest. A lone node of a run is hashed
    by itself."""
    state = saved(nodes.withColumn("ups", F.array().cast(UPS)))
    most = state.agg(F.max("nodes")).first()[0] or 0
    step = 1
    while step < most:
        active = F.col("nodes") > step
        own = F.floor(F.col("node") / step)
        asks = state.filter(active).select("tree", "node", "nodes", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("k"))
        sibling = F.floor(own / fanout) * fanout + F.col("k")
        asks = asks.withColumn("sibling", sibling).filter((F.col("sibling") != own) & (F.col("sibling") * step < F.col("nodes")))
        size = F.least(F.lit(step), F.col("nodes") - F.col("sibling") * step)
        asks = asks.select("tree", "node", "k", (F.col("sibling") * step + (F.col("node") % step) % size).alias("asked"))
        held = state.select(F.col("tree").alias("t"), F.col("node").alias("asked"), "digest")
        got = asks.join(held, (asks.tree == held.t) & (asks.asked == held.asked)).groupBy("tree", "node").agg(F.sort_array(F.collect_list(F.struct("k", "digest"))).alias("got"))
        at = own % fanout
        side = lambda test: F.array_join(F.transform(F.filter("got", test), lambda x: x["digest"]), "")
        level = F.struct(F.coalesce(side(lambda x: x["k"] < at), F.lit("")).alias("left"), F.coalesce(side(lambda x: x["k"] > at), F.lit("")).alias("right"))
        both = state.join(got, ["tree", "node"], "left").withColumn("level", level)
        parent = F.sha2(F.concat("level.left", "digest", "level.right"), 256)
        state = saved(both.select("tree", "node", "nodes", F.when(active, parent).otherwise(F.col("digest")).alias("digest"), F.when(active, F.concat("ups", F.array("level"))).otherwise(F.col("ups")).alias("ups")))
        step *= fanout
    return state.withColumnRenamed("digest", "root")


def _block_root(fanout: int, height: int):
    """A block's own root: all levels of a block where its tree has more of them, else up to a single node."""

    @F.pandas_udf("string")
    def root(leaves, alone):
        return leaves.combine(alone, lambda x, one: _levels(list(x), fanout, None if one else height)[-1][0])

    return root


def _prove(fanout: int, height: int):
    """Blocks with what stands above them to one row a leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
        for batch in batches:
            for b in range(batch.num_rows):
                block = batch.slice(b, 1).to_pylist()[0]
                leaves = [x["leaf"] for x in block["rows"]]
                levels = _levels(leaves, fanout, None if block["alone"] else height)
                above = [(x["left"], x["right"]) for x in (*block["ups"], *block["tops"])]
                rows = []
                for i, x in enumerate(block["rows"]):
                    path = []
                    for nodes in levels[:-1]:
                        first = i - i % fanout
                        path.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
                        i //= fanout
                    path += above
                    folded = x["forged"] or x["leaf"]
                    for left, right in path:
                        folded = _digest(left + folded + right)
                    proof = _digest("".join(left + right for left, right in path))
                    rows.append((x["doc_id"], x["place"], x["leaf"], block["subroot"], block["root"], proof, folded, folded == block["root"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def manifest(docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), count_col: str = "n_chars", fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: (doc_id, place, leaf, subroot, root, proof_sha256, folded_root, verified).

    Leaves are digests of `fields`; those of one group ascend by id, and every `fanout` consecutive nodes become one until one is left,
    the subroot; subroots in the order of their groups (null first, then by bytes) become the root likewise. `proof_sha256` is the
    digest of all siblings from the leaf up. Rows where `tampered` holds are folded from a leaf whose count is one higher.

    Null ids and null groups come first and are never tampered with by a null test; rows of one id stand by their leaves' digests, equal rows by
    chance, which changes no digest; a count of 2^63-1 goes on to 2^63; an empty table gives an empty result; other columns are
    ignored. Texts are read once; only digests are shuffled. No group is gathered: blocks hold `block` rows at most."""
    height = 0
    while fanout ** (height + 1) <= block:
        height += 1
    block = fanout**height
    value = {c: F.col(c) for c in fields}
    forged = value | {count_col: F.col(count_col).cast("decimal(20,0)") + 1}
    tampered = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    rows = docs.select(
        F.col(group_col).cast("string").alias("grp"),
        F.col(id_col).cast("long").alias("doc_id"),
        leaf_digest(*value.values()).alias("leaf"),
        F.when(tampered, leaf_digest(*forged.values())).alias("forged"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = numbered(saved(rows), F.col("grp").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")).drop("row")
    groups = saved(placed.groupBy("grp").agg(F.min("rank").alias("start"), F.count("*").alias("n")))
    groups = saved(numbered(groups, F.col("grp").asc_nulls_first()).select(F.col("grp").alias("of"), "start", "n", F.col("rank").alias("tree")))
    spots = placed.join(groups, F.col("grp").eqNullSafe(F.col("of"))).withColumn("place", F.col("rank") - F.col("start"))
    spots = spots.withColumn("node", F.floor(F.col("place") / block))
    blocks = saved(spots.groupBy("tree", "node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "forged"))).alias("rows")))
    alone = F.col("n") <= block
    roots = blocks.select("tree", "node", F.ceil(F.col("n") / block).alias("nodes"), _block_root(fanout, height)(F.col("rows.leaf"), alone).alias("digest"))
    low = butterfly(roots, fanout)
    subroots = low.filter("node = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("node"), F.lit(groups.count()).cast("long").alias("nodes"), F.col("root").alias("digest"))
    top = butterfly(subroots, fanout).select(F.col("node").alias("tree"), F.col("root").alias("all"), F.col("ups").alias("tops"))
    low = low.select("tree", "node", F.col("root").alias("subroot"), "ups").join(top, "tree")
    whole = blocks.join(low, ["tree", "node"]).select("rows", alone.alias("alone"), "ups", "tops", "subroot", F.col("all").alias("root"))
    return whole.mapInArrow(_prove(fanout, height), PROVED)
