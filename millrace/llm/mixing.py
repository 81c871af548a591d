"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

All documents of a source want the same number of copies, target over size. Its whole part is given to each; the fractional
parts are rounded dependently: two units meet and randomly move mass, counted in words, until one is integral, and the other goes on
with what is left. What one loses the other gains, so that a meeting leaves the expected words as they are, and the chances are such
that each unit keeps its probability. Units meet within groups of like size, salted to about GROUP units whatever a source holds; a
group leaves one residual unit, and the residuals of all groups form the next level of a reduction tree, down to ROOT units a source.
At the root a source's units are settled from the largest to the smallest: each gives the words by which its rounding was off to all
smaller ones, in proportion to their size, so that the total misses the target by about the smallest of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import saved

#: Units that meet in one group of a level.
GROUP = 128
#: Units of a source that are settled at the root: more than the bands of sizes up to 2 ** 40.
ROOT = 512
#: Cuts of an octave of sizes; groups hold one band of sizes.
CUTS = 8.0


def targets(by_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size), one row a source, to (source, source_size, target). Sources may be many: they are ranked by ranges.

    Sources by code point, null last, weigh `weights` in turn and share all sizes; no target exceeds `most` times its source's
    size. The level that all are filled up to is found by passes: sources whose limit is below it keep their limit, which raises
    the level for the others."""
    order = F.col("source").asc_nulls_last()
    placed = saved(by_source.repartitionByRange(order).sortWithinPartitions(order).withColumn("spot", F.monotonically_increasing_id()))
    part = F.shiftright("spot", 33)
    before = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("spot").alias("first"))  # a row a partition
    before = before.withColumn("shift", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).select("part", "shift")
    rank = F.col("spot") + F.col("shift")
    ranked = placed.join(F.broadcast(before), part == F.col("part")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    ranked = saved(ranked.select("source", "source_size", "weight", (F.lit(most) * F.col("source_size")).alias("cap")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, limited = 0.0, -1
    while True:
        full = F.col("cap") < level * F.col("weight")
        found = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if found[0] == limited or not found[2]:
            break
        limited, level = found[0], (total - (found[1] or 0)) / found[2]
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _uniform(level: int, seed: int, *keys: Column) -> Column:
    """A number from 0 to 1 that reruns repeat."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *keys), 11)).cast("double") / float(1 << 53)


def _meet(level: int, seed: int):
    def step(acc: Column, x: Column) -> Column:
        a, b = acc["unit"], x
        have_a, have_b = a["p"] * a["size"], b["p"] * b["size"]
        room_a, room_b = a["size"] - have_a, b["size"] - have_b
        to_b, to_a = F.least(have_a, room_b), F.least(have_b, room_a)  # words that may move either way
        u = _uniform(level, seed, a["key"], b["key"])
        gives = u * (to_a + to_b) < to_a  # the less there is to move, the likelier: no unit's chance changes
        new_a = F.when(gives, have_a - to_b).otherwise(have_a + to_a)
        new_b = F.when(gives, have_b + to_b).otherwise(have_b - to_a)
        a_done = F.when(gives, have_a <= room_b).otherwise(room_a <= have_b)
        a_up = ~gives
        b_up = gives
        stays = F.when(a_done, b).otherwise(a)
        left = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(a_done, new_b / b["size"]).otherwise(new_a / a["size"])))
        unit = F.struct(stays["size"].alias("size"), stays["key"].alias("key"), left.alias("p"))
        done = F.when(a_done, a["key"]).otherwise(b["key"])
        up = F.when(a_done, a_up).otherwise(b_up)
        return F.struct(unit.alias("unit"), F.when(up, F.concat(acc["ones"], F.array(done))).otherwise(acc["ones"]).alias("ones"))

    return step


def _none(of: Column) -> Column:
    """An empty array of keys."""
    return F.slice(F.transform(of, lambda x: x["key"]), 1, 0)


def _settle(units: Column, level: int, seed: int) -> Column:
    """The keys rounded up of a source's last units, from the largest on: a unit's own chance, shifted by the words that are owed."""

    def step(acc: Column, x: Column) -> Column:
        # what is owed is spread over this unit and all smaller ones, by size
        rest = acc["rest"]
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["p"] + acc["owed"] / F.greatest(rest, F.lit(1.0))))
        up = _uniform(level, seed, x["key"]) < p
        # the last unit takes whatever brings the words nearer
        up = F.when(rest <= x["size"], acc["owed"] + x["p"] * x["size"] > 0.5 * x["size"]).otherwise(up)
        owed = acc["owed"] + x["p"] * x["size"] - F.when(up, x["size"].cast("double")).otherwise(0.0)
        return F.struct(owed.alias("owed"), (rest - x["size"]).alias("rest"), F.when(up, F.concat(acc["ones"], F.array(x["key"]))).otherwise(acc["ones"]).alias("ones"))

    total = F.aggregate(units, F.lit(0.0), lambda s, x: s + x["size"])
    ordered = F.reverse(F.sort_array(units))
    return F.aggregate(ordered, F.struct(F.lit(0.0).alias("owed"), total.alias("rest"), _none(units).alias("ones")), step)["ones"]


def round_dependently(units: DataFrame, seed: int) -> DataFrame:
    """(source, size, key, p), keys unique and p from 0 to 1 exclusive, to the keys that are rounded up."""
    ups = None
    level = 0
    while True:
        # sources of more units than the root takes go down one level, in groups of a band of sizes
        banded = units.withColumn("band", F.floor(F.log2(F.col("size")) * CUTS))
        counts = banded.groupBy("source", "band").agg(F.count("*").alias("n"))
        counts = counts.withColumn("all", F.sum("n").over(W.partitionBy("source"))).filter(F.col("all") > ROOT)
        counts = saved(counts.select(F.col("source").alias("s"), F.col("band").alias("b"), F.ceil(F.col("n") / GROUP).alias("salts")))
        if counts.isEmpty():
            break
        same = F.col("source").eqNullSafe(F.col("s"))
        few = units.join(counts.select("s").distinct(), same, "left_anti")
        salted = banded.join(counts, same & (F.col("band") == F.col("b"))).withColumn("salt", F.pmod(F.xxhash64(F.lit(level), "key"), F.col("salts")))
        groups = salted.groupBy("source", "band", "salt").agg(F.sort_array(F.collect_list(F.struct("size", "key", "p"))).alias("us"))
        first = F.struct(F.element_at("us", 1).alias("unit"), _none(F.col("us")).alias("ones"))
        met = groups.select("source", F.aggregate(F.slice("us", F.lit(2), F.size("us")), first, _meet(level, seed)).alias("r"))
        met = saved(met.select("source", "r.unit", "r.ones"))
        settled = met.select(F.explode("ones").alias("key"))
        units = saved(met.select("source", "unit.size", "unit.key", "unit.p").unionByName(few))
        ups = settled if ups is None else ups.unionByName(settled)
        level += 1
    root = units.groupBy("source").agg(F.collect_list(F.struct("size", "key", "p")).alias("us"))  # ROOT at most
    last = root.select(F.explode(_settle(F.col("us"), level, seed)).alias("key"))
    return last if ups is None else ups.unionByName(last)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs: how often the mix takes it.

    Size is the number of words; null and empty texts have size 0 and no copies. Null sources are one source. Null ids and
    repeated rows are rounded one by one, like any others. Other columns of docs are ignored. An empty table gives an empty
    result. Reruns over the same rows give the same copies, however the rows are dealt."""
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
    )
    same = W.partitionBy("doc_id", "source", "h").orderBy("size")
    sized = saved(sized.withColumn("key", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "h", F.row_number().over(same).alias("n"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("sn"))).drop("h"))
    shares = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumnRenamed("source", "of")
    wanted = sized.join(shares, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = saved(wanted.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate)))
    ups = round_dependently(wanted.filter("size > 0 and p > 0").select("source", "size", "key", "p"), seed)
    ups = ups.withColumn("up", F.lit(1))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("up", F.lit(0))).otherwise(F.lit(0)).cast("long")
    out = wanted.join(ups, "key", "left").withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))

