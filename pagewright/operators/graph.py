"""The object graph as tables: objects (num, key, ...) and references (src, dst).

Walks are iterative frontier joins or recursive queries; duplicate detection is
a fixed point with a bounded number of rounds. Nothing but row counts is
collected, and lineage is cut in the checkpoint folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .storage import checkpointed

ROUNDS = 6  # of the duplicate search
HOPS = 64  # of inheritance


def running_totals(rows: DataFrame, groups: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over the rows before them in their group, by ``order``; ties in any order.

    Rows are dealt out by ranges, summed within a range, and the sums of the ranges
    before are added, so a group of any size spreads over the tasks; only one row a
    range and group meets in one place.
    """
    keys = [F.col(c) for c in (*groups, *order)]
    dealt = checkpointed(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range", *groups).agg(F.sum(amount).alias("_sum"))
    ranges = ranges.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    within = Window.partitionBy("_range", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return summed.join(ranges, same).select(*rows.columns, (F.col("_before") + F.col("_within")).alias(out))


def reachable(references: DataFrame, roots: DataFrame, most: int = 1000) -> DataFrame:
    """(node, depth): all objects that roots (node) lead to, at the least number of steps; more than ``most`` are an error.

    Cycles are safe.
    """
    found = checkpointed(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = found
    for depth in range(1, most + 1):
        step = references.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise RuntimeError(f"not done after {most} steps")


def inherit(nodes: DataFrame, attribute: str, hops: int = HOPS) -> DataFrame:
    """``nodes`` (num, parent, attribute) with the attribute of the nearest ancestor that has one.

    Pointers double each round, so a chain of ``hops`` needs log2(hops) joins.
    """
    now = nodes.select("num", F.col("parent").alias("_up"), F.col(attribute).alias("_v"))
    reach = 1
    while reach < hops:
        above = now.select(F.col("num").alias("_up"), F.col("_up").alias("_next"), F.col("_v").alias("_above"))
        now = checkpointed(now.join(above, "_up", "left").select(
            "num", F.when(F.col("_v").isNull(), F.col("_next")).alias("_up"), F.coalesce("_v", "_above").alias("_v")))
        reach *= 2
        if now.where("_v is null and _up is not null").isEmpty():
            break
    return nodes.drop(attribute).join(now.select("num", F.col("_v").alias(attribute)), "num")


def remap(references: DataFrame, renamed: DataFrame) -> DataFrame:
    """References with targets renamed (old, new); a target without a new name becomes null."""
    return references.join(renamed, references["dst"] == renamed["old"], "left").select("src", F.col("new").alias("dst"))


def canonical(items: DataFrame, key: str, content: str, order: str | None = None) -> DataFrame:
    """(key, canonical): the first row of equal content, by ``order`` (the key by default)."""
    first = items.groupBy(content).agg(F.min_by(key, order or key).alias("canonical"))
    return items.join(first, content).select(key, "canonical")


def dedupe(objects: DataFrame, references: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(num, canonical): equal objects merged, children first, until nothing changes or ``rounds`` are done.

    ``objects`` is (num, content); ``references`` is (src, slot, dst). Two objects
    are equal if their contents are and their references, after merging, lead to
    the same objects; the least number stays.
    """
    alias = checkpointed(objects.select("num", F.col("num").alias("canonical")))
    groups = -1
    for _ in range(rounds):
        target = references.join(alias.withColumnRenamed("num", "dst"), "dst", "left").select("src", "slot", F.coalesce("canonical", "dst").alias("dst"))
        links = target.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("slot", "dst"))).alias("links"))
        signed = objects.join(links, objects["num"] == links["src"], "left").select(
            "num", F.sha2(F.to_json(F.struct("content", F.coalesce("links", F.array().cast(links.schema["links"].dataType)).alias("links"))), 256).alias("sign"))
        first = signed.groupBy("sign").agg(F.min("num").alias("canonical"))
        alias = checkpointed(signed.join(first, "sign").select("num", "canonical"))
        now = alias.select("canonical").distinct().count()
        if now == groups:
            break
        groups = now
    return alias


def first_use(uses: DataFrame, key: str = "xref") -> DataFrame:
    """The first placed use of each object in page order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("page_ix", "op_ix"))
    return uses.withColumn("_r", rank).where("_r = 1").drop("_r")


def range_lookup(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """Name-tree lookup: each key with the leaf (low, high, value) whose limits hold it; leaves do not overlap.

    Keys and limits are sorted together, by ranges; the leaf of a key is the last
    one that begins at or before it, perhaps in an earlier range. A key without a
    leaf has null low, high and value.
    """
    leaf = F.struct("low", "high", "value")
    spots = nodes.select(F.col("low").alias("key"), leaf.alias("leaf"))
    wanted = keys.select("key").where("key is not null").distinct().select("key", F.lit(None).cast(spots.schema["leaf"].dataType).alias("leaf"))
    both = checkpointed(spots.unionByName(wanted).repartitionByRange("key").withColumn("_range", F.spark_partition_id()))
    last = both.where("leaf is not null").groupBy("_range").agg(F.max_by("leaf", "key").alias("last"))
    ranges = both.select("_range").distinct().join(last, "_range", "left")
    earlier = ranges.select(F.col("_range"), F.last("last", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    here = F.last("leaf", ignorenulls=True).over(Window.partitionBy("_range").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_here", here).where("leaf is null").join(earlier, "_range").select(F.col("key").alias("_key"), F.coalesce("_here", "_earlier").alias("_leaf"))
    held = F.when(F.col("_key") <= F.col("_leaf.high"), F.col("_leaf"))
    found = found.select("_key", held.alias("_leaf"))
    return keys.join(found, keys["key"] == found["_key"], "left").select(*[keys[c] for c in keys.columns], *[F.col(f"_leaf.{c}").alias(c) for c in ("low", "high", "value")])


def flatten_tree(spark: SparkSession, nodes: DataFrame, most: int = 32) -> DataFrame:
    """(num, path, depth): depth-first order of a tree (num, parent, pos); roots have a null parent.

    A tree of more than ``most`` levels (or one with a cycle below a root) is an error.
    """
    level = nodes.where("parent is null").select("num", F.array("pos").alias("path"), F.lit(0).alias("depth"))
    out = level
    for depth in range(1, most + 1):
        child = nodes.select(F.col("num").alias("_n"), F.col("parent").alias("_p"), "pos")
        level = checkpointed(child.join(level, child["_p"] == level["num"]).select(
            F.col("_n").alias("num"), F.concat("path", F.array("pos")).alias("path"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError(f"a tree of more than {most} levels")


def prune(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """A tree (num, parent, is_leaf) without the removed leaves and without inner nodes that lost all children."""
    left = checkpointed(nodes.join(removed.select("num"), "num", "left_anti"))
    size = left.count()
    while True:  # each round takes a node at least, so it ends
        parents = left.where("parent is not null").select(F.col("parent").alias("num")).distinct()
        left = checkpointed(left.where("is_leaf").unionByName(left.where("not is_leaf").join(parents, "num", "left_semi")))
        now = left.count()
        if now == size:
            return left
        size = now
