"""Splitting records into train, dev and test so that duplicates and groups never straddle.

Groups are ordered by a seeded hash, and the running share of their sizes
decides the part. The running sum is taken inside slices of the hash; the sums
of the slices, at most 65,536, are added on top, so no task orders all groups
and no group list reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import SplitError
from tidemark.operators.components import connected_components

PARTS = ("train", "dev", "test")
#: Hexadecimal digits of the hash that name a slice.
SLICE_DIGITS = 4


def groups_of(records: DataFrame, membership: DataFrame | None = None, group_by: str | None = None) -> DataFrame:
    """(record_id, pos, root): the lowest position of all records tied by a cluster or an equal ``meta[group_by]``."""
    base = records.select("record_id", "pos", "meta")
    edges = None
    if group_by is not None:
        value = F.col("meta")[group_by]
        if not base.where(value.isNull()).isEmpty():
            raise SplitError(f"some records have no meta[{group_by!r}]", "group by a key that every record has")
        least = base.groupBy(value.alias("v")).agg(F.min("pos").alias("b"))
        if membership is None:  # values alone tie no groups together, so there is no graph
            return base.select("record_id", "pos", value.alias("v")).join(least, "v").select("record_id", "pos", F.col("b").alias("root"))
        edges = base.select(F.col("pos").alias("a"), value.alias("v")).join(least, "v").where("a != b").select("a", "b")
    if membership is not None:
        dup = membership.where("pos != keep_pos").select(F.col("pos").alias("a"), F.col("keep_pos").alias("b"))
        edges = dup if edges is None else edges.unionByName(dup)
    if edges is None:
        return base.select("record_id", "pos", F.col("pos").alias("root"))
    roots = connected_components(edges).withColumnRenamed("node", "pos")
    return base.join(roots, "pos", "left").select("record_id", "pos", F.coalesce("root", "pos").alias("root"))


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if len(ratios) != 3 or any(r <= 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise SplitError(f"ratios of {ratios} are not three positive shares of 1", "give shares such as 0.8 0.1 0.1")


def assign(groups: DataFrame, *, seed: int, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """(record_id, root, part); a group goes where the middle of its stretch of the running sum lies."""
    check_ratios(ratios)
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("root").cast("string")), 256)
    keyed = sizes.select("root", "size", h.alias("h")).withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    within = keyed.withColumn("upto", F.sum("size").over(Window.partitionBy("slice").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
    # A bounded number of slices, whatever the number of groups.
    slices = keyed.groupBy("slice").agg(F.sum("size").alias("s"))
    before = slices.select(
        "slice",
        F.coalesce(F.sum("s").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("s").over(Window.partitionBy()).alias("total"),
    )
    at = (F.col("before") + F.col("upto") - F.col("size") / 2) / F.col("total")
    part = F.when(at < ratios[0], PARTS[0]).when(at < ratios[0] + ratios[1], PARTS[1]).otherwise(PARTS[2])
    parts = within.join(F.broadcast(before), "slice").select("root", part.alias("part"))
    return groups.join(parts, "root").select("record_id", "root", "part")


def split_corpus(records: DataFrame, *, seed: int, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), membership: DataFrame | None = None, group_by: str | None = None) -> DataFrame:
    """The records with their part; an empty corpus or an empty part is an error."""
    check_ratios(ratios)
    done = records.join(assign(groups_of(records, membership, group_by), seed=seed, ratios=ratios).select("record_id", "part"), "record_id")
    have = {r["part"] for r in done.select("part").distinct().collect()}
    if not have:
        raise SplitError("there are no records to split", "give a corpus with records")
    if missing := [p for p in PARTS if p not in have]:
        raise SplitError(f"no record went to {', '.join(missing)}", "give more records, or smaller groups")
    return done


def split_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("part").agg(F.count("*").alias("records"), F.count_distinct("root").alias("groups"))


def split_digest(assigned: DataFrame) -> DataFrame:
    """(part, digest) over the sorted ids of each part."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "record_id"))), "\n")
    return assigned.groupBy("part").agg(F.sha2(lines, 256).alias("digest"))


def straddling(assigned: DataFrame, key: str = "root") -> DataFrame:
    """One row: groups with records in more than one part; 0 for a sound split."""
    return assigned.groupBy(key).agg(F.count_distinct("part").alias("parts")).where("parts > 1").agg(F.count("*").alias("straddling"))
