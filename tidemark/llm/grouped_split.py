"""Splits that keep related records together.

Method. Records and the entities they name (author, airframe, work pack) form a
bipartite graph. Minimum labels are propagated over it: each round an entity
takes the least label of its records, a record the least label of its entities.
Then the graph is contracted: records of equal label become one node, and
entities with a single node are done, so every round works on a fraction of the
last one's edges. When no entity has two nodes, the labels of the rounds are
composed; records of equal label are related. Groups are then assigned to
parts: the groups of more than a ``LARGE_SHARE`` of all records one after
another, each to the part where it leaves the least deviation from the wanted
sizes, overall and by label; the many small ones in a hashed order, by the
running sum of sizes within their main label, so that each part gets its share
of every label.

Scale. An entity that more than ``hot`` records name is split into sub-entities
tied together by a virtual record, so no entity's records meet in one task.
Least labels are aggregated before they are sent, and joined back; a node in
which a large component has been contracted, with all of its entities, is a hot
key of that join only, which adaptive execution may split. A round's result is
written to the shared folder, which cuts the lineage. The hot entities, at most
(edges / hot), and the counts of labels stay in tables. The driver handles at
most 1 / LARGE_SHARE groups.

Defined cases. Values are compared by letters and digits only, case ignored; a
value without any digit names nobody. Null maps, missing keys and null values
name nobody. A record related to no other is a group of its own. Repeated rows
(same id) are one record, with the entities of all its rows; its label is the
least one. A null label is a label of its own. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _cluster

#: Kinds of entity and the keys of the map under which they stand.
ENTITIES = {"author": ("author", "technician", "signed_by"), "airframe": ("tail", "tail_no"), "pack": ("work_pack", "wp")}
HOT = 100_000
LARGE_SHARE = 1e-4
PARTS = (("train", 0.8), ("dev", 0.1), ("test", 0.1))


def named_entities(df: DataFrame, id_col: str, meta_col: str, entities: dict[str, tuple[str, ...]]) -> DataFrame:
    """Distinct (rid, entity) of the records; both are 64-bit hashes."""
    pairs = F.array(
        *(
            F.struct(F.lit(kind).alias("kind"), F.regexp_replace(F.lower(F.col("meta")[key]), r"[^\p{L}\p{N}]", "").alias("value"))
            for kind, keys in entities.items()
            for key in keys
        )
    )
    return (
        df.select(F.col(id_col).alias("record_id"), F.col(meta_col).alias("meta"))
        .where("record_id is not null and meta is not null")
        .select("record_id", F.explode(pairs).alias("e"))
        .where(F.col("e.value").rlike(r"\p{N}"))
        .select(F.xxhash64("record_id").alias("rid"), F.xxhash64("e.kind", "e.value").alias("entity"))
        .distinct()
    )


def _split_hot(edges: DataFrame, hot: int) -> DataFrame:
    """Edges (node, entity) in which no entity has many more than ``hot`` records."""
    counts = edges.groupBy("entity").agg(F.count("*").alias("n")).where(f"n > {hot}")
    # At most (edges / hot) rows, written so that their size decides the join.
    parts = _cluster.stored(counts.select("entity", F.ceil(F.col("n") / hot).cast("long").alias("parts")), "hot")
    plain = edges.select(F.col("rid").alias("node"), "entity")
    if parts.isEmpty():
        return plain
    salt = F.pmod(F.xxhash64("node", F.lit("salt")), F.col("parts"))
    sub = F.when(F.col("parts").isNotNull(), F.xxhash64("entity", salt)).otherwise(F.col("entity"))
    spread = plain.join(parts, "entity", "left").select("node", sub.alias("entity"))
    ties = parts.select("entity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    ties = ties.select(F.xxhash64("entity", F.lit("virtual")).alias("node"), F.xxhash64("entity", "salt").alias("entity"))
    return spread.unionByName(ties)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, label) for the nodes of (node, entity) edges that share an entity; connected nodes have equal labels."""
    rounds: list[DataFrame] = []
    while True:
        # Every aggregation merges within its tasks first, also the repeats of contracted edges.
        ends = edges.groupBy("entity").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("entity", "least")
        heard = edges.select("node", "entity").distinct().join(ends, "entity")
        labels = heard.groupBy("node").agg(F.min("least").alias("label"))
        done = _cluster.stored(heard.select("node", "entity").join(labels, "node"), "round")
        if done.isEmpty():
            break
        rounds.append(done.select("node", "label"))
        edges = done.select(F.col("label").alias("node"), "entity")
        if len(rounds) > max_rounds:
            raise RuntimeError(f"labels still change after {max_rounds} rounds")
    if not rounds:
        return done.select("node", "label")
    # From the last and smallest round back to the first.
    labels = rounds[-1].distinct()
    for earlier in reversed(rounds[:-1]):
        after = labels.select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = earlier.distinct().join(after, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    return labels


def related_groups(
    df: DataFrame,
    *,
    id_col: str = "record_id",
    meta_col: str = "meta",
    entities: dict[str, tuple[str, ...]] = ENTITIES,
    hot: int = HOT,
) -> DataFrame:
    """(record_id, group_id) for each record that is related to another; group_id is the least record id."""
    edges = _cluster.stored(named_entities(df, id_col, meta_col, entities), "edges")
    labels = components(_split_hot(edges, hot)).withColumnRenamed("node", "rid")
    ids = df.select(F.col(id_col).alias("record_id")).where("record_id is not null").distinct()
    members = ids.withColumn("rid", F.xxhash64("record_id")).join(labels, "rid").select("record_id", "label")
    groups = members.groupBy("label").agg(F.min("record_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return members.join(groups, "label").select("record_id", "group_id")


def grouped_split(
    df: DataFrame,
    *,
    id_col: str = "record_id",
    meta_col: str = "meta",
    label_col: str = "label",
    parts: tuple[tuple[str, float], ...] = PARTS,
    entities: dict[str, tuple[str, ...]] = ENTITIES,
    hot: int = HOT,
    large_share: float = LARGE_SHARE,
) -> DataFrame:
    """(record_id, group_id, part): groups whole, sizes near the given shares, overall and by label."""
    if abs(sum(s for _, s in parts) - 1) > 1e-9 or any(s <= 0 for _, s in parts):
        raise ValueError("the shares of the parts are positive and add up to 1")
    spark = df.sparkSession
    groups = related_groups(df, id_col=id_col, meta_col=meta_col, entities=entities, hot=hot)
    records = df.select(F.col(id_col).alias("record_id"), F.col(label_col).cast("string").alias("label")).where("record_id is not null")
    records = records.groupBy("record_id").agg(F.coalesce(F.min("label"), F.lit("")).alias("label"))
    placed = records.join(groups, "record_id", "left").withColumn("group_id", F.coalesce("group_id", "record_id"))
    placed = _cluster.stored(placed.select("record_id", "label", "group_id"), "placed")
    by_label = placed.groupBy("group_id", "label").agg(F.count("*").alias("n"))
    total = placed.groupBy("label").agg(F.count("*").alias("of_label"))
    everything = placed.count()
    sizes = by_label.groupBy("group_id").agg(F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("main"))
    bound = max(1, int(everything * large_share))
    large = by_label.join(sizes.where(f"size > {bound}").select("group_id", "size"), "group_id").join(total, "label").collect()
    chosen, filled = _assign_large(large, everything, parts)
    small = _assign_small(sizes.where(f"size <= {bound}"), total, everything, filled, parts)
    big = spark.createDataFrame(list(chosen.items()) or [], "group_id string, part string")
    return placed.join(small.unionByName(big), "group_id").select("record_id", "group_id", "part")


def _assign_large(rows: list, everything: int, parts: tuple[tuple[str, float], ...]) -> tuple[dict[str, str], dict[str, dict[str, int]]]:
    """Parts of the large groups, largest first, and how many records of each label each part then has."""
    groups: dict[str, dict[str, int]] = defaultdict(dict)
    total = {}
    for r in rows:
        groups[r["group_id"]][r["label"]] = r["n"]
        total[r["label"]] = r["of_label"]
    filled: dict[str, dict[str, int]] = {p: defaultdict(int) for p, _ in parts}
    chosen = {}
    for g, counts in sorted(groups.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        size = sum(counts.values())

        def deviation(part: str, share: float, counts: dict[str, int] = counts, size: int = size) -> float:
            # How far the part is from its wanted size, relative to it; less room is worse.
            have = filled[part]
            whole = (sum(have.values()) + size) / (share * everything)
            return whole + sum(n / size * (have[label] + n) / (share * total[label]) for label, n in counts.items())

        chosen[g] = min(parts, key=lambda p: deviation(*p))[0]
        for label, n in counts.items():
            filled[chosen[g]][label] += n
    return chosen, filled


def _cuts(total: DataFrame, filled: dict[str, dict[str, int]], parts: tuple[tuple[str, float], ...]) -> DataFrame:
    """(main, part, lo, hi): the shares of the small groups of a label that each part takes, by the room it has left."""
    spark = total.sparkSession
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("part"), F.lit(s).alias("share")) for i, (p, s) in enumerate(parts)))).alias("p")
    used = spark.createDataFrame([(label, p, n) for p, have in filled.items() for label, n in have.items()], "label string, part string, used long")
    room = F.greatest(F.lit(0.0), F.col("share") * F.col("of_label") - F.coalesce("used", F.lit(0)))
    rows = total.select("label", "of_label", listed).select("label", "of_label", "p.*").join(used, ["label", "part"], "left").withColumn("room", room)
    order = Window.partitionBy("label")
    upto = F.sum("room").over(order.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("room").over(order)
    scaled = lambda x: F.when(whole > 0, x / whole).otherwise(0.0)
    return rows.select(F.col("label").alias("main"), "part", scaled(upto - F.col("room")).alias("lo"), F.when(F.col("i") == len(parts) - 1, 2.0).otherwise(scaled(upto)).alias("hi"))


def _assign_small(sizes: DataFrame, total: DataFrame, everything: int, filled: dict[str, dict[str, int]], parts: tuple[tuple[str, float], ...]) -> DataFrame:
    """Parts of the small groups: within each main label by the running share of sizes in a hashed order.

    The running sum is taken within (label, slice of the hash), a bounded number
    of rows at a time; every slice is cut at the same shares.
    """
    slices = max(1, everything // 2_000_000)
    h = F.xxhash64("group_id", F.lit("order"))
    order = Window.partitionBy("main", "slice").orderBy("h", "group_id")
    running = (
        sizes.withColumn("h", h)
        .withColumn("slice", F.pmod(F.xxhash64("group_id", F.lit("slice")), F.lit(slices)))
        .withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("of", F.sum("size").over(Window.partitionBy("main", "slice")))
        .withColumn("at", (F.col("upto") - F.col("size") / 2) / F.col("of"))
    )
    return running.join(_cuts(total, filled, parts), "main").where("at >= lo and at < hi").select("group_id", "part")
