"""Filling containers of fixed capacity with items of varying length.

Method. Bounded-space online packing: every task keeps ``windows`` open
containers for each capacity. An item goes to the open container where it
leaves the least room (best fit); when none can take it, the fullest is closed
and emitted, and a new one opened. An item that exceeds the capacity by itself
is cut into full containers and a rest, which is packed like any item; no other
item is split. When a task ends, its open containers are left over; leftovers
are merged in further rounds of ever fewer tasks by the same rule, each as one
item of its fill.

Scale. Items stay where they are. A task keeps the placements of its open
containers, at most ``windows`` for a capacity, until they are closed; only
those still open at its end are marked and meet the later rounds, so all other
placements are never shuffled or joined. A round takes the leftovers of
``FAN_IN`` tasks, so no task ever sees more than FAN_IN * windows of them for a
capacity.

Defined cases. An item without length (an empty or null text) is in no
container. Sizes are counted in whole tokens; every token comes out once, as a
range [token_start, token_end) of its item. Repeated rows are items of their
own. A capacity below 1 is an error. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _cluster

WINDOWS = 64
FAN_IN = 64


class Windows:
    """The open containers of one capacity, ordered by the room they have left."""

    def __init__(self, capacity: int, limit: int, names: Iterator[str]) -> None:
        self.capacity, self.limit, self.names = capacity, limit, names
        self.open: list[tuple[int, str]] = []  # (room, name), sorted

    def place(self, size: int) -> tuple[str, list[str]]:
        """The container of an item, and the containers that are closed now."""
        closed = []
        i = bisect_left(self.open, (size, ""))
        if i < len(self.open):
            room, name = self.open.pop(i)
        else:
            if len(self.open) >= self.limit:
                closed.append(self.open.pop(0)[1])
            room, name = self.capacity, next(self.names)
        if room > size:
            insort(self.open, (room - size, name))
        else:
            closed.append(name)
        return name, closed


_ITEM = pa.schema(
    [("capacity", pa.int64()), ("container", pa.string()), ("item", pa.int64()), ("token_start", pa.int64()), ("token_end", pa.int64()), ("fill", pa.int64()), ("left", pa.bool_())]
)


def _names(stage: str) -> Iterator[str]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    return (f"{stage}-{task}-{n}" for n in count())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _pack(capacities: list[int], windows: int):
    """Placements of the items, those of containers left open marked, and one row without an item for each of these, with its fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names("a")
        state = [Windows(c, windows, names) for c in capacities]
        held: dict[str, list[tuple]] = defaultdict(list)
        for batch in batches:
            items, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(items), 2000):
                rows = []
                for item, size in zip(items[lo : lo + 2000], sizes[lo : lo + 2000], strict=True):
                    for w in state:
                        at = 0
                        while size - at >= w.capacity and size > w.capacity:
                            rows.append((w.capacity, next(names), item, at, at + w.capacity, None, False))
                            at += w.capacity
                        if size > at:
                            name, closed = w.place(size - at)
                            held[name].append((w.capacity, name, item, at, size, None, False))
                            for c in closed:
                                rows += held.pop(c)
                yield _batch(rows, _ITEM)
        for w in state:
            for room, name in w.open:
                marked = [(*row[:6], True) for row in held[name]]
                yield _batch([*marked, (w.capacity, name, None, None, None, w.capacity - room, True)], _ITEM)

    return run


_MERGE = pa.schema([("capacity", pa.int64()), ("container", pa.string()), ("into", pa.string()), ("fill", pa.int64())])


def _merge(capacities: list[int], windows: int, stage: str):
    """Where each leftover goes, and one row without an origin for each container still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(stage)
        state = {c: Windows(c, windows, names) for c in capacities}
        # Rows arrive with the largest first, for which best fit wastes least.
        for batch in batches:
            rows = [
                (c, name, state[c].place(fill)[0], None)
                for c, name, fill in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            ]
            yield _batch(rows, _MERGE)
        yield _batch([(c, None, name, c - room) for c, w in state.items() for room, name in w.open], _MERGE)

    return run


def pack(items: DataFrame, capacities: list[int], *, id_col: str, size_col: str, windows: int = WINDOWS) -> DataFrame:
    """Placements (capacity, container, item, token_start, token_end); see the module for the rules."""
    if any(c < 1 for c in capacities):
        raise ValueError("a capacity is at least 1")
    spark = items.sparkSession
    _cluster.ship(spark)
    capacities = sorted(set(capacities))
    sized = items.select(F.col(id_col).cast("long").alias("item"), F.col(size_col).cast("long").alias("size")).where("size > 0 and item is not null")
    placed = _cluster.stored(
        sized.mapInArrow(_pack(capacities, windows), "capacity long, container string, item long, token_start long, token_end long, fill long, left boolean"),
        "placed",
    )
    whole = placed.where("not left").drop("fill", "left")
    result = placed.where("left and item is not null").drop("fill", "left")
    left = placed.where("item is null").select("capacity", "container", "fill")
    tasks = max(1, placed.rdd.getNumPartitions())
    stage = 0
    while True:
        tasks, stage = -(-tasks // FAN_IN), stage + 1
        moved = _cluster.stored(
            left.repartition(tasks, F.substring_index("container", "-", 2))
            .sortWithinPartitions(F.desc("fill"), "container")
            .mapInArrow(_merge(capacities, windows * FAN_IN if tasks == 1 else windows, f"m{stage}"), "capacity long, container string, into string, fill long"),
            "moved",
        )
        result = (
            result.join(moved.where("container is not null").drop("fill"), ["capacity", "container"], "left")
            .withColumn("container", F.coalesce("into", "container"))
            .select("capacity", "container", "item", "token_start", "token_end")
        )
        if tasks == 1:
            return whole.unionByName(result)
        left = moved.where("container is null").select("capacity", F.col("into").alias("container"), "fill")


def pack_documents(df: DataFrame, capacities: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", windows: int = WINDOWS, **encoding: str) -> DataFrame:
    """Placements of the documents of ``df`` in the containers of every profile of ``capacities``, measured in tokens."""
    from tidemark.llm.token_ids import token_ids

    ids = token_ids(df, id_col=id_col, text_col=text_col, **encoding)
    sizes = _cluster.stored(ids.select(F.col(id_col), F.size("ids").alias("n_tokens")), "sizes")
    profiles = capacities.where("capacity_tokens is not null").select("profile", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    # A table of profiles: a fixed handful of rows.
    wanted = [r["capacity"] for r in profiles.select("capacity").distinct().collect()]
    placed = pack(sizes, wanted, id_col=id_col, size_col="n_tokens", windows=windows)
    return placed.join(F.broadcast(profiles), "capacity").withColumnRenamed("item", id_col)


def unused_share(placements: DataFrame) -> DataFrame:
    """(profile, containers, tokens, unused_share) of placements."""
    return (
        placements.groupBy("profile", "capacity", "container")
        .agg(F.sum(F.col("token_end") - F.col("token_start")).alias("fill"))
        .groupBy("profile", "capacity")
        .agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"))
        .select("profile", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))
    )
