"""Problem 9: items into fixed-capacity containers, by bounded-space online packing.

Each partition keeps ``OPEN`` containers open.  An item goes into the open container that it fills best;
when it fits into none, the fullest is emitted and a new one opened.  What is still open at the end of a
partition is left over; leftovers (at most OPEN a partition) are merged in rounds, many partitions'
leftovers in one task of the next round, until one task is left.

A document longer than the capacity is divided into full containers and a rest; only such are divided.
A container holds at most as many items as it has tokens, so that empty documents, which take no room,
cannot pile up in one row.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.tokens import encoded
from quillmark.sources.tables import materialize, table

OPEN = 64
FAN_IN = 16  # partitions whose leftovers meet in one task

ITEM = "struct<doc_id:long,piece:int,start_token:int,n_tokens:int>"
SCHEMA = f"container_kind string, capacity_tokens int, container_id string, filled int, closed boolean, items array<{ITEM}>"
_ITEM_TYPE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start_token", pa.int32()), ("n_tokens", pa.int32())])


class Packer:
    """Open containers of one capacity, sorted by free room."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.free: list[tuple[int, int]] = []  # (room, number)
        self.items: dict[int, list] = {}
        self.count = 0

    def add(self, size: int, items: list) -> list | None:
        """Place ``items`` of total ``size``; the items of a container that had to be emitted, or None."""
        at = bisect.bisect_left(self.free, (size, -1))
        while at < len(self.free):
            room, k = self.free[at]
            if len(self.items[k]) + len(items) <= self.capacity:
                del self.free[at]
                self.items[k] += items
                bisect.insort(self.free, (room - size, k))
                return None
            at += 1
        emitted = None
        if len(self.free) >= self.most_open:
            _, k = self.free.pop(0)
            emitted = self.items.pop(k)
        self.items[self.count] = list(items)
        bisect.insort(self.free, (self.capacity - size, self.count))
        self.count += 1
        return emitted

    def rest(self) -> list[list]:
        return [self.items[k] for _, k in self.free]


def _pack(parts: Iterator[pa.RecordBatch], level: int, last: bool) -> Iterator[pa.RecordBatch]:
    place = TaskContext.get().partitionId()
    packers: dict[tuple[str, int], Packer] = {}
    made, out = 0, []

    def row(kind: tuple[str, int], items: list, closed: bool) -> None:
        nonlocal made
        out.append((*kind, f"{kind[0]}-{level}-{place}-{made}", sum(i["n_tokens"] for i in items), closed, items))
        made += 1

    def flush() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.list_(_ITEM_TYPE)]
        names = ["container_kind", "capacity_tokens", "container_id", "filled", "closed", "items"]
        arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for part in parts:
        for kind, capacity, items in zip(part.column("container_kind").to_pylist(), part.column("capacity_tokens").to_pylist(), part.column("items").to_pylist()):
            packer = packers.setdefault((kind, capacity), Packer(capacity))
            emitted = packer.add(sum(i["n_tokens"] for i in items), items)
            if emitted is not None:
                row((kind, capacity), emitted, True)
        if out:
            yield flush()
    for kind, packer in packers.items():
        for items in packer.rest():
            row(kind, items, last)
    if out:
        yield flush()


def pack(lengths: DataFrame, spec: DataFrame) -> DataFrame:
    """The rows of SCHEMA (one a container) for ``lengths`` (doc_id, n_tokens) and ``spec`` (container_kind,
    capacity_tokens; a few rows).  Kinds without a positive capacity and null lengths are left out."""
    spec = spec.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity_tokens"))
    each = lengths.where("n_tokens is not null").join(F.broadcast(spec))  # spec is a table of fixed size
    cap, n = F.col("capacity_tokens"), F.col("n_tokens")
    last = F.greatest(F.lit(0), F.expr("int((n_tokens - 1) div capacity_tokens)"))
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("start_token", F.col("piece") * cap)
    pieces = pieces.withColumn("size", F.least(cap, n - F.col("start_token")))
    item = F.struct("doc_id", "piece", "start_token", F.col("size").cast("int").alias("n_tokens"))
    rows = pieces.select("container_kind", "capacity_tokens", "size", F.array(item).alias("items"))
    full = rows.where("size = capacity_tokens").select(
        "container_kind",
        "capacity_tokens",
        F.concat_ws("-", "container_kind", F.lit("full"), F.col("items")[0]["doc_id"].cast("string"), F.col("items")[0]["piece"].cast("string")).alias("container_id"),
        F.col("capacity_tokens").alias("filled"),
        F.lit(True).alias("closed"),
        "items",
    )
    todo = rows.where("size < capacity_tokens").drop("size")
    parts = todo.rdd.getNumPartitions()
    done, level = full, 0
    while True:
        last_round = parts <= 1
        packed = materialize(todo.mapInArrow(lambda it, lv=level, la=last_round: _pack(it, lv, la), SCHEMA), f"packed{level}")
        done = done.unionByName(packed.where("closed"))
        if last_round:
            return done
        parts = -(-parts // FAN_IN)
        level += 1
        # the order within a task must not depend on which data came first
        todo = packed.where("not closed").repartition(parts, F.xxhash64("container_id")).sortWithinPartitions("container_kind", F.desc("filled"), "container_id")
        todo = todo.select("container_kind", "capacity_tokens", "items")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = materialize(encoded(table(spark, sf_dir, "documents"), lengths_only=True), "lengths")
    return pack(lengths, table(spark, sf_dir, "container_spec"))


def p9_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """container_kind, capacity_tokens, container_id, doc_id, piece, start_token, n_tokens: every document of
    every kind, null and empty ones with 0 tokens."""
    rows = p9_containers(spark, sf_dir).select("container_kind", "capacity_tokens", "container_id", F.explode("items").alias("i"))
    return rows.select("container_kind", "capacity_tokens", "container_id", "i.doc_id", "i.piece", "i.start_token", "i.n_tokens")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """container_kind, containers, tokens, mean_fill (share of the room that is used)."""
    return (
        p9_containers(spark, sf_dir)
        .groupBy("container_kind", "capacity_tokens")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("filled").alias("tokens"), F.max("filled").alias("fullest"))
        .withColumn("mean_fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4))
    )


QUERIES = {"p9_assignments": p9_assignments, "p9_fill": p9_fill}
