"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns; its address is its smallest member and its depth. Conversations are put in
the order of their paths and dealt into shards of neighbours, so that nearly every subtree lies within one shard. Within
a shard the nodes are sorted externally in reverse level order and gone through once: a node takes the messages of its
children from a priority queue, adds its own part, and sends the total to its parent. The queue spills sorted runs to a
scratch file of the task. A node with members in several shards has a level above them: the least number of bits to cut
from the shard's number until its members agree, in steps of `FAN`. What reaches such a node from below is added up per
node and meets it in the next pass, across the shards' roots, then across theirs.

A path's key is the running XOR of hashes of each turn with its depth, 128 bits together.

* Null roles and texts are empty strings. Turns are in the order of `turn`, null first, then of role and text. Rows
  without a conv_id are left out. Repeated rows are turns of their own.
* The root stands for the empty sequence and has every conversation as a member; without conversations there is no row.
* Texts of any length are hashed and counted whole. Other columns are ignored.
* One conversation's turns are put in order by one task, in a sort that spills, and so are the bytes of one node's digest,
  which is a sequential hash. Nothing else depends on the size of a conversation, a node or a level.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import discard, extended, stored

#: Turns of a path that its conversation's place in the order is taken from.
ORDER = 32
#: Nodes a shard has at least where there are more shards than the session's shuffle partitions.
SHARD = 1 << 18
FAN = 6
#: Messages a queue holds in memory.
QUEUE = 1 << 17
#: Ids in one piece of a digest's input.
PIECE = 4096


def hashed(rows: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), two hashes of role and text, and the text's bytes."""
    rows = rows.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("depth"),
        F.xxhash64("role", "text").alias("x"),
        F.xxhash64(F.lit(1), "text", "role").alias("y"),
        F.octet_length("text").cast("long").alias("bytes"),
    )


def rebuilt(turns: DataFrame, source: Column, head: Column, most: int) -> DataFrame:
    """Turns of conversations that start with the first `head` turns (at most `most`) of another one, `source`, and go on
    with their own turns after as many; besides a row of depth 0 for every conversation. Adds `last`, whether the
    conversation ends there."""
    lengths = stored(turns.groupBy("conv_id").agg(F.max("depth").alias("_n")))
    plans = lengths.select("conv_id", "_n", source.alias("_source"), head.cast("long").alias("_head"))
    lent = lengths.select(F.col("conv_id").alias("_source"), F.col("_n").alias("_lent"))
    plans = plans.join(lent, "_source", "left").withColumn("_taken", F.least("_head", F.coalesce("_lent", F.lit(0).cast("long"))))
    length = F.col("_taken") + F.greatest(F.col("_n") - F.col("_head"), F.lit(0).cast("long"))
    plans = stored(plans.select("conv_id", "_source", "_head", "_taken", length.alias("_length")))
    given = turns.where(F.col("depth") <= most).withColumnRenamed("conv_id", "_source")
    heads = plans.where("_taken > 0").join(given, "_source").where("depth <= _taken")
    tails = turns.join(plans, "conv_id").where("depth > _head").withColumn("depth", F.col("_taken") + F.col("depth") - F.col("_head"))
    tops = plans.selectExpr("conv_id", "0L AS depth", "0L AS x", "0L AS y", "0L AS bytes", "_length")
    columns = ["conv_id", "depth", "x", "y", "bytes", "_length"]
    every = tops.unionByName(heads.select(columns)).unionByName(tails.select(columns))
    return every.withColumn("last", F.col("depth") == F.col("_length")).drop("_length")


def _keyed(turns: DataFrame) -> DataFrame:
    """Adds the keys of each turn's path (k1, k2) and of the path before it (p1, p2). The root's are zero."""
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    own = {"_x": F.when(F.col("depth") > 0, F.xxhash64("depth", "x")).otherwise(zero), "_y": F.when(F.col("depth") > 0, F.xxhash64("y", "depth")).otherwise(zero)}
    rows = turns.withColumns(own).withColumns({"k1": F.bit_xor("_x").over(so_far), "k2": F.bit_xor("_y").over(so_far)})
    return rows.select("conv_id", "depth", "bytes", "last", "k1", "k2", F.col("k1").bitwiseXOR(F.col("_x")).alias("p1"), F.col("k2").bitwiseXOR(F.col("_y")).alias("p2"))


def _shards(paths: DataFrame, least: int) -> DataFrame:
    """conv_id and the shard it lies in: neighbours in the order of paths. Written down, so that it is drawn once."""
    spark = paths.sparkSession
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-paths.count() // least))
    first = paths.where(F.col("depth") <= ORDER).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "k1"))).alias("_path"))
    dealt = first.repartitionByRange(number, "_path", "conv_id")
    return stored(dealt.select("conv_id", F.spark_partition_id().alias("shard")))


class SpillingQueue:
    """Messages in order of their addresses. Beyond `limit` they are written to scratch files as sorted runs."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.heads, self.files = limit, [], [], []

    def __len__(self) -> int:
        return len(self.heap) + len(self.heads)

    def put(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()
            self.heap.sort()
            for start in range(0, len(self.heap), 4096):
                pickle.dump(self.heap[start : start + 4096], run, pickle.HIGHEST_PROTOCOL)
            run.seek(0)
            self.heap = []
            self.files.append(run)
            self._read(iter(()), run)

    def _read(self, rest: Iterator[tuple], run) -> None:
        message = next(rest, None)
        if message is None:
            try:
                rest = iter(pickle.load(run))
            except EOFError:
                run.close()
                self.files.remove(run)
                return
            message = next(rest)
        heapq.heappush(self.heads, (message, id(run), rest, run))

    def take(self, address: tuple) -> Iterator[tuple]:
        """All messages to an address. Messages to smaller ones must have been taken."""
        size = len(address)
        while self.heap and self.heap[0][:size] == address:
            yield heapq.heappop(self.heap)
        while self.heads and self.heads[0][0][:size] == address:
            message, _, rest, run = heapq.heappop(self.heads)
            self._read(rest, run)
            yield message


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "weight", "level", "up", "group", "up_group", "k1", "k2"]
TOTALS = ["n_children", "n_leaves", "saved_tokens"]


def _forward(nodes: DataFrame, messages: DataFrame | None, limit: int) -> DataFrame:
    """One pass over the nodes of a level: their columns and totals. `messages` (conv_id, depth, group, totals) come from
    the levels below."""
    rows = nodes.withColumns({c: F.lit(0).cast("long") for c in TOTALS}).withColumn("_node", F.lit(1))
    if messages is not None:
        rows = rows.unionByName(messages.withColumn("_node", F.lit(0)), allowMissingColumns=True)
    ordered = rows.repartition("group").sortWithinPartitions("group", F.desc("depth"), "conv_id", "_node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, waiting = SpillingQueue(limit), (0, 0, 0)
        for batch in batches:
            kept, totals = [], []
            wanted = ("_node", "group", "depth", "conv_id", "parent_conv_id", "weight", "level", "up", *TOTALS)
            columns = [batch.column(c).to_pylist() for c in wanted]
            for i, (node, group, depth, conv, parent, weight, level, up, children, leaves, saved) in enumerate(zip(*columns, strict=True)):
                if not node:
                    waiting = (children, leaves, saved)
                    continue
                children, leaves, saved = waiting
                waiting = (0, 0, 0)
                for message in queue.take((group, -depth, conv)):
                    children, leaves, saved = children + message[3], leaves + message[4], saved + message[5]
                leaves, saved = leaves or 1, saved + weight
                if up == level:
                    queue.put((group, 1 - depth, parent, 1, leaves, saved))
                kept.append(i)
                totals.append((children, leaves, saved))
            own = batch.take(pa.array(kept, pa.int64()))
            sums = [pa.array([t[k] for t in totals], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in NODE), *sums], names=[*NODE, *TOTALS])
        assert not len(queue)

    return ordered.mapInArrow(work, extended(ordered.select(*NODE), ", ".join(f"{c} long" for c in TOTALS)))


def _ends(paths: DataFrame, piece: int) -> DataFrame:
    """k1, k2, depth and ends_sha256 of every node at which conversations end."""
    key = ["k1", "k2", "depth"]
    rows = paths.where("last").select(*key, "conv_id")
    rows = rows.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id")), strict=True))
            starts = [i for i in range(len(values)) if not i or values[i][:3] != values[i - 1][:3]]
            cuts = [k for a, b in zip(starts, [*starts[1:], len(values)], strict=True) for k in range(a, b, piece)]
            spans = list(zip(cuts, [*cuts[1:], len(values)], strict=True))
            texts = [",".join(str(v[3]) for v in values[a:b]) for a, b in spans]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(cuts, pa.int64())).columns, pa.array(texts, pa.string())], names=[*key, "conv_id", "ids"])

    pieces = rows.mapInArrow(joined, extended(rows, "ids string"))
    pieces = pieces.repartition(*key).sortWithinPartitions(*key, "conv_id")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        schema = None
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in key), pa.field("ends_sha256", pa.string())])
            out = []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if own != current:
                    if current is not None:
                        out.append((*current, digest.hexdigest()))
                    current, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*current, digest.hexdigest()), schema, strict=True)], schema=schema)

    return pieces.mapInArrow(digested, extended(pieces.select(*key), "ends_sha256 string"))


def trie(turns: DataFrame, shard: int = SHARD, queue: int = QUEUE, piece: int = PIECE) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. `turns` holds conv_id, depth, x, y, bytes and last, with a row of depth 0 per conversation."""
    paths = stored(_keyed(turns))
    shards = _shards(paths, shard)
    key = ["k1", "k2", "depth"]
    nodes = paths.join(shards, "conv_id").groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("shard").alias("_low"), F.max("shard").alias("_high"),
    )
    level = F.lit(6)
    for k in range(5, -1, -1):
        level = F.when(F.shiftright("_low", FAN * k) == F.shiftright("_high", FAN * k), k).otherwise(level)
    group = F.when(F.col("level") < 6, F.expr(f"shiftright(_low, cast(least(level, 5) * {FAN} as int))")).otherwise(0)
    nodes = stored(nodes.withColumn("level", level).withColumn("group", group))
    parents = nodes.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"),
        F.col("level").alias("up"), F.col("group").alias("up_group"),
    )
    weight = (F.col("n_convs") - 1) * F.col("bytes")
    placed = stored(nodes.join(parents, ["p1", "p2", "depth"], "left").withColumn("weight", weight).select(*NODE))
    discard(nodes, shards)
    levels = sorted(r[0] for r in placed.select("level").distinct().collect())  # seven at most
    done: list[DataFrame] = []
    for k in levels:
        messages = None
        for before in done:
            sent = before.where(F.col("up") == k).groupBy(
                F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("up_group").alias("group")
            ).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            messages = sent if messages is None else messages.unionByName(sent)
        if messages is not None:
            messages = messages.groupBy("conv_id", "depth", "group").agg(*[F.sum(c).alias(c) for c in TOTALS])
        done.append(stored(_forward(placed.where(F.col("level") == k), messages, queue)))
    result = done[0] if done else placed.withColumns({c: F.lit(0).cast("long") for c in TOTALS})
    for more in done[1:]:
        result = result.unionByName(more)
    result = result.join(_ends(paths, piece), key, "left")
    none = F.sha2(F.lit(""), 256)
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *TOTALS, F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def shared_heads(conversations: DataFrame, **sizes: int) -> DataFrame:
    """The trie of conversations rebuilt on the head of every fifth one: conversation c starts with the first
    crc32(c) mod 9 turns of conversation c - c mod 5."""
    turns = stored(hashed(conversations))
    source = F.col("conv_id") - F.col("conv_id") % 5
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    return trie(rebuilt(turns, source, head, 8), **sizes)
