"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A key lies on the ring at the top bits of its hash; it belongs to the first virtual node at or after it, clockwise.
A shard takes no more than its capacity: what lies beyond continues clockwise to the next virtual node whose shard has
room. Capacities are n // k, and one more for the first n % k shards, so counts differ by one at most (law ``rows``), and
only overflowing keys leave the shard that plain consistent hashing gives them.

The flow is decided on counts of ring cells (``CELLS``, a fixed number, so the collected table is bounded). Rows then need
only their rank within a cell: a cell holds 1/65536 of the keys whatever the shard sizes are, so no task sees a whole shard.
Data pass through DataFrame expressions only. A row's key is its doc_id and a hash of its text, so that rows which repeat an
id, or have none, are spread unless their texts are equal too.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 16
CELLS = 1 << CELL_BITS
VIRTUAL_NODES = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(last cell of its arc, shard) of each virtual node in clockwise order; the first comer of a cell keeps it."""
    owners: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(virtual_nodes):
            digest = hashlib.sha256(f"{shard}/{replica}".encode()).digest()
            owners.setdefault(int.from_bytes(digest[:8], "big") % CELLS, shard)
    return sorted(owners.items())


def flow(counts: dict[int, int], shards: int, capacity: list[int], virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int]]:
    """(cell, from_rank, to_rank, shard) segments that place every row of ``counts`` within the capacities."""
    nodes = ring(shards, virtual_nodes)
    room, arcs, k = list(capacity), [[] for _ in nodes], 0
    for cell in sorted(counts):
        while k < len(nodes) and nodes[k][0] < cell:
            k += 1
        arcs[k % len(nodes)].append((cell, 0, counts[cell]))
    placed, over = [], [[] for _ in nodes]
    for (_, shard), arc, rest in zip(nodes, arcs, over, strict=True):
        for cell, start, stop in arc:
            take = min(room[shard], stop - start)
            if take:
                placed.append((cell, start, start + take, shard))
                room[shard] -= take
            if start + take < stop:
                rest.append((cell, start + take, stop))
    carried: deque[tuple[int, int, int]] = deque()
    for lap in range(2):  # the second lap takes round what was carried past the end
        for (_, shard), rest in zip(nodes, over, strict=True):
            carried += rest if lap == 0 else []
            while carried and room[shard]:
                cell, start, stop = carried.popleft()
                take = min(room[shard], stop - start)
                placed.append((cell, start, start + take, shard))
                room[shard] -= take
                if start + take < stop:
                    carried.appendleft((cell, start + take, stop))
    return placed


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``docs`` with ``shard`` int and ``slot`` long, the row's gapless place in its shard (columns of these names are replaced).

    A null id is a key like any other, a null text counts as empty; rows equal in id and text are placed in any order. An empty
    table gives an empty one. ``docs`` must give the same rows each time it is read. Its columns may have any other names.
    """
    docs = docs.drop(*[c for c in ("shard", "slot") if c in docs.columns])
    key = F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))
    row = F.struct(*[F.col(c) for c in docs.columns])  # packed, so that no column meets one of the names below
    placed = docs.select(row.alias("row"), F.col(id_col).alias("id"), key.alias("key"), F.shiftrightunsigned(key, 64 - CELL_BITS).cast("int").alias("cell"))
    counts = {r[0]: r[1] for r in docs.select(F.shiftrightunsigned(key, 64 - CELL_BITS).cast("int").alias("c")).groupBy("c").count().collect()}
    segments, filled = [], [0] * shards
    for cell, start, stop, shard in sorted(flow(counts, shards, capacities(sum(counts.values()), shards), virtual_nodes)):
        segments.append([cell, start, stop, shard, filled[shard]])
        filled[shard] += stop - start
    packed = docs.sparkSession.range(1).select(F.from_json(F.lit(json.dumps(segments)), "array<array<bigint>>").alias("s")).select(F.explode("s").alias("s"))
    table = packed.select(F.col("s")[0].cast("int").alias("cell"), F.col("s")[1].alias("from"), F.col("s")[2].alias("to"), F.col("s")[3].cast("int").alias("shard"), F.col("s")[4].alias("first"))
    order = Window.partitionBy("cell").orderBy("key", "id")
    ranked = placed.withColumn("rank", F.row_number().over(order) - F.lit(1)).alias("r")
    joined = ranked.join(table.alias("t"), (F.col("r.cell") == F.col("t.cell")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    return joined.select("row", "shard", (F.col("first") + F.col("rank") - F.col("from")).cast("long").alias("slot")).select("row.*", "shard", "slot")


def shard_digest(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); size is the text's UTF-8 bytes plus 16, a null text has none.
    Nulls, repeated rows and empty tables are as in ``shard_rows``; long texts are read whole, once; other columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_rows(slim.withColumn("__text", F.col("text_crc32").cast("string")), shards, "doc_id", "__text")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
