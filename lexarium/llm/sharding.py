"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group, and a group lies in one shard whole, unless it alone
exceeds what a shard should hold (its share of the bytes, tokens or rows is more
than one shard's): then it is dealt into the fewest parts that fit. A part, or a
group above 1/CELLS of any total, is placed by itself; smaller groups are
gathered by hash into CELLS cells, so what is placed doesn't grow with the table
(at most some CELLS vectors more). A placed vector is (bytes, tokens, rows) in
shares of the totals. Vectors go, largest first, to the shard where the dot
product of the vector with the residual capacity is highest.

The law that holds is `bytes`. Size: UTF-8 bytes plus 1; null texts count as
empty ones and group with them. Tokens: runs of characters that aren't white
space. Long texts are measured whole. Slots follow cells, and in a cell doc_id;
rows are told apart by their place in the written sizes, so repeated rows, null
ids and ties get slots of their own. No cell has more than about 1/CELLS of the
rows, however large a group is. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarium.llm._shared import settle, table

CELLS = 4096
#: Weight of bytes, tokens and rows: the law is on bytes.
WEIGHTS = (16.0, 1.0, 1.0)


def place(vectors: np.ndarray, n_shards: int, weights=WEIGHTS) -> np.ndarray:
    """The shard of each vector (rows: cells, in shares of the totals)."""
    w = np.asarray(weights)
    room = np.full((n_shards, vectors.shape[1]), 1.0 / n_shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -(vectors * w).sum(1))):
        s = int(np.argmax(room @ (w * vectors[i])))
        out[i] = s
        room[s] -= vectors[i]
    return out


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16, cells: int = CELLS) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law, shard, slot."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
        F.regexp_count(text, F.lit(r"\S+")).cast("bigint").alias("tokens"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = settle(rows, "sizes")
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")]
    total = rows.agg(*sums).first()
    if not total.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    share = F.greatest(F.col("b") / total.b, F.col("t") / max(total.t, 1), F.col("n") / total.n)
    hot = rows.groupBy("grp").agg(*sums).where(share > 1 / cells).select("grp", share.alias("share")).orderBy("grp").collect()  # 3 * cells groups at most
    first, known, item = cells, [], {}
    for i, (g, s) in enumerate(hot):
        pieces, parts = math.ceil(s * cells), math.ceil(s * n_shards)
        known.append((g, first, pieces))
        item |= {first + j: (i, j * parts // pieces) for j in range(pieces)}
        first += pieces
    hot_df = spark.createDataFrame(known, "grp bigint, first int, pieces int")
    piece = F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces"))
    rows = rows.join(F.broadcast(hot_df), "grp", "left").withColumn("cell", F.coalesce(piece, F.pmod("grp", F.lit(cells))).cast("int"))
    held = rows.groupBy("cell").agg(*sums).orderBy("cell").collect()  # cells, and 6 * cells pieces at most
    # pieces of one part are placed together
    index: dict = {}
    of = [index.setdefault(item.get(r.cell, r.cell), len(index)) for r in held]
    vectors = np.zeros((len(index), 3))
    np.add.at(vectors, of, np.array([[r.b / total.b, r.t / max(total.t, 1), r.n / total.n] for r in held]))
    to, before, placed = place(vectors, n_shards).tolist(), [0] * n_shards, []
    for r, i in zip(held, of):
        placed.append((r.cell, to[i], before[to[i]]))
        before[to[i]] += r.n
    placed_df = spark.createDataFrame(placed, "cell int, shard int, before bigint")
    order = Window.partitionBy("cell").orderBy("doc_id", "row")
    rows = rows.withColumn("place", F.row_number().over(order)).join(F.broadcast(placed_df), "cell")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in shards 0 to 15."""
    return shard(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))
