"""Sharding (7) by extendible hashing: a directory of hash prefixes whose oversized buckets split bit by bit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Leading bits from the id's hash, then bits from the row's own number, so that repeated ids can be parted too.
ID_BITS, ROW_BITS = 40, 20
BITS = ID_BITS + ROW_BITS
#: A pass looks this many bits beyond the depth at which even buckets would fit.
SLACK = 6


def extendible_shards(docs: DataFrame, byte_limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, n_bytes, depth, prefix, shard, shard_bytes).

    A bucket is a hash prefix of `depth` bits; the first prefix of a row whose
    bucket holds at most `byte_limit` bytes of UTF-8 text, or that row alone, is
    its shard. So only oversized buckets split, and a text over the limit ends
    in a shard of its own. Rows of a bucket that is too large with all bits are
    packed into numbered parts of it: a text over half of the limit is a part,
    the others are cut by their running sum. The bits come from md5 of the id (null: empty text),
    then from the row's number, which parts repeated ids. Null texts have no
    bytes. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    by_id = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, ID_BITS // 4), 16, 10).cast("long")
    by_row = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - ROW_BITS)
    rows = written(rows.withColumn("h", F.shiftleft(by_id, ROW_BITS).bitwiseOR(by_row)))

    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    deepest = min(BITS, math.ceil(math.log2(max(1, total / byte_limit))) + SLACK)
    placed, todo, above = None, rows, -1
    while True:
        fine = F.shiftrightunsigned("h", BITS - deepest)
        cells = written(todo.groupBy(fine.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
        at = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(above + 1), F.lit(deepest))).alias("depth"))
        at = at.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {deepest} - depth)"))
        fits = at.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n")).filter((F.col("shard_bytes") <= byte_limit) | (F.col("n") == 1)).drop("n")
        first = at.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes"), "depth").alias("at"))
        first = written(first.select("cell", "at.*"))
        here = todo.withColumn("cell", fine)
        now = here.join(first, "cell").select("doc_id", "n_bytes", "depth", "prefix", "shard_bytes")
        now = now.withColumn("part", F.lit(None).cast("string"))
        placed = now if placed is None else placed.union(now)
        if deepest == BITS:
            placed = placed.union(_packed(here.join(first, "cell", "left_anti"), byte_limit))
            break
        if first.count() == cells.count():
            break
        todo = written(here.join(first, "cell", "left_anti").drop("cell"))
        above, deepest = deepest, min(BITS, deepest + SLACK)
    return placed.withColumn("shard", F.expr("concat(depth, ':', CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END, coalesce(concat(':', part), ''))")).select("doc_id", "n_bytes", "depth", "prefix", "shard", "shard_bytes")


def _packed(rows: DataFrame, byte_limit: int) -> DataFrame:
    """Parts of full buckets: rows over half of the limit alone, the others by which half limit of their sum they begin in."""
    order = Window.partitionBy("h").orderBy("doc_id", "n_bytes")
    big = 2 * F.col("n_bytes") > byte_limit
    rows = rows.withColumn("part", F.row_number().over(order)).withColumn("_sum", F.sum(F.when(big, 0).otherwise(F.col("n_bytes"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(big, F.concat(F.lit("r"), "part")).otherwise(F.concat(F.lit("p"), F.floor(2 * (F.col("_sum") - F.col("n_bytes")) / byte_limit).cast("string")))
    rows = rows.withColumn("part", part).withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("h", "part")))
    return rows.select("doc_id", "n_bytes", F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), "shard_bytes", "part")


def oracle(byte_limit: int) -> str:
    """The same in DuckDB's SQL, for ids that do not repeat."""
    return f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {ID_BITS // 4}) AS BIGINT) AS h FROM documents),
lv AS (SELECT doc_id, n_bytes, CAST(k AS INTEGER) AS depth, h >> CAST({ID_BITS} - k AS INTEGER) AS prefix FROM d, generate_series(0, {ID_BITS}) AS g(k)),
fits AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM lv GROUP BY depth, prefix HAVING sum(n_bytes) <= {byte_limit} OR count(*) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS r FROM lv JOIN fits USING (depth, prefix))
SELECT doc_id, n_bytes, depth, prefix, depth || ':' || CASE WHEN depth = 0 THEN '' ELSE right(format('{{:064b}}', prefix), depth) END AS shard, shard_bytes FROM best WHERE r = 1"""
