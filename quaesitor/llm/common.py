"""What the operators share: table access, materialised steps, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs on one machine."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quaesitor-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that written() made and nothing reads any more."""
    spark = table.sparkSession
    for file in table.inputFiles():
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        break


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches that stay small with long texts in them; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


#: Ids of so many bytes are sent to every executor, BUCKET to a row, so that the rows that they are taken from stay where they are; with more both sides are shuffled.
BROADCAST_BYTES, BUCKET = 100_000_000, 64


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose id is not in `gone`, a written table of one column of distinct ids without nulls.

    Rows with a null id stay. Texts are not shuffled unless the ids are over
    BROADCAST_BYTES, whatever the session's threshold for broadcasts. Columns of
    any name pass through; an empty `gone` leaves all rows.
    """
    tag = uuid.uuid4().hex
    bucket, ids, one = f"bucket_{tag}", f"ids_{tag}", f"id_{tag}"
    gone = gone.toDF(one)
    width = F.octet_length(one) + 16 if gone.dtypes[0][1] in ("string", "binary") else F.lit(16)
    n, size = gone.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if size > BROADCAST_BYTES:
        return docs.join(gone, F.col(id_col) == F.col(one), "left_anti")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(n // BUCKET + 1))
    held = gone.groupBy(place(one).alias(bucket)).agg(F.collect_list(one).alias(ids))
    return docs.join(F.broadcast(held), (place(id_col) == F.col(bucket)) & F.array_contains(ids, F.col(id_col)), "left_anti")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that is the same for equal keys in any run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long): root is the smallest node reachable.

    Alternating large-star and small-star steps; each round is one table in the
    shared folder, and the loop ends when a round changes no edge. A star centre
    is reduced by a partial minimum and met again in a plain equi-join, which
    adaptive execution splits when it is skewed. No edges give no rows; loops
    (a = b) are kept as roots of themselves.
    """

    def toward_min(pairs: DataFrame, keep: Column) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.filter(keep).join(low, "u")

    def checksum(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def once(pairs: DataFrame) -> DataFrame:
        return written(pairs.filter("u <> v").distinct())

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e, last = once(e), None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        large = toward_min(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = toward_min(large, F.lit(True)).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        before, e = e, once(small)
        discard(before)
        now = checksum(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
