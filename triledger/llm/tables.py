"""Intermediate tables in the folder that the cluster shares, and a hash bitmap for pruning scans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from triledger.operators.durable import shared_folder


def plain_reads(spark: SparkSession) -> None:
    """Settings of the session that keep memory outside the heap small, from now on.

    Parquet is read in plain calls: vectored reads keep a buffer for each thread, as large as a column of a row group.  Python
    workers get batches of a bounded size, of which each worker and the buffers beside it hold several at a time.
    """
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def packed(docs: DataFrame) -> Column:
    """All columns of the documents as one, so that no name of theirs can clash; `select("_doc.*")` unpacks them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def saved(df: DataFrame, **observed: Column) -> DataFrame:
    """The same rows, read back from a Parquet table in the checkpoint folder.

    `facts` of the result holds the row count and the observed aggregates, counted while writing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in observed.items()]).write.parquet(path)
    plain_reads(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder, table.facts = path, seen.get
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables made by `saved` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """Shuffle partitions for so many rows: the session's number, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def bitmap(keys: DataFrame, key: str, bits: int) -> Column:
    """A scalar array of longs with the bit of every key's hash set; its size is bits / 8 bytes, whatever the input."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {bits}) & 63 as int))").alias("b"))
    zeros = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    whole = words.unionByName(zeros).groupBy("w").agg(F.bit_or("b").alias("b"))
    # bits / 64 rows, a constant.
    dense = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))
    return dense.scalar()


def may_contain(words: Column, key: str, bits: int) -> Column:
    """False only for keys that are not in the bitmap."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    word = F.get(words, F.shiftright(place, 6).cast("int"))
    return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1
