"""What the operators of this package share: table access, working tables, raw files."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space and U+0009 to U+000D.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A folder of this application inside ``spark.checkpoint.dir``.

    A cluster names that shared folder; where it is unset (tests in one JVM) a
    temporary folder of the driver takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a working table and read it back: lineage ends here, and lost
    executors cost no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to all cores where they come in fewer partitions, as a small file does; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dropped(*tables: DataFrame) -> None:
    """Remove working tables that nothing reads any more, and let Spark drop the shuffle
    files of what has been written: they stay until the driver's JVM collects its garbage."""
    spark = tables[0].sparkSession
    for t in tables:
        remove_path(spark, t.staged_at)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a working table once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_raw_files(blobs: DataFrame, path: str, trailer: bytes) -> None:
    """Write each value of the binary column ``blob`` as one file, closed by ``trailer``.

    The text sink copies a string's bytes unchanged, so a binary column cast to string
    lands byte for byte; the sink's line separator is the trailer that ends each file.
    Spark's committer thus publishes raw files on any store that Spark reaches.
    """
    (
        blobs.select(F.col("blob").cast("string").alias("value"))
        .write.option("lineSep", trailer.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of each raw file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
