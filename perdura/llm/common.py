"""Helpers shared by the operators: tables, words, checkpoints, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; bytes.split() cuts UTF-8 in the same way.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000
#: A key of a join is hot from so many rows, and from such a part of all rows, but at the latest from TASK_ROWS rows
#: as long as no more than MOST_HOT keys can be hot.
HOT_ROWS, HOT_SHARE, TASK_ROWS, MOST_HOT = 500, 256, 2_000_000, 100_000


def hot_limit(total: int) -> int:
    """Rows of one key that go to one task, of a join of so many rows: a task's rows do not grow with the table up to 2e11 rows,
    and what is broadcast, a row for each hot key, is bounded for any table."""
    return max(HOT_ROWS, min(total // HOT_SHARE, max(TASK_ROWS, total // MOST_HOT)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only where none is set and all runs in one process (tests) a temporary one is made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="perdura-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the shared checkpoint folder."""
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


SALT = ["_salt", "_parts"]


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with table, both stored; table has k, the number of rows of its key.

    A hot key, with more rows than hot_limit, is dealt to several tasks: its rows by hash, its
    rows of the table copied to each. Hot keys, without any payload, are broadcast.
    """
    limit = hot_limit(table.agg(F.sum("k")).first()[0] or 0)
    parts = F.ceil(F.col("k") / limit).cast("int")
    hot = table.filter(F.col("k") > limit).select(*keys, parts.alias("_parts")).distinct()
    if hot.isEmpty():
        return rows.join(table, keys)
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1))).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return salted.join(copies, [*keys, "_salt"]).drop(*SALT)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts hold at most BATCH_ROWS rows, which bounds a Python worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_rows(df: DataFrame, schema: str, batch: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """mapInArrow for a function that turns one batch into a dict of columns (lists or arrays)."""
    target = to_arrow(df.sparkSession, schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield record_batch(batch(b), target)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        x = columns[f.name]
        arrays.append(x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type))
    return pa.record_batch(arrays, schema=schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column with null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m)).cast("int")
