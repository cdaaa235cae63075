"""What the operators of this subpackage share: shared-folder tables, null-safe text, salted look-ups."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Salts that a look-up by a possibly hot key is dealt over.
SALTS = 16
#: A key with more than one in so many of the rows that are looked up is hot; so there are fewer hot keys than this.
HOT = 1000
#: Narrow rows of a file, about, and files of a table.
ROWS, LEAST = 500_000, 8
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (tests, local mode) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"corpuswright-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once.

    If df is known to have at most `rows` narrow rows, it is written as LEAST files, or one for ROWS rows if those are more:
    on some file systems each file costs several processes or requests.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST, -(-rows // ROWS)))
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuswright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_made_at"] = path
    return out


def remove(*tables: DataFrame | None) -> None:
    """Removes tables that `table` returned, when nothing reads them any more."""
    for path in [t.__dict__.get("_made_at") for t in tables if t is not None]:
        if path in _made:
            _delete(_made.pop(path), path)


def view(df: DataFrame, of: DataFrame) -> DataFrame:
    """df, known to `remove` as the table `of` that it is selected from."""
    df.__dict__["_made_at"] = of.__dict__.get("_made_at")
    return df


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have gone before
            return


def text_of(column: str) -> Column:
    """The column as string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def salted(key_rows: DataFrame, n: int = SALTS, name: str = "_salt") -> DataFrame:
    """Each row once for each salt: the small side of a salted look-up."""
    return key_rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def salt_of(*columns: Column, n: int = SALTS) -> Column:
    """The salt of a row on the large side."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def looked_up(rows: DataFrame, told: DataFrame, on: list[str], weight: str, spread: Column) -> DataFrame:
    """rows left-joined with told, a table with one row for each key `on`, whose column `weight` says how many rows have it.

    Hot keys, of which there are fewer than HOT by their weights, are broadcast, and their rows are spread by `spread` in
    the shuffled join with the others, of which none has more than one in HOT of the weight. Keys aren't null.
    """
    least = (told.agg(F.sum(weight)).first()[0] or 0) / HOT
    values = [c for c in told.columns if c not in on]
    hot = told.where(F.col(weight) > least).select(*on, F.struct(*values).alias("_hot"))
    cold = told.where(F.col(weight) <= least).select(*on, F.lit(0).cast("long").alias("_spread"), F.struct(*values).alias("_cold"))
    found = rows.join(F.broadcast(hot), on, "left")
    found = found.withColumn("_spread", F.when(F.col("_hot").isNotNull(), F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0)))
    found = found.join(cold, [*on, "_spread"], "left")
    return found.select(*rows.columns, *[F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in values])


def columns_of(df: DataFrame, wanted: list[str], who: str) -> DataFrame:
    """The wanted columns of df; a clear error if one is missing."""
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"{who} needs the columns {missing}")
    return df.select(*wanted)
