"""What the queries of this subpackage share: reading the tables, bounded Arrow batches, held-out rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch, which a Python worker holds as a whole; Spark bounds its bytes besides.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps the batches that go to Python workers small, whatever a row holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; -1 for a null id, which is in no part of a split."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def fresh(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores behind it as it takes to be none of ``columns``, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], copies: str, total: int, parts: int = 1_000) -> DataFrame:
    """Inner join with ``one``, which has a row for each key and in ``copies`` how many of ``total`` rows have it.

    Keys of more than one in ``parts`` rows, of which there are fewer than ``parts``, are dealt over several tasks: a
    broadcast list of them tells rows their number of shares, and their rows of ``one`` are repeated for each share.
    """
    salt, shares = fresh("salt", [*rows.columns, *one.columns]), fresh("shares", [*rows.columns, *one.columns])
    most = max(1, total // parts)
    hot = one.where(F.col(copies) > most).select(*keys, F.ceil(F.col(copies) / most).cast("int").alias(shares))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(F.col(shares), F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, place).drop(shares)
    each = F.explode(F.sequence(F.lit(0), F.when(F.col(copies) > most, F.ceil(F.col(copies) / most).cast("int") - 1).otherwise(0)))
    return dealt.join(one.withColumn(salt, each), [*keys, salt]).drop(salt)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for written tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of this machine where it is unset and the master is local, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        import tempfile

        shared = f"file://{tempfile.gettempdir()}/sylva-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared
