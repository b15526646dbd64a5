"""What a piece of work writes on the way is removed with its end."""

import os

import pytest
from pyspark.sql import functions as F

from sylva.operators.ordering import mounted, positions, shared_folder
from sylva.operators.scratch import scratch


def files(folder):
    return [f for _, _, found in os.walk(mounted(folder)) for f in found]


def test_checkpoints_and_tables_go(spark):
    rows = spark.range(1_000).withColumn("k", F.col("id") % 3)
    kept = shared_folder(spark, "kept")
    with scratch(spark) as folder:
        table = shared_folder(spark, "table")
        assert table.startswith(f"{folder}/") and not kept.startswith(folder)
        rows.write.parquet(table)
        positions(rows, ["k"], ["id"]).write.parquet(kept)  # checkpoints on its way
        assert len(files(folder)) > len(files(table)) > 0
    assert not os.path.exists(mounted(folder))
    assert spark.read.parquet(kept).agg(F.max("pos")).first()[0] == 334
    # later work has a folder of its own again
    assert positions(rows, ["k"], ["id"]).count() == 1_000


def test_blocks_nest_and_errors_clean_up(spark):
    above = os.path.dirname(spark.sparkContext.getCheckpointDir())
    with pytest.raises(RuntimeError, match="no more"), scratch(spark) as outer:
        with scratch(spark) as inner:
            spark.range(3).write.parquet(shared_folder(spark, "rows"))
            assert inner.startswith(f"{outer}/") and files(inner)
        assert files(outer) == []
        spark.range(3).checkpoint()
        assert files(outer)
        raise RuntimeError("no more")
    assert not os.path.exists(mounted(outer))
    assert os.path.dirname(spark.sparkContext.getCheckpointDir()) == above
