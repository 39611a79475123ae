from __future__ import annotations

from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomtext.functions.let import let
from loomtext.functions.vector import cosine, l2_normalize
from loomtext.plans import shared


def test_tables_go_to_the_named_folder(spark):
    named = shared.shared_dir(spark)
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    back = shared.materialize(df, "probe")
    assert rows(back) == rows(df) and back.schema == df.schema
    files = [p for owner, p in shared._written if "/probe-" in p]
    assert files and all(p.startswith(named) for p in files)
    assert shared.materialize(df.limit(0), "probe").count() == 0
    shared.release(spark)
    assert not Path(files[0].removeprefix("file://")).exists() and not shared._written


def test_only_a_local_master_has_a_temporary_folder(spark):
    class Elsewhere:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return spark.sparkContext._jsc.sc()

    class Session:
        sparkContext = Elsewhere()
        conf = {}

    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        assert shared.shared_dir(Session()) == held.get().rstrip("/")

    class Unset(Elsewhere):
        class _jsc:
            @staticmethod
            def sc():
                return Unset

        class getCheckpointDir:
            @staticmethod
            def isDefined():
                return False

    Session.sparkContext = Unset()
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(Session())


def test_tables_are_released_after_a_block(spark):
    before = list(shared._written)
    with shared.tables_released(spark):
        shared.materialize(spark.range(3), "probe")
        (path,) = [p for _, p in shared._written[len(before):]]
        assert Path(path.removeprefix("file://")).exists()
        gone = shared.materialize(spark.range(2), "probe")
        shared.discard(gone, gone)
        assert len(shared._written) == len(before) + 1 and not Path(gone._written_at.removeprefix("file://")).exists()
    assert not Path(path.removeprefix("file://")).exists() and shared._written == before


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(10)
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(shared.small(df, 10)) and "broadcast" not in plan(shared.small(df, 9))


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert shared.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    assert shared.spread(spark.range(100).repartition(cores * 3)).rdd.getNumPartitions() == cores * 3


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(l2_normalize(F.col("a")), cosine(F.col("a"), F.col("b")), let(F.size("b"), lambda n: n * n)).collect()
    assert got[0][0] == [0.6, 0.8] and abs(got[0][1] - 0.96) < 1e-12 and got[0][2] == 4
    assert got[1][0] == [0.0, 0.0] and got[1][1] is None and got[2][0] is None
