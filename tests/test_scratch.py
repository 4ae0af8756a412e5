"""Where intermediate tables go."""

import pytest
from pyspark.sql import functions as F

from harbor.sources import scratch
from harbor.sources.scratch import materialize, materialize_counted, scratch_path, written_bytes


class Settings:
    """A stand-in for a session of which only the settings are read."""

    def __init__(self, folder=None, **settings):
        self.conf = self.sparkContext = self
        self.folder = folder
        self.settings = {name.replace("_", "."): value for name, value in settings.items()}

    def get(self, name, default):
        return self.settings.get(name, default)

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_of_the_session():
    spark = Settings(spark_checkpoint_dir="hdfs://shared/tmp/", spark_master="yarn")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith("hdfs://shared/tmp/harbor/x-") and first != second
    assert scratch_path(Settings("hdfs://own", spark_master="yarn"), "x").startswith("hdfs://own/harbor/x-")


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]", "spark://host:7077"])
def test_cluster_without_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Settings(spark_master=master), "x")


@pytest.mark.parametrize("master", ["local", "local[2]", "local[*]"])
def test_single_machine_gets_a_folder_once(master):
    spark = Settings(spark_master=master)
    assert scratch_path(spark, "x").startswith(spark.folder) and scratch_path(spark, "y").startswith(spark.folder)


def test_written_table_keeps_rows_and_types(spark):
    df = spark.range(5).selectExpr("id", "cast(id as string) AS name", "if(id > 2, null, id / 2) AS half")
    table = materialize(df, "test")
    assert table.schema.simpleString() == df.schema.simpleString()
    assert sorted(table.collect()) == sorted(df.collect())
    assert materialize(df.filter("id < 0"), "test").count() == 0


def test_rows_are_counted_while_written(spark):
    table, rows = materialize_counted(spark.range(7).filter("id > 2"), "test")
    assert rows == table.count() == 4 and written_bytes(table) > 0
    assert materialize_counted(spark.range(7).filter("id > 9"), "test")[1] == 0
    assert materialize_counted(spark.range(7).filter(F.lit(False)), "test")[1] == 0
    assert materialize_counted(spark.createDataFrame([], "id long"), "test")[1] == 0


def test_release(spark, monkeypatch):
    monkeypatch.setattr(scratch, "FOLDER", "harbor-release-test")
    path = materialize(spark.range(3), "test").inputFiles()[0]
    assert "harbor-release-test" in path
    assert scratch.release(spark) and not scratch.release(spark)


def test_positions_are_written_again_after_a_release(spark):
    from harbor.sources import events

    folder = "/root/testdata/sf0.001"
    before = events.positions_table(spark, folder).count()
    scratch.release(spark)
    assert events.positions_table(spark, folder).count() == before > 0


def test_few_files(spark):
    table = spark.range(10_000).repartition(200, "id")
    assert len(materialize(table, "many").inputFiles()) == 200
    few = materialize(table, "few", few=True)
    assert len(few.inputFiles()) <= max(8, 2 * spark.sparkContext.defaultParallelism) and few.count() == 10_000
