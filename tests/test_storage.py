from types import SimpleNamespace

import pytest

from tidewater.storage import Scratch, shared_dir


def session(master, folder=None, context_folder=None):
    settings = {"spark.sql.warehouse.dir": "/warehouse/"} | ({"spark.checkpoint.dir": folder} if folder else {})
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d)), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: context_folder))


def test_shared_folder():
    assert shared_dir(session("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert shared_dir(session("yarn", None, "hdfs:///of-context")) == "hdfs:///of-context"
    assert shared_dir(session("local[8]")) == "/warehouse/_tidewater"
    with pytest.raises(ValueError, match="checkpoint"):  # no folder of the driver's own on a cluster
        shared_dir(session("yarn"))


def test_scratch(spark):
    scratch = Scratch(spark, "test")
    kept = scratch.keep(spark.range(5), "five")
    assert kept.count() == 5 and "Scan parquet" in kept._jdf.queryExecution().executedPlan().toString()
    scratch.drop("five", "never written")
    with pytest.raises(Exception):
        kept.count()
