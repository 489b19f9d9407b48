"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from textloom.plans.shared_dir import fresh_path, materialise, shared_dir


def session(configured, master, current=None):
    state = {"dir": current}
    sc = SimpleNamespace(
        master=master, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=d)
    )
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: configured or default)), state


def test_the_session_names_the_folder():
    spark, state = session("s3://shared/tmp", "yarn")
    assert shared_dir(spark) == "s3://shared/tmp" and state["dir"] == "s3://shared/tmp"
    assert fresh_path(spark, "x").startswith("s3://shared/tmp/x-")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_no_local_folder_on_a_cluster():
    spark, _ = session(None, "spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(spark)


def test_local_fallback(spark):
    df = materialise(spark.range(5), "five")
    assert df.count() == 5 and "five-" in df.inputFiles()[0]
