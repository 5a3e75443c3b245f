from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tablecensus import session


def fake(master, configured=None, current=None):
    """A stand-in for a session that records the checkpoint folder it is given."""
    state = {"dir": current}
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: state["dir"],
        setCheckpointDir=lambda path: state.update(dir=path),
    )
    conf = SimpleNamespace(get=lambda key, default=None: configured or default)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_configured_folder_is_used():
    spark = fake("spark://host:7077", configured="hdfs:///shared/")
    assert session.shared_folder(spark) == "hdfs:///shared/"
    assert spark.sparkContext.getCheckpointDir() == "hdfs:///shared/"
    one, two = (session.new_folder(spark, "leaves") for _ in range(2))
    assert one.startswith("hdfs:///shared/leaves-") and one != two


def test_cluster_without_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("yarn"))


def test_own_folder_only_in_local_sessions():
    spark = fake("local[8]")
    assert session.shared_folder(spark) == spark.sparkContext.getCheckpointDir()
    assert session.shared_folder(fake("yarn", current="hdfs:///set")) == "hdfs:///set"


def test_checkpoint_measures(spark):
    df = spark.createDataFrame([("ab", 1), ("é", 5), (None, 3)], "x string, y int")
    stored = session.checkpoint(df, ["x"], largest=F.max("y"))
    assert (stored.rows, stored.key_bytes, stored.measured["largest"]) == (3, 4, 5)
    assert sorted(stored.df.collect(), key=repr) == sorted(df.collect(), key=repr)
    empty = session.checkpoint(df.limit(0), ["x"], largest=F.max("y"))
    assert (empty.rows, empty.key_bytes, empty.measured["largest"]) == (0, 0, None)
