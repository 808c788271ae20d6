from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from listweave import storage


def fake(master, found=None, app="a"):
    context = SimpleNamespace(master=master, applicationId=app, getConf=lambda: SimpleNamespace(get=lambda key: None))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: found if key == storage.KEY else default), sparkContext=context)


def test_the_shared_folder_is_the_sessions():
    assert storage.shared_dir(fake("spark://x", "hdfs://x/cp/")) == "hdfs://x/cp"
    assert storage.shared_dir(fake("local[2]", "file:///cp")) == "file:///cp"
    assert storage.shared_dir(fake("local")) == storage.shared_dir(fake("local[*]"))
    assert storage.shared_dir(fake("local", app="b")) != storage.shared_dir(fake("local"))


@pytest.mark.parametrize("master", ["spark://x", "yarn", "local-cluster[3,2,1000]"])
def test_no_machine_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError, match=storage.KEY):
        storage.shared_dir(fake(master))


def test_round_trip_and_clear(spark):
    df = spark.range(10).select("id", F.when(F.col("id") > 5, "x").alias("odd name"), F.array("id").alias("a"))
    kept = storage.materialize(df, "t")
    assert kept.dtypes == df.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert "RDD" not in kept._jdf.queryExecution().logical().toString()
    storage.clear(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(storage.own_folder(spark))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
