import types

import pytest

from jsonloom import session


def fake(master, folder=None):
    conf = types.SimpleNamespace(get=lambda k, d=None: folder)
    return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(fake(master))


def test_intermediate_tables_are_removed(spark):
    df = session.written(spark.range(3), "three")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 3 and session.exists(spark, path)
    assert session.clean(spark) >= 1 and not session.exists(spark, path)
