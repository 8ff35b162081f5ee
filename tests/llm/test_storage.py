import os
from types import SimpleNamespace

import pytest

from coppice.llm.storage import discard, shared_root, stored, working_tables


def test_no_local_folder_on_a_cluster():
    session = lambda master, root: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: root), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_root(session(master, None))
        assert shared_root(session(master, "s3://bucket/work/")) == "s3://bucket/work"
    assert shared_root(session("local[4]", None)).startswith("file://")


def test_working_tables_are_told_and_deleted(spark):
    with working_tables(spark) as outer:
        stored(spark.range(3), "one")
        with working_tables(spark) as inner:
            two = stored(spark.range(4), "two")
    stored(spark.range(5), "three")
    assert len(outer) == 2 and inner == outer[1:] and two.count() == 4
    assert all(os.path.isdir(p.removeprefix("file://")) for p in outer)
    discard(spark, outer)
    assert not any(os.path.exists(p.removeprefix("file://")) for p in outer)
