"""Where intermediate tables go."""
from types import SimpleNamespace

import pytest

from veilspan.llm import common


def session(master, base=""):
    got = {}
    conf = SimpleNamespace(get=lambda k, d="": got.get(k, base or d), set=got.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(session("spark://host:7077"), "x")
    assert common.shared_folder(session("spark://host:7077", "hdfs://a/b"), "x").startswith("hdfs://a/b/x-")


def test_one_machine_may_use_its_own(monkeypatch):
    monkeypatch.setattr(common.tempfile, "mkdtemp", lambda prefix: "/tmp/own")
    alone = session("local[2]")
    assert common.shared_folder(alone, "x").startswith("/tmp/own/x-") and common.shared_folder(alone, "y").startswith("/tmp/own/y-")
