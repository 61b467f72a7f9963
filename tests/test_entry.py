"""The entry's optional parts and the folder for intermediate results."""

import builtins
import importlib
import sys

import pytest

from oddsloom import session
from oddsloom.plans.queries import QUERIES


def test_core_queries_stay_where_a_part_cannot_be_imported(monkeypatch):
    import __spark_entry__ as entry

    real = builtins.__import__

    def without(name, *rest, **more):
        if name.split(".")[0] in ("zstandard", "corpus_pipeline"):
            raise ModuleNotFoundError(name)
        return real(name, *rest, **more)

    for name in [m for m in sys.modules if m.startswith("oddsloom.llm") or m in ("zstandard", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    assert set(entry.queries()) == set(QUERIES)
    assert not [q for q in entry.oracle_sql() if q.startswith("op")]
    monkeypatch.undo()
    importlib.invalidate_caches()


class FakeContext:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, folder=None):
        self.sparkContext = FakeContext(master)
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(FakeSession("spark://host:7077"))
    assert session.shared_folder(FakeSession("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert session.shared_folder(FakeSession("local[2]"))
