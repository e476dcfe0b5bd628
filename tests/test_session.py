"""The launcher's settings stay; a cluster must name a shared checkpoint folder."""
import pytest

from triptopics import session


class _Conf(dict):
    def contains(self, key):
        return key in self


def _built(monkeypatch, given, **kw):
    class Stop(Exception):
        pass

    seen = {}

    class Builder:
        def appName(self, name):
            return self

        def config(self, key=None, value=None, map=None):
            seen.update(map or {key: value})
            return self

        def master(self, value):
            seen["spark.master"] = value
            return self

        def getOrCreate(self):
            raise Stop

    monkeypatch.setattr(session, "SparkConf", lambda: _Conf(given))
    monkeypatch.setattr(session, "SparkSession", type("S", (), {"builder": Builder()}))
    with pytest.raises(Stop):
        session.get_spark(**kw)
    return seen


def test_cluster_settings_are_not_overridden(monkeypatch):
    seen = _built(monkeypatch, {"spark.master": "yarn", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m"})
    assert "spark.master" not in seen and "spark.sql.shuffle.partitions" not in seen and "spark.driver.memory" not in seen
    assert "spark.sql.adaptive.advisoryPartitionSizeInBytes" not in seen and seen["spark.sql.adaptive.enabled"] == "true"


def test_local_defaults(monkeypatch):
    seen = _built(monkeypatch, {})
    assert seen["spark.master"].startswith("local[") and "spark.sql.shuffle.partitions" in seen
    assert _built(monkeypatch, {}, master="local[2]", shuffle_partitions=3)["spark.sql.shuffle.partitions"] == "3"


def test_no_local_checkpoint_folder_on_a_cluster():
    class Context:
        master = "spark://host:1"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())
