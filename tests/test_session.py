import pytest

from wayfare.session import cluster_conf, ensure_checkpoint_dir


def test_cluster_conf_sizes_from_the_largest_shuffle():
    c = cluster_conf(15e12, 4000)
    assert int(c["spark.sql.shuffle.partitions"]) == 55_880
    assert int(cluster_conf(1e6, 4000)["spark.sql.shuffle.partitions"]) == 8000        # >= 2 x cores
    assert int(cluster_conf(1e15, 4000)["spark.sql.shuffle.partitions"]) == 3_725_291  # no cap: partitions never grow
    assert int(c["spark.sql.adaptive.autoBroadcastJoinThreshold"]) == 64 << 20


class _Ctx:
    def __init__(self, master, ckpt=None):
        self.master, self._ckpt = master, ckpt

    def getCheckpointDir(self):
        return self._ckpt

    def setCheckpointDir(self, d):
        self._ckpt = d


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, k, default=None):
        return self.values.get(k, default)


class _Spark:
    def __init__(self, master, conf):
        self.sparkContext, self.conf = _Ctx(master), _Conf(conf)


def test_no_machine_local_checkpoint_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Spark("yarn", {}))
    assert ensure_checkpoint_dir(_Spark("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})) == "hdfs:///shared/ckpt"
    assert ensure_checkpoint_dir(_Spark("local[2]", {})).startswith("/")
