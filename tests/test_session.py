"""Session helpers that scale decisions depend on."""

import pytest

from stancelab.session import broadcast_limit, checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Ctx:
    def __init__(self, master):
        self.master = master

    def getConf(self):
        return _Conf({})

    dir = None

    def setCheckpointDir(self, path):
        self.dir = path

    def getCheckpointDir(self):
        return self.dir


class _Session:
    def __init__(self, conf=None, master="local[2]"):
        self.conf = _Conf(conf or {})
        self.sparkContext = _Ctx(master)


@pytest.mark.parametrize("raw,want", [("10485760b", 10485760), ("10m", 10 << 20), ("1g", 1 << 30),
                                      ("512k", 512 << 10), ("-1", -1), ("junk", 10 << 20)])
def test_broadcast_limit_parsing(raw, want):
    assert broadcast_limit(_Session({"spark.sql.autoBroadcastJoinThreshold": raw})) == want


def test_checkpoint_dir_prefers_session_setting():
    s = _Session({"spark.checkpoint.dir": "hdfs://shared/ckpt"}, master="yarn")
    assert checkpoint_dir(s) == "hdfs://shared/ckpt" and s.sparkContext.dir == "hdfs://shared/ckpt"


def test_checkpoint_dir_refuses_local_folder_on_cluster():
    with pytest.raises(ValueError):
        checkpoint_dir(_Session(master="spark://cluster:7077"))


def test_checkpoint_dir_local_fallback_is_stable():
    s = _Session()
    first = checkpoint_dir(s)
    assert first == checkpoint_dir(s) and s.sparkContext.dir == first


def test_checkpoint_dir_honours_one_already_set():
    s = _Session(master="yarn")
    s.sparkContext.setCheckpointDir("hdfs://other/ckpt")
    assert checkpoint_dir(s) == "hdfs://other/ckpt"
