from types import SimpleNamespace

import pytest

from pawledger.session import CHECKPOINT_DIR, ensure_checkpoint_dir, materialize


class FakeContext:
    def __init__(self, master, conf=None, current=None):
        self.master, self.current = master, current
        self.conf = conf or {}

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path

    def getConf(self):
        return self.conf


def fake(master, conf=None, current=None):
    context = FakeContext(master, conf, current)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))


def test_shared_folder_is_used():
    session = fake("spark://host", {CHECKPOINT_DIR: "/shared"})
    ensure_checkpoint_dir(session)
    assert session.sparkContext.current == "/shared"


def test_a_folder_already_set_stays():
    session = fake("spark://host", {CHECKPOINT_DIR: "/other"}, "/set")
    ensure_checkpoint_dir(session)
    assert session.sparkContext.current == "/set"


@pytest.mark.parametrize("master", ["spark://host", "local[4]"])
def test_no_folder_of_its_own(master):
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(fake(master))


def test_materialize_keeps_rows(spark):
    assert materialize(spark.range(7)).count() == 7
