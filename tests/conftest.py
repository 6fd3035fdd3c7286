import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fieldpulse.session import build_session

    s = build_session("local[4]", app_name="fieldpulse-tests", shuffle_partitions=4)
    # Tests name their own shared folder only when the environment names none.
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def ws(spark):
    from fieldpulse.sources.adapter import Workspace

    return Workspace.shared(spark, SF_SMALL)


@pytest.fixture()
def scratch(spark):
    """A fresh folder under the shared checkpoint location."""
    from fieldpulse.session import shared_dir

    return shared_dir(spark, "tests")
