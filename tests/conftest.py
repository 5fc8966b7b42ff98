import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import local_session

    folder = tmp_path_factory.mktemp("spark")
    session = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.checkpoint.dir": f"file://{folder}/shared"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
