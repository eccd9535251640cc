import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from branchwise.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="branchwise-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def tmp_root(spark):
    return tempfile.mkdtemp(prefix="branchwise-test-")
