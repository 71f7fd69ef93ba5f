import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ludex.session import get_spark
    d = tempfile.mkdtemp(prefix="ludex-test-")
    s = get_spark("local[4]", app="ludex-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": os.path.join(d, "ckpt")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tmpdir_session():
    return tempfile.mkdtemp(prefix="ludex-test-data-")
