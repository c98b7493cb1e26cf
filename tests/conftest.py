import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from velado.session import get_spark

    os.environ.setdefault("VELADO_DRIVER_MEMORY", "4g")
    s = get_spark("local[2]", app="velado-tests", shuffle_partitions=4,
                  extra={"spark.velado.inputPartitions": "4"})
    # Tests set their own checkpoint folder only because none is configured locally.
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="velado-test-ckpt-"))
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
