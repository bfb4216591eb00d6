import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillstone.session import session

    spark = session(master="local[4]", app="tests", shuffle_partitions=4, driver_memory="3g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield spark
    spark.stop()
