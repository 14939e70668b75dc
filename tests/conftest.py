import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(REPO))


@pytest.fixture(scope="session")
def spark():
    from lumbung.session import get_spark

    s = get_spark("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    s.sparkContext.environment["PYTHONPATH"] = str(REPO)
    yield s
    s.stop()
