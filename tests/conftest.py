import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import build_session

    folder = tmp_path_factory.mktemp("spark")
    session = build_session(
        "local[4]", "tests", 4, {"spark.driver.memory": "3g", "spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.checkpoint.dir": str(folder / "checkpoints")}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
