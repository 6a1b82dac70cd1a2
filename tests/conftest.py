import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vectrail.session import build, ship

    folder = tmp_path_factory.mktemp("shared")
    s = build("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{folder}", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(folder / "warehouse"),
    })
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
