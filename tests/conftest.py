from __future__ import annotations

import os

import pytest

os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark():
    from quarryline.session import build_session

    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
