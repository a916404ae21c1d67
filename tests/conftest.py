import pytest

from parcelytics.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
