import pytest

from poolscope.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "local[8]",
        "tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
