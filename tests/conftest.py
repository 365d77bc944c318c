import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from drygrid.session import build_session

    session = build_session(
        "local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def daily(spark):
    """N1 cube: leading, inner and trailing NULL runs, an empty cell, a constant cell, a leap day."""
    import datetime as dt

    start = dt.date(2020, 2, 25)
    rows = []
    for i in range(10):
        day = start + dt.timedelta(days=i)
        rows.append((1, day, None if i in (0, 4, 5, 9) else float(i)))
        rows.append((2, day, None))
        rows.append((3, day, 5.0))
    return spark.createDataFrame(rows, "cell_id long, time date, value double")
