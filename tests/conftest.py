import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tagweave.session import get_spark, prepare
    session = get_spark("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                        spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()
