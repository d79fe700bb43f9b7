import pytest

from scenograph.session import build


@pytest.fixture(scope="session")
def spark():
    s = build("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
