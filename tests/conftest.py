import pytest

from sievery.session import session, ship_code


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship_code(s)
    yield s
    s.stop()
