import pytest

from dokuma.session import make_session


@pytest.fixture(scope="session")
def spark():
    s = make_session("tests", cores="4", partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
