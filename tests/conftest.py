import pytest

from quillmap.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
