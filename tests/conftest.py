import pytest

from anamnesis.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
