import pytest

from chronoweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
