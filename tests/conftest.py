import pytest

from peakloom.session import session


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
