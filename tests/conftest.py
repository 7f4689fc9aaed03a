import pytest

from masterloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", partitions=4, memory="6g")
