import pytest

from contactloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", partitions=2)
    yield session
    session.stop()
