import pytest

from tidewire.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", memory="6g")
    yield session
    session.stop()
