import pytest

from tests.session import build


@pytest.fixture(scope="session")
def spark():
    session = build()
    yield session
    session.stop()
