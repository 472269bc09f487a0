import pytest

from sievework.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", spark_driver_memory="4g")
