import pytest

from tests.harness import session


@pytest.fixture(scope="session")
def spark():
    spark = session("4", 4)
    yield spark
    spark.stop()
