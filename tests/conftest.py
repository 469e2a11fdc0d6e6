import pytest

from virosieve.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8, "6g")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def tables(spark):
    from virosieve.workload import binding

    return binding.tables(spark, SF)
