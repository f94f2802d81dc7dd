import pytest

from scoutline.session import local_session


@pytest.fixture(scope="session")
def spark():
    spark = local_session(4, "tests")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    spark.stop()
