import pytest
from pyspark.sql import SparkSession

from cedarlog.session import build_session


def make_session() -> SparkSession:
    spark = build_session(
        "cedarlog-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.files.openCostInBytes": "131072",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
