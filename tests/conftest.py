import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foldwise.session import local_session  # noqa: E402


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    """A session per module with a folder of its own: what a module leaves behind ends with it."""
    scratch = str(tmp_path_factory.mktemp("scratch"))
    session = local_session("tests", **{
        "spark.driver.memory": "6g", "spark.checkpoint.dir": scratch,
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.sql.shuffle.partitions": "4",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module")
def tables(spark):
    from foldwise.catalog.registry import table

    return lambda name: table(spark, "/root/testdata/sf0.001", name)
