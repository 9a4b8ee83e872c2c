import os
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

#: Workers find the package wherever the tests are started from.
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    base = tempfile.mkdtemp(prefix="tidemark-tests-")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{base}/warehouse").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"{base}/checkpoint").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
