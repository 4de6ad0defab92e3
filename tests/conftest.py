import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from duskwatch import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="duskwatch-tests-"),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tree(spark):
    """Files of one or several repositories: ``{path: text}`` or ``{repo: {path: text}}``."""
    from pyspark.sql import functions as F

    def build(files: dict):
        first = next(iter(files.values()), None)
        repos = files if isinstance(first, dict) else {"r": files}
        rows = [(repo, path, text) for repo, fs in repos.items() for path, text in fs.items()]
        df = spark.createDataFrame(rows, "repo string, path string, content string")
        return df.coalesce(1).withColumn("size", F.octet_length("content").cast("bigint"))

    return build


@pytest.fixture(scope="session")
def bundled(spark):
    from duskwatch import load_registry

    return load_registry(spark).entries


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
