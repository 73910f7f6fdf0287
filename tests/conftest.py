import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from sentigrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """Builds a (doc_id, text) frame from a list of texts."""
    def build(rows):
        return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(2)

    return build


@pytest.fixture
def column(texts):
    """Values of an expression over `text`, in row order."""
    def run(rows, expression):
        out = texts(rows).select("doc_id", expression.alias("v")).collect()
        return [r.v for r in sorted(out, key=lambda r: r.doc_id)]

    return run
