import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millwright.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.chdir(tmp_path_factory.mktemp("cwd"))
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def csv_file(tmp_path):
    """Write a small CSV source: ``csv_file(name, text)`` -> path."""

    def write(name: str, text: str) -> str:
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


def tuples(df, *columns):
    """Rows as a sorted list of tuples (NULL first)."""
    rows = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(rows, key=lambda row: tuple((v is not None, v) for v in row))


def parts_frame(spark, rows):
    return spark.createDataFrame(rows, "part_id BIGINT, response TINYINT")


def visits_frame(spark, rows):
    """Rows are ``(part, station)`` or ``(part, station, first, last)``."""
    full = [r if len(r) == 4 else (*r, 1.0, 2.0) for r in rows]
    schema = "part_id BIGINT, station STRING, first_observed_time DOUBLE, last_observed_time DOUBLE"
    return spark.createDataFrame(full, schema)
