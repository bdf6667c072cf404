import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lintlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture(scope="session")
def make_files(spark):
    """Files from a ``{path: content}`` mapping."""

    def make(contents: dict, project: str = "p"):
        rows = [(project, path, text, "", None if text is None else len(text)) for path, text in contents.items()]
        return spark.createDataFrame(rows, "project_id string, path string, content string, language string, size long")

    return make


ISSUE_SCHEMA = (
    "event_id long, issue_id string, project_id string, scan_id string, file_path string, line_start int, col_start int, "
    "line_end int, col_end int, title string, description string, category string, severity string, confidence int, "
    "impact int, code_snippet string"
)


@pytest.fixture(scope="session")
def make_issues(spark):
    """Issues from partial dictionaries."""

    def make(rows: list[dict]):
        full = []
        for n, row in enumerate(rows):
            base = {
                "event_id": n, "issue_id": f"rule-{n}", "project_id": "p", "scan_id": "s", "file_path": "src/a.ts",
                "line_start": 1, "col_start": 0, "line_end": row.get("line_start", 1), "col_end": 1, "title": "T",
                "description": "D", "category": "bug", "severity": "MAJOR", "confidence": 90, "impact": 50,
                "code_snippet": "x",
            }
            full.append(tuple({**base, **row}.values()))
        return spark.createDataFrame(full, ISSUE_SCHEMA)

    return make
