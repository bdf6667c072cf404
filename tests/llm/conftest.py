import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts (or (id, text) pairs); an extra column carries a name that operators use inside."""

    def make(texts, lang="en", source="s"):
        pairs = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        rows = [(i, t, lang, source, len(t) if t is not None else None, 1) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", id int")

    return make
