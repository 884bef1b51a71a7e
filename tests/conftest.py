import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codesieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def src(spark):
    """Makes source files from (path, text) pairs."""
    def make(*pairs, repo="r"):
        return spark.createDataFrame([(repo, p, t) for p, t in pairs], "repo_id string, path string, content string")
    return make


@pytest.fixture(scope="session")
def finding(spark):
    """Makes findings from dicts; missing fields get plain values."""
    from codesieve import schemas

    base = dict(repo_id="r", id="F", severity="HIGH", category="SQL Injection", cwe="CWE-89", owasp="A03", file="api.py", line=1, code_snippet="x",
                description="", impact="", remediation="", references=[], cvss_score=None, confidence="HIGH", origin="t", ord=0)

    def make(*rows):
        full = [{**base, "ord": i, "id": f"F{i}", **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[c] for c in schemas.FINDING_COLUMNS) for r in full], schemas.FINDINGS)
    return make
