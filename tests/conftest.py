import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """Builds a files table from {repo: {path: content}}."""
    def build(repos):
        rows = [(repo, path, "file", len(content), content) for repo, tree in repos.items() for path, content in tree.items()]
        return spark.createDataFrame(rows, "repo string, path string, type string, size bigint, content string")
    return build
