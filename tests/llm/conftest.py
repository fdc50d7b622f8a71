import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return corpus.docs(spark)


@pytest.fixture(scope="session")
def no_docs(spark):
    return corpus.none(spark)
