import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def _importable(spark):
    from tallyspark.llm.staging import importable
    importable(spark)
