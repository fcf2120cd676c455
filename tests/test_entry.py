"""The entry point without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [False, True])
def test_core_stands_alone(tmp_path, pipeline):
    shutil.copytree(f"{ROOT}/tallyspark", tmp_path / "tallyspark",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    code = ("import __spark_entry__ as E; from tallyspark.plans import load_all; "
            "assert set(E.queries()) == set(load_all()); assert set(E.oracle_sql()) <= set(load_all())")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
