"""The entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import checks

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder) -> set[str]:
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True)
    return set(done.stdout.split())


@pytest.mark.parametrize("gone", [("fleetboard/llm", "tests/llm"), ("fleetboard/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    for name in ("fleetboard", "checks", "tests"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    assert names(tmp_path) == set(checks.queries())


def test_entry_as_it_is():
    assert set(checks.queries()) <= names(ROOT)
