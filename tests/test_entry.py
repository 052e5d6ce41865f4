"""The driver's contract, with the corpus subpackage and without it."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from fieldstream import plans

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("without", [("fieldstream/llm", "tests/llm"), ("fieldstream/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_subpackage(tmp_path, without):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.pyc"))
    for name in without:
        path = copy / name
        if path.exists():
            shutil.rmtree(path) if path.is_dir() else path.unlink()
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout
    assert json.loads(out.splitlines()[-1]) == [sorted(plans.QUERIES), sorted(plans.SQL)]
