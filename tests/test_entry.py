"""The driver's contract: names agree, and everything works without the corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 100


def test_flagship(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 8


def test_entry_without_the_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "paravane", tmp_path / "paravane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 90 and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
