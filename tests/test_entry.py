"""The entry module without the optional subpackage, in a copy of the repository."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import __spark_entry__ as entry
from checks.compare import session
assert not any(name.startswith("op") or name == "pipeline" for name in entry.queries())
assert set(entry.oracle_sql()) <= set(entry.queries())
spark = session("local[2]")
assert entry.entry(spark).count() > 0
spark.stop()
"""


def run_copy(tmp_path, *left_out):
    copy = tmp_path / "copy"
    skipped = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *left_out)
    shutil.copytree(ROOT, copy, ignore=skipped)
    return subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, capture_output=True, text=True, timeout=600, check=False)


def test_entry_without_the_subpackage(tmp_path):
    """With the pipeline's file still there, and without it."""
    for name, left_out in (("both", ("llm", "corpus_pipeline.py")), ("folder", ("llm",))):
        done = run_copy(tmp_path / name, *left_out)
        assert done.returncode == 0, done.stderr[-2000:]
