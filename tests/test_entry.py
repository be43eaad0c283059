import subprocess
import sys

from .conftest import ROOT


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_the_training_data_subpackage(tmp_path):
    """A copy of the repository without the folders that may go."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    out = subprocess.run(
        [sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k.startswith('op') or k == 'pipeline'])"],
        cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)},
    )
    assert out.returncode == 0, out.stderr
    assert out.stdout.split(" ", 1)[1].strip() == "[]" and int(out.stdout.split()[0]) > 50
