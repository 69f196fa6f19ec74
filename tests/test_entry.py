import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [["rolesift/llm"], ["rolesift/llm", "corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    """The entry imports and lists the library's own queries where the optional folder is not there."""
    skipped = shutil.ignore_patterns(".git", "__pycache__", *[g.split("/")[-1] for g in gone])
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert "site_run" in done.stdout and "op1_" not in done.stdout and "pipeline" not in done.stdout
