"""The library and its entry point stand without the training-data subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_without_llm(tmp_path):
    for name in ("flatewise", "__spark_entry__.py"):
        of = REPO / name
        shutil.copytree(of, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if of.is_dir() else shutil.copy(of, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr


def test_the_rest_passes_without_llm(tmp_path):
    """The other tests, in a copy without the subpackage, its tests and the pipeline."""
    for name in ("flatewise", "tests"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__", "test_standalone.py"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTEST_CURRENT_TEST")}
    done = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "-x", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, capture_output=True, text=True, env=env, timeout=1200)
    assert done.returncode == 0, done.stdout[-3000:]
    assert not list(tmp_path.rglob("llm")) and not (tmp_path / "corpus_pipeline.py").exists()


def test_nothing_imports_llm():
    for path in (REPO / "flatewise").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert ".llm" not in path.read_text(), path
