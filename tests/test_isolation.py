"""The library without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_corpus_operators(tmp_path, pipeline):
    copy = tmp_path / "repo"
    copy.mkdir()
    shutil.copytree(ROOT / "meterline", copy / "meterline", ignore=lambda d, names: ["llm"] if Path(d).name == "meterline" else [])
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", copy)
        (copy / "meterline" / "llm" / "__pycache__").mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0, out.stderr
    n, n_sql, corpus = out.stdout.split()
    assert int(n) > 190 and int(n_sql) > 150 and corpus == "False"


def test_the_other_tests_without_the_corpus_operators(tmp_path):
    """They can be collected, and those that need no Spark pass."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT / "meterline", copy / "meterline", ignore=lambda d, names: ["llm"] if Path(d).name == "meterline" else [])
    shutil.copytree(ROOT / "tests", copy / "tests", ignore=lambda d, names: ["llm", "__pycache__"])
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-p", "no:cacheprovider", *args], cwd=copy, capture_output=True, text=True, timeout=300)
    collected = run("--collect-only")
    assert collected.returncode == 0 and "llm" not in collected.stdout, collected.stdout[-2000:]
    passed = run("-k", "pattern_alone or secret_shape or windows_cover or splitting")
    assert passed.returncode == 0 and " passed" in passed.stdout, passed.stdout[-2000:]
