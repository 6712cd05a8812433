"""The entry points with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROBE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_operators(tmp_path, pipeline):
    shutil.copytree(ROOT / "trustweave", tmp_path / "trustweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(ROOT / name, tmp_path)
    said = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    n, *others = said.stdout.split()
    assert int(n) > 100 and others == ["False", "False"]
