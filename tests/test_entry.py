"""The entry point where the optional parts are gone."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("holdfast/llm",), ("holdfast/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_other_queries_are_there_without_the_optional_parts(tmp_path, gone):
    shutil.copytree(ROOT / "holdfast", tmp_path / "holdfast", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(sum(n[0] != 'o' and n != 'pipeline' for n in q), sum(n[:2] == 'op' for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and out[2] == "False" and (int(out[1]) == 0 or "holdfast/llm" not in gone)
