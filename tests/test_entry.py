"""The entry works with and without the separable part."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_operators(tmp_path, pipeline):
    from roadweave.plans import all_queries

    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline and os.path.exists(f"{TOP}/corpus_pipeline.py"))):
        shutil.copy(f"{TOP}/{name}", tmp_path / name)
    shutil.copytree(f"{TOP}/roadweave", tmp_path / "roadweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-2000:]
    assert said.stdout.split() == sorted(all_queries())
