import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*q)"


def names_in(folder):
    env = {**os.environ, "PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, "-c", LISTED], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split()


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    core = names_in(tmp_path)
    assert "hybrid_rrf_topk" in core and "pipeline" not in core and not any(n.startswith("op1_") for n in core)
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):  # it may outlive the folder whose operators it calls
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        assert names_in(tmp_path) == core
