"""The library without the training-data operators: the entry module still works."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for folder in ("quire/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    for pipeline_too in (False, True):
        if pipeline_too:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q), (len(q), set(o) - set(q)); assert not any(k.startswith('op') and k[2:3].isdigit() for k in q) and 'pipeline' not in q"
        environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=environment, timeout=120)
