"""The entry module without the optional operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); assert q and q.keys() >= e.oracle_sql().keys(); assert 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"


def test_import_without_optional_folders(tmp_path):
    for kept in (True, False):  # with and without the pipeline that needs them
        copy = tmp_path / str(kept)
        shutil.copytree(f"{ROOT}/loomwork", copy / "loomwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if kept and os.path.exists(f"{ROOT}/corpus_pipeline.py") else [])):
            shutil.copy(f"{ROOT}/{name}", copy)
        subprocess.run([sys.executable, "-c", CODE], cwd=copy, check=True, timeout=120)
