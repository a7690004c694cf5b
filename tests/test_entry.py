"""The entry module without the optional parts, and with broken ones."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("broken", [False, True])
def test_core_queries_stay(tmp_path, broken):
    shutil.copytree(f"{ROOT}/tallyframe", tmp_path / "tallyframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if broken:
        (tmp_path / "tallyframe" / "llm").mkdir()
        (tmp_path / "tallyframe" / "llm" / "registry.py").write_text("import no_such_module\n")
    code = "import re, __spark_entry__ as e; q = e.queries(); assert 'rank_models' in q and not any(re.match('op[0-9]+_', x) or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr
    assert ("no_such_module" in done.stderr) == broken
