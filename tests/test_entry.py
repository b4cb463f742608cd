import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; from lintel.plans import queries as p; assert set(e.queries()) == set(p.queries()), set(e.queries()) ^ set(p.queries()); assert set(e.oracle_sql()) == set(p.oracle_sql()); print(len(e.queries()))"


@pytest.mark.parametrize("gone", [("lintel/llm", "tests/llm"), ("lintel/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_text_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True, check=False)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) >= 46, done.stderr
