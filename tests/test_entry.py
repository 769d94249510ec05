import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q); print('fine')"
    assert "fine" in subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout


def test_works_without_the_subpackage(tmp_path):
    import shutil

    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(REPO / name, tmp_path)
    shutil.copytree(REPO / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q and len(q) > 150; print('fine')"
    assert "fine" in subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
