import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_match(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the shared tables are not here")
def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["source", "matching_lines", "files"] and rows.count() > 0


def test_the_rest_stands_without_the_training_subpackage(tmp_path):
    for name in ("corvane", "__spark_entry__.py"):
        at = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / name)
    shutil.rmtree(tmp_path / "corvane" / "llm", ignore_errors=True)
    script = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
