"""The driver's contract, with the subpackage llm and without it."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


def copy_without_llm(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    return at, os.environ | {"PYTHONPATH": os.pathsep.join([str(at), *filter(None, [os.environ.get("PYTHONPATH")])])}


def test_without_llm(tmp_path):
    """The rest imports, and its tests of queries pass."""
    at, env = copy_without_llm(tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'profile_numeric' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_catalog.py", "-q", "-x"], cwd=at, check=True, env=env)


def test_a_missing_library_takes_only_llm_away():
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'profile_numeric' in q and 'op3_simhash' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_shared_folder(spark, monkeypatch):
    """A cluster must name it; what a local session makes for itself is no other's."""
    from millrace import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    at = session.shared_dir(spark)
    spark.range(3).write.parquet(f"{at}/gone")
    assert session.remove(spark, f"{at}/gone") and not session.remove(spark, f"{at}/gone")
