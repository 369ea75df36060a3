import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_needs_no_session():
    """The driver imports the entry before it has a session."""
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["nation", "customer"]
