"""The driver's contract, read without a session."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_without_a_session():
    code = "import __spark_entry__ as e; from weft.plans import catalog; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and set(catalog.queries()) <= set(s)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
