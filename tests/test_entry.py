"""The entry module imports without a session, and every name has a callable."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 61 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=REPO, check=True, timeout=120)
