"""The entry's queries can be listed before there is a session."""

import os
import subprocess
import sys


def test_the_entry_needs_no_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 0)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.strip() == "True"
