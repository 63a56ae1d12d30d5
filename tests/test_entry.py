import os
import subprocess
import sys


def test_entry_imports_without_a_session():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'discovery_rates' in q"
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True)
