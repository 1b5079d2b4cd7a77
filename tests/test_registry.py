"""Queries can be listed without a session, with and without the numbered operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"


def listed(before=""):
    done = subprocess.run([sys.executable, "-c", before + LIST], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
    return int(done.stdout.split()[-1])


def test_names_need_no_session_and_no_numbered_operators():
    without = listed("import sys; sys.modules['factloom.llm'] = None; ")
    assert 100 < without <= listed()
