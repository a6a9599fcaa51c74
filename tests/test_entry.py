"""The driver contract holds without a session, and each oracle belongs to a query."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_import_without_a_session():
    code = "import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout) > 130


def test_nothing_else_imports_the_optional_package():
    for folder, _, names in os.walk(os.path.join(ROOT, "tessera")):
        if "llm" in folder.split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "tessera.llm" not in f.read(), n
