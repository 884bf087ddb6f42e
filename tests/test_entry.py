"""The driver contract from a foreign working directory with a plain session."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(REPO, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
df = E.entry(spark)
n = df.count()
q = E.queries()["page_links"](spark, "/root/testdata/sf0.001").count()
print("RESULT", n, q, len(E.queries()), len(E.oracle_sql()))
"""


def test_entry_from_foreign_cwd():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.mkdtemp(prefix="jobsift-cwd-"), env=env,
                         capture_output=True, text=True, timeout=900)
    line = [l for l in out.stdout.splitlines() if l.startswith("RESULT")]
    assert line, out.stderr[-3000:]
    _, n, q, nq, no = line[0].split()
    assert int(n) > 0 and int(q) > 0 and int(nq) >= 60 and int(no) >= 60
