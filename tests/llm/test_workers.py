"""Queries with Python workers run where the workers find no copy of the package."""

import os
import subprocess
import sys

import pytest

TABLES, ROOT = "/root/testdata/sf0.001", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, {root!r})
import corpus_pipeline
from emberscope.llm import queries
from emberscope.plans import queries as plain
from emberscope.session import session
spark = session("away", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")
for name in ("op4_secret_scan", "op5_url_filter", "op6_jaccard_join", "op7_token_count", "op8_language_id", "op10_topk"):
    print(name, queries.QUERIES[name](spark, {tables!r}).count())
print("pipeline", corpus_pipeline.run(spark, {tables!r}).count())
print("episodes", plain.QUERIES["episodes"](spark, {tables!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, tables=TABLES)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[0] for line in done.stdout.split("\n") if line and int(line.split()[1]) > 0][-2:] == ["pipeline", "episodes"]
