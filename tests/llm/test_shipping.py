"""Queries whose functions run in workers that cannot import this package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as contract
from cashtide.session import local_session

spark = local_session("4", app="shipping", **{{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": {shared!r}}})

def there(_):
    import importlib.util
    yield importlib.util.find_spec("cashtide") is None

assert all(spark.sparkContext.parallelize(range(2), 2).mapPartitions(there).collect())
for name in {names!r}:
    print("ROWS", name, contract.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_tasks_need_no_package_on_their_path(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    names = ["op2_parity_join", "op4_language", "op8_bpe", "op10_quality", "op11_lexical_search", "op12_zip_warc", "op13_vector_codes"]
    script = tmp_path / "elsewhere.py"
    script.write_text(SCRIPT.format(repo=repo, shared=str(tmp_path / "shared"), names=names))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    rows = dict(line.split()[1:] for line in done.stdout.splitlines() if line.startswith("ROWS"))
    assert set(rows) == set(names), done.stderr[-3000:]
    assert rows["op8_bpe"] == rows["op2_parity_join"] == "200" and rows["op12_zip_warc"] == "50" and rows["op13_vector_codes"] == "500"
