"""Python operators run on workers that cannot import this library: their code travels with the job."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["op2_substring_dedup", "op5_html_text", "op6_surrogates", "op7_simhash", "op8_decontaminate", "op9_katz", "op11_alignment", "op12_conversations", "op13_bpe"]

PROGRAM = """
import sys
root, data, folder, *names = sys.argv[1:]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", folder + "/warehouse").config("spark.checkpoint.dir", folder + "/shared").config("spark.local.dir", folder).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def importable(_):
    try:
        import ledgerloom
        return [True]
    except ImportError:
        return [False]

assert spark.sparkContext.parallelize([1], 1).mapPartitions(importable).collect() == [False]
sys.path.insert(0, root)
from ledgerloom.llm import entries
for name in names:
    print(name, entries.queries()[name](spark, data).count())
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_python_operators_need_no_package_on_workers(tmp_path):
    program = tmp_path / "program.py"
    program.write_text(PROGRAM)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(program), ROOT, DATA, str(tmp_path), *NAMES], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert set(counts) == set(NAMES) and all(int(n) > 0 for n in counts.values())
