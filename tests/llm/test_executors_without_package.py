"""All training-data queries in a session whose Python workers can't import this package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import SparkSession

spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.session.timeZone", "UTC").getOrCreate())


def importable(batches):
    import importlib.util

    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("recollect") is not None] * batch.num_rows)], names=["found"])


assert not spark.range(1).mapInArrow(importable, "found boolean").first()["found"]
sys.path.insert(0, sys.argv[1])
from recollect.llm.queries import QUERIES

for name, query in QUERIES.items():
    if name.startswith("op"):
        print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_all_queries(tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "run.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(tmp_path / "run.py"), REPO, str(tmp_path / "shared")], cwd=tmp_path / "empty", env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split("\n")) == 14


def test_shared_arrays_are_not_copied(spark):
    import numpy as np
    from recollect.llm.class_lm import Lookup
    from recollect.llm.common import Shared

    words = np.arange(1000, dtype=np.int64)
    shared = Shared(spark, (Lookup(words, words + 1), np.ones(5)))
    lookup, ones = shared.value
    assert ones.tolist() == [1] * 5 and lookup(np.array([7, 5000])).tolist() == [8, -1]
    held = shared.pickled.value[1]
    assert any(np.shares_memory(lookup.values, a) for a in held)
