import os
import subprocess
import sys

from .brute import SMALL

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = f"""
import sys
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", sys.argv[1]).config("spark.driver.memory", "3g").getOrCreate()
)
sys.path.insert(0, {REPO!r})
import __spark_entry__
def missing(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("pawledger") is not None]}})
assert not spark.range(1).mapInArrow(missing, "found boolean").first()[0]
for name, query in __spark_entry__.queries().items():
    if name.startswith("op"):
        print(name, query(spark, {SMALL!r}).count() > 0, flush=True)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    """From another folder and without a search path, workers can't import the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600
    )
    told = [line for line in run.stdout.splitlines() if line.startswith("op")]
    assert len(told) == 13 and all(line.endswith("True") for line in told), run.stderr[-3000:]
