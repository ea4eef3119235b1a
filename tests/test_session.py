"""A session on a plain Spark installation, without settings of the host."""

import os
import subprocess
import sys

PROGRAM = """
from verdictflow.session import durable_path, ensure_checkpoint_dir, get_spark, materialize
from verdictflow.operators.sampling import dense_index
spark = get_spark("local[2]", shuffle_partitions=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = ensure_checkpoint_dir(spark)
assert folder == ensure_checkpoint_dir(spark) and durable_path(spark, "x").startswith(folder)
assert materialize(spark.range(5)).count() == 5
assert sorted(r.pos for r in dense_index(spark.range(9), ["id"]).collect()) == list(range(9))
print("started")
"""


def test_starts_without_settings(tmp_path):
    """spark.checkpoint.dir is unset: the library finds a folder of its own on a local master."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([here, env.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", PROGRAM], env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "started" in done.stdout, done.stderr[-2000:]
