import os
import subprocess
import sys

import pytest

from ledgerloom import session

ALONE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from ledgerloom.session import saved, shared_dir
spark = SparkSession.builder.master({master!r}).config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
assert saved(spark, spark.range(7), "x").count() == 7
assert shared_dir(spark) == shared_dir(spark)
print("saved")
"""


@pytest.mark.parametrize("master", ["local", "local[2]"])
def test_saves_without_a_named_folder(master, tmp_path):
    """In a session of its own that doesn't set spark.checkpoint.dir, nor do any defaults."""
    root = session.__file__.rsplit("/", 2)[0]
    got = subprocess.run([sys.executable, "-c", ALONE.format(root=root, master=master)], capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)})
    assert got.returncode == 0 and "saved" in got.stdout, got.stderr[-2000:]


class Cluster:
    class conf:  # noqa: N801
        get = staticmethod(lambda name, default: None)

    class sparkContext:  # noqa: N801
        master = "spark://far:7077"


def test_a_cluster_must_name_it():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)
