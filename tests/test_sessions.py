"""A session that says nothing of a shared folder, and plans that must not meet everything with everything."""

from __future__ import annotations

import os
import subprocess
import sys

from trustlake.operators import observe

RUN = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
assert spark.conf.get("spark.checkpoint.dir", None) is None, "the machine has a setting"
for name in {names}:
    print(name, e.queries()[name](spark, "{data}").count())
{more}
"""


def run_plain(names, data, tmp_path, more=""):
    """Run queries in a session of its own, without the machine's settings; what it leaves in its temporary folder."""
    conf, own = tmp_path / "conf", tmp_path / "tmp"
    conf.mkdir()
    own.mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "TMPDIR": str(own), "PYTHONPATH": os.pathsep.join([os.getcwd(), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", RUN.format(names=names, data=data, more=more)], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return [f for d, _, files in os.walk(own) for f in files if "trustlake" in d]


def test_a_plain_session_works_and_leaves_no_file(spark, data, tmp_path):
    assert run_plain(["g1_closure", "st1_index_stream"], data, tmp_path) == []


def test_service_levels_have_no_nested_loop(spark):
    slo = spark.createDataFrame([("a", "availability", "", 0.9, None, 3), ("b", "schema_stability", "", 0.9, None, 2)], "slo_name string, kind string, scope string, target double, threshold double, days int")
    none = spark.createDataFrame([], "dataset_urn string, value_num double, status string, window_start timestamp, started_at timestamp")
    runs = spark.sql("SELECT * FROM VALUES ('SUCCEEDED', TIMESTAMP '2024-01-10 00:00:00'), ('FAILED', TIMESTAMP '2024-01-07 00:00:00'), ('FAILED', TIMESTAMP '2024-01-06 23:59:59'), ('SUCCEEDED', TIMESTAMP '2024-01-10 00:00:01') t(status, started_at)")
    changes = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-09 12:00:00'), (TIMESTAMP '2024-01-08 00:00:00'), (TIMESTAMP '2024-01-07 00:00:00') t(changed_at)")
    out = observe.measure_slo(slo, none, none, runs, changes, "2024-01-10 00:00:00")
    assert {r.slo_name: (r.good, r.total) for r in out.collect()} == {"a": (1, 2), "b": (0, 2)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
