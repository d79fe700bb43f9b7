import os
import subprocess
import sys

import pytest

from scenograph import session
from scenograph.sources import volumes

ALONE = """
from scenograph.session import build, clear_scratch, materialize, release, shared_dir
s = build("alone", "local[1]", 1)
assert s.conf.get("spark.checkpoint.dir", None) is None
one, two = materialize(s.range(3), "a"), materialize(s.range(4), "b")
assert (one.count(), two.count()) == (3, 4) and one._scratch.startswith(shared_dir(s)) and shared_dir(s) == shared_dir(s)
import os
release(one)
assert not os.path.exists(one._scratch.removeprefix("file:")) and os.path.exists(two._scratch.removeprefix("file:"))
clear_scratch(s)
assert not os.path.exists(two._scratch.removeprefix("file:"))
print("fine")
"""


def test_a_session_without_any_setting(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd(), "TMPDIR": str(tmp_path)}
    got = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=120)
    assert "fine" in got.stdout, got.stderr[-2000:]


def test_a_cluster_must_name_a_folder():
    class Nothing:
        def __getattr__(self, name):
            return self

        def __call__(self, *args):
            return self

        def isDefined(self):
            return False

    class Context:
        _jsc, master = Nothing(), "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_volumes_outside_the_bounds_are_not_opened(spark, tmp_path):
    base = f"file://{tmp_path}/novels"
    volumes.write_volumes(spark.createDataFrame([("n", i, f"text {i}") for i in range(1, 9)], "folder string, vol_num int, text string"), base)
    df = volumes.read_volumes(spark, base, 8, 8)
    assert [(r.folder, r.vol_num) for r in df.collect()] == [("n", 8)]
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == 1
