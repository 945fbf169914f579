"""Tables in the shared folder, settings and the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from siltstone.store import Table, run_tables, settings, shared_root

ROOT = Path(__file__).resolve().parent.parent
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_settings_are_put_back(spark):
    before = spark.conf.get(ROWS)
    try:
        with settings(spark, {ROWS: "7", "spark.sql.some.new.setting": "x"}):
            assert spark.conf.get(ROWS) == "7"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(ROWS) == before and spark.conf.get("spark.sql.some.new.setting", None) is None
    Table(spark.range(3), "t").drop()
    assert spark.conf.get(ROWS) == before


def test_each_run_owns_its_tables(spark):
    with run_tables() as outer:
        a = Table(spark.range(3), "a")
        with run_tables() as inner:
            b, c = Table(spark.range(4), "b"), Table(spark.range(5), "c")
            c.drop()
        assert outer == [a.uri] and inner == [b.uri]
    d = Table(spark.range(2), "d")
    assert outer == [a.uri] and d.made is None and [x.df.count() for x in (a, b, d)] == [3, 4, 2]
    for x in (a, b, d):
        x.drop()
    assert outer == [] and inner == []


def test_shared_folder_without_a_setting_is_in_the_warehouse(spark):
    class Conf:
        def get(self, key, default=None):
            return "file:/warehouse/" if key == "spark.sql.warehouse.dir" else default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            @staticmethod
            def getCheckpointDir():
                return None

    assert shared_root(Session()) == "file:/warehouse/_siltstone"
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_entry_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['siltstone.llm'] = None; import __spark_entry__ as e; q = e.queries(); print('bm25_topk' in q, 'pipeline' in q, any(x.startswith('op1_') for x in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True)
    assert out.stdout.split() == ["True", "False", "False"], out.stderr


def test_a_local_warehouse_is_no_shared_folder_of_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "file:/warehouse/", "spark.master": "yarn"}.get(key, default)

    class Context:
        _jvm, _jsc = spark.sparkContext._jvm, spark.sparkContext._jsc

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Session())
