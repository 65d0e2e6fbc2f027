import random

import pytest
from pyspark.sql import functions as F

from sondhan.operators.numbering import number_rows
from sondhan.session import ensure_checkpoint_dir
from sondhan.sources.files import systematic_sample


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    values = list(range(5000))
    rng.shuffle(values)
    df = spark.createDataFrame([(v, f"t{v % 7}") for v in values], "v int, t string").repartition(6)
    assert all(r.n == r.v for r in number_rows(df, ["v"], "n").collect())
    got = number_rows(df, [F.desc("t"), "v"], "n").orderBy("n").collect()
    assert [(r.t, r.v) for r in got] == sorted([(f"t{v % 7}", v) for v in values], key=lambda x: (-int(x[0][1:]), x[1])) and [r.n for r in got] == values.__class__(range(5000))
    assert number_rows(df.filter("v < 0"), ["v"], "n").count() == 0


def test_stride(spark):
    df = spark.range(1003)
    assert [r.id for r in systematic_sample(df, "id", 10).collect()] == [100 * i for i in range(10)]
    assert [r.id for r in systematic_sample(df.filter("id < 3"), "id", 10).collect()] == [0, 1, 2]
    assert systematic_sample(df.filter("id < 0"), "id", 10).count() == 0


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

        def getConf(self):
            return Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(type("Session", (), {"sparkContext": Context(), "conf": Conf()}))
