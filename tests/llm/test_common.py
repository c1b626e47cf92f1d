import random

import pytest

from noticelake.llm import common
from tests.llm.test_simhash import components


class Session:
    """A session that names no folder."""

    def __init__(self, master="local[2]"):
        self.conf, self.sparkContext, self.dir, self.master = self, self, None, master

    def get(self, key, default):
        return default

    def getCheckpointDir(self):  # noqa: N802
        return self.dir

    def setCheckpointDir(self, path):  # noqa: N802
        self.dir = path


def test_shared_dir(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    bare = Session()
    assert common.shared_dir(bare) == common.shared_dir(bare) == bare.dir != None  # noqa: E711
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(Session(master))


def test_written_is_the_same_table(spark):
    df = spark.createDataFrame([(1, None), (2, ["a"])], "a long, b array<string>")
    again = common.written(df, "t")
    assert again.schema == df.schema and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(80)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)], "none": [(3, 3)]}[shape]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])


def test_hash_sample(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "x")
    some = sorted(r.x for r in common.hash_sample(rows, "x", 1000).collect())
    assert 700 < len(some) <= 1000 and some == sorted(r.x for r in common.hash_sample(rows.repartition(7), "x", 1000).collect())
    assert common.hash_sample(rows, "x", 50_000).count() == 20_000


def test_ascii_lower(spark):
    texts = ["ABZ az", "ÉÀ AÉ", "", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(common.ascii_lower("t")).collect()]
    assert got == ["abz az", "ÉÀ aÉ", "", None]
