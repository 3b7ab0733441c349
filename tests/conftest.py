import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("loomtext-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="loomtext-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"

# golden matrices of the reference tests (diagonal rounding noise set to 0)
M10 = [
    [0, 0.5827688, 0.66471207, 1, 0.40161836, 0.60324907, 0.52772105, 0.68446219, 1, 0.58776689],
    [0.5827688, 0, 1, 0.6041252, 0.53194338, 0.53522438, 0.66648048, 1, 1, 1],
    [0.66471207, 1, 0, 1, 0.58649647, 1, 0.68129843, 1, 1, 0.40862775],
    [1, 0.6041252, 1, 0, 1, 1, 0.64433789, 0.65130597, 0.46070302, 1],
    [0.40161836, 0.53194338, 0.58649647, 1, 0, 0.5025925, 0.56211746, 1, 0.73671132, 0.32635254],
    [0.60324907, 0.53522438, 1, 1, 0.5025925, 0, 0.51762718, 1, 1, 1],
    [0.52772105, 0.66648048, 0.68129843, 0.64433789, 0.56211746, 0.51762718, 0, 0.64054787, 1, 1],
    [0.68446219, 1, 1, 0.65130597, 1, 1, 0.64054787, 0, 1, 1],
    [1, 1, 1, 0.46070302, 0.73671132, 1, 1, 1, 0, 0.72638398],
    [0.58776689, 1, 0.40862775, 1, 0.32635254, 1, 1, 1, 0.72638398, 0],
]
M6 = [
    [0, 0.58276892, 0.66471207, 1, 0.40161848, 1],
    [0.58276892, 0, 1, 0.60412532, 0.53194344, 0.5352245],
    [0.66471207, 1, 0, 1, 0.58649641, 1],
    [1, 0.60412532, 1, 0, 1, 1],
    [0.40161848, 0.53194344, 0.58649641, 1, 0, 0.50259256],
    [1, 0.5352245, 1, 1, 0.50259256, 0],
]


def partition(labels):
    groups = {}
    for i, lab in enumerate(labels):
        groups.setdefault(lab, set()).add(i)
    return sorted(map(frozenset, groups.values()), key=min)
