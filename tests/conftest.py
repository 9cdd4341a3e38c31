import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rg-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()


def make_graph(spark, edges, nodes=None):
    """Undirected hand graph: both directions of every edge."""
    from riskgraph.operators.graph import Graph
    names = sorted({x for e in edges for x in e} | set(nodes or []))
    n = spark.createDataFrame([(x, "N", x) for x in names], "node_id string, label string, key string")
    rows = [(a, b, "R") for a, b in edges] + [(b, a, "R") for a, b in edges]
    e = spark.createDataFrame(rows, "src string, dst string, rel_type string")
    return Graph(n, e, undirected=True)
