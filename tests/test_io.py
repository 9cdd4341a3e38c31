"""Files with bad rows, columns in another order, nested results."""
import pytest
from pyspark.sql import functions as F

from riskgraph.operators import report as RP
from riskgraph.sources import sinks as SK
from riskgraph.sources import tables as TB

HEADER = ",".join(TB.INSPECTION_RENAMES)


def test_bad_rows_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n1,BR,5,1,1,0,2,0,3,1\n1,BR,5,x,1,0,2,0,3,1\n2,BR,6,0\n3,,,,,,,,,\n4,US,1,0,1,0,2,0,3,1,99\n")
    rows = TB.read_inspections(spark, str(tmp_path / "a.csv"), keep_bad=True)
    got = {r.enty_id: r for r in TB.read_inspections(spark, str(tmp_path / "a.csv")).collect()}
    assert set(got) == {"1", "3"} and got["1"].target_proxy == 1 and got["3"].ctry_code is None
    kept = rows.select("enty_id", TB.BAD_ROW).collect()
    assert sorted(r[1] for r in kept if r[1]) == ["1,BR,5,x,1,0,2,0,3,1", "2,BR,6,0", "4,US,1,0,1,0,2,0,3,1,99"]
    assert tuple(TB.inspection_summary(rows).first()) == (2, 2, 3)


def test_new_entities_by_name(spark, tmp_path):
    (tmp_path / "n.csv").write_text("b,entity_id,z,a\n2.5,7,q,1.5\nno,8,q,\n")
    got = TB.read_new_entities(spark, str(tmp_path / "n.csv"), ["a", "b"])
    assert [tuple(r) for r in got.orderBy("entity_id").collect()] == [("7", 1.5, 2.5), ("8", None, None)]
    with pytest.raises(ValueError, match="lacks"):
        TB.read_new_entities(spark, str(tmp_path / "n.csv"), ["a", "c"])


def test_predictions_and_reports_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 0.25], "x,y"), (2, [1e-9, 3.0], None)], "id long, v array<double>, t string")
    SK.write_predictions(df, str(tmp_path / "p"), "csv")
    got = SK.read_predictions(spark, str(tmp_path / "p"), "id long, v_0 double, v_1 double, t string", "csv")
    assert sorted(map(tuple, got.collect())) == [(1, 0.5, 0.25, "x,y"), (2, 1e-9, 3.0, None)]
    with pytest.raises(Exception):
        SK.read_predictions(spark, str(tmp_path / "p"), "id long, v_1 double, v_0 double, t string", "csv").collect()
    SK.write_predictions(df, str(tmp_path / "q"))
    assert SK.read_predictions(spark, str(tmp_path / "q"), "id long, v array<double>, t string").count() == 2


def test_nested_report(spark, tmp_path):
    schema = ("run int, bestParameters map<string,double>, testMetrics struct<f1:double,by:struct<a:float,n:long>>, modelInfo string,"
              "trainMetrics struct<x:double>, history array<struct<loss:double,tags:array<string>>>, done boolean, extra map<string,array<int>>")
    rows = [(1, {"b": 2.0, "a": 0.123456}, (0.98765, (0.5, 3)), "forest", None, [(0.1, ["p", "q"]), (0.2, None)], True, {"k": [7, 8]}),
            (2, None, None, None, None, None, None, None)]
    out = RP.flatten_report(spark.createDataFrame(rows, schema), ["run"])
    got = {(r.run, r.section, r.metric): (r.value, r.text) for r in out.collect()}
    assert got == {
        (1, "bestParameters", "a"): (0.1235, None), (1, "bestParameters", "b"): (2.0, None), (1, "testMetrics", "f1"): (0.9877, None),
        (1, "testMetrics", "by.a"): (0.5, None), (1, "testMetrics", "by.n"): (3.0, None), (1, "modelInfo", "modelInfo"): (None, "forest"),
        (1, "other", "history[0].loss"): (0.1, None), (1, "other", "history[0].tags[0]"): (None, "p"), (1, "other", "history[0].tags[1]"): (None, "q"),
        (1, "other", "history[1].loss"): (0.2, None), (1, "other", "done"): (None, "true"), (1, "other", "extra.k[0]"): (7.0, None),
        (1, "other", "extra.k[1]"): (8.0, None), (2, "modelInfo", "modelInfo"): (None, None), (2, "other", "done"): (None, None)}
    SK.write_report(out.drop("run"), str(tmp_path / "r"))
    assert SK.read_report(spark, str(tmp_path / "r")).count() == len(got)
