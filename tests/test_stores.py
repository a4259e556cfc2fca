"""Round trips of models, manifests and JSON maps."""
import pytest

from barloom.operators import evalml as E
from barloom.sources import datasets as D


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), float((i % 7) - (i % 3))) for i in range(60)], "a double, b double, r double")
    model = E.fit_regressor(df, ["a", "b"], trees=3, depth=2)
    E.save_model(model, str(tmp_path / "m"))
    again = E.load_model(str(tmp_path / "m"))
    key = lambda m: [r.pred for r in m.transform(df).orderBy("a", "b", "r").collect()]
    assert key(again) == pytest.approx(key(model))


def test_json_map_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("h1:a", 1.5), ("h2:b", -2.0)], "key string, value double")
    D.write_json_map(rows, str(tmp_path / "j"))
    back = D.split_key(D.read_json_map(spark, str(tmp_path / "j"), "double"))
    assert sorted(map(tuple, back.collect())) == [("h1:a", 1.5, "h1", "a"), ("h2:b", -2.0, "h2", "b")]


def test_manifest(spark, tmp_path):
    configs = spark.createDataFrame([(3, {"b": "2", "a": "1"}), (4, {})], "idx int, params map<string,string>")
    D.write_manifest(configs, "idx", "params", str(tmp_path / "m"))
    back = {r.idx: r for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert set(back) == {3, 4} and back[3].params.a == "1" and back[3].hash != back[4].hash
