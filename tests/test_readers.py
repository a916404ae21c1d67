"""Feature files read in splits, and joins that count while they run."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelytics.operators import matching
from parcelytics.sources import readers

RING = [[0.0, 0.0], [1.0, 0.0], [1.0, 2.0], [0.0, 2.0]]


def features(n):
    for k in range(n):
        ring = [[x + k, y] for x, y in RING]
        odd = {"type": "MultiPolygon", "coordinates": [[ring], [[[5.0, 5.0], [6.0, 5.0], [6.0, 6.0]]]]}
        note = 'says "type": "Feature", {"type":"Feature",} \n, été ' * (k % 3)
        yield {"type": "Feature", "properties": {"id": str(k), "note": note}, "geometry": odd if k % 2 else {"type": "Polygon", "coordinates": [ring, RING]}}


def collection(n, separators=(",", ":"), indent=None):
    return json.dumps({"type": "FeatureCollection", "name": "x", "features": list(features(n))}, separators=separators, indent=indent)


def shown(df):
    return sorted((int(r["properties"]["id"]), r["properties"]["note"], [[tuple(p) for p in ring] for ring in r["rings"]], tuple(r["bbox"])) for r in df.collect())


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    text = collection(2000)
    (tmp_path / "a.geojson").write_text(text, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(text) // 20))
    try:
        found = readers.load_feature_files(spark, str(tmp_path))
        used = found.select(F.spark_partition_id().alias("p")).distinct().count()
        got = shown(found)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert used >= 15
    assert got == shown(readers.load_geojson(spark.createDataFrame([(text,)], "t string"), "t")) and len(got) == 2000


@pytest.mark.parametrize("separators, indent, begin", [((",", ":"), None, readers.FEATURE_BEGIN), ((", ", ": "), None, '{"type": "Feature", '), ((", ", ": "), None, readers.FEATURE_BEGIN), ((",", ": "), 1, '"never"')])
def test_forms_of_files(spark, tmp_path, separators, indent, begin):
    """The form that is named, and files in which it never occurs, which are read whole; filters; no features."""
    (tmp_path / "a.json").write_text(collection(7, separators, indent), encoding="utf-8")
    (tmp_path / "b.json").write_text(collection(0, separators, indent), encoding="utf-8")
    found = readers.load_feature_files(spark, str(tmp_path), begin=begin)
    assert [r[0] for r in shown(found)] == list(range(7))
    kept = readers.load_feature_files(spark, str(tmp_path), F.col("properties")["id"] == "3", begin=begin)
    assert [r[0] for r in shown(kept)] == [3]


@pytest.mark.parametrize("extra", ['{"properties":{},"type":"Feature","geometry":null}', '{"type": "Feature","properties":{"id":"9"},"geometry":null}'])
def test_mixed_forms_are_an_error(spark, tmp_path, extra):
    text = collection(3)
    (tmp_path / "a.json").write_text(text[:-2] + "," + extra + "]}", encoding="utf-8")
    with pytest.raises(PySparkException):
        readers.load_feature_files(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("unused", [False, True])
def test_observed_join_counts_what_it_joins(spark, unused):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (2, 22), (7, 70), (7, 71), (None, 0)], "k int, w int")
    joined, report = matching.observed_join(left, right, "k", unused)
    assert joined.columns == ["k", "v", "w"]
    assert sorted((r["v"], r["w"]) for r in joined.collect()) == sorted((r["v"], r["w"]) for r in left.join(right, "k", "left").collect())
    want = {"repeated_right_keys": 2, "left_rows_without_match": 2, "rows_in": 5, "rows_out": 7}
    assert report() == want | ({"unused_right_keys": 2} if unused else {})  # 7 and the null key
