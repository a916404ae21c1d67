"""Dictionary scans and n-gram counts that read a text once and shuffle no text parts."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelytics.functions import blocks, text
from parcelytics.operators import matching


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rows = [(1, "red house red house the of"), (2, "Red House"), (3, None), (4, ""), (None, "blue gate"), (5, "the of"), (6, "red")]
    folder = f"{tmp_path_factory.mktemp('texts')}/t"
    spark.createDataFrame(rows, "id long, t string").coalesce(1).write.parquet(folder)
    return spark.read.parquet(folder)


def counted(df):
    return sorted((str(r["id"]), r["gram"], r["n"]) for r in df.collect())


def test_ngrams_of_single_rows_are_not_shuffled(spark, texts):
    found = matching.ngram_counts(texts, "id", "t", 2, ["the", "of"])
    assert "hashpartitioning" not in plan(found)
    once = [("1", "house red", 1), ("1", "house the", 1), ("1", "red house", 2), ("2", "Red House", 1), ("None", "blue gate", 1)]
    assert counted(found) == once
    assert found.schema["n"].dataType.simpleString() == "bigint"


def test_ngrams_of_repeated_and_null_keys_are_added(spark, texts):
    twice = texts.unionByName(texts.filter("id = 1 OR id IS NULL"))
    assert counted(matching.ngram_counts(twice, "id", "t", 2, ["the", "of"])) == [
        ("1", "house red", 2), ("1", "house the", 2), ("1", "red house", 4), ("2", "Red House", 1), ("None", "blue gate", 2)]


def test_aliases_read_the_texts_once(spark, texts):
    aliases = spark.createDataFrame([("red house", "A"), ("the of", "B"), ("red", "C"), ("house red house the", "D")], "alias_key string, division string")
    aliases = aliases.withColumn("alias_key", F.array_join(F.transform(F.split("alias_key", " "), text.sound_key), " "))
    found = matching.alias_match(texts, "id", "t", aliases, 3)
    assert plan(found).count("FileScan parquet") <= 1 + plan(found).count("== Initial Plan ==")
    assert sorted(map(tuple, found.collect())) == [(1, "A", "red house", 2), (2, "A", "Red House", 0), (5, "B", "the of", 0), (6, "C", "red", 0)]


def test_whole_text_longer_than_the_grams(spark, texts):
    aliases = spark.createDataFrame([("red house red house the of", "W"), ("red house", "A")], "alias_key string, division string")
    aliases = aliases.withColumn("alias_key", F.array_join(F.transform(F.split("alias_key", " "), text.sound_key), " "))
    found = {r["id"]: r["division"] for r in matching.alias_match(texts, "id", "t", aliases, 2).collect()}
    assert found == {1: "W", 2: "A"}


def test_contains_by_bytes(spark):
    rows = [(1, "in Malmö Söder"), (1, "the bay"), (2, "ab"), (3, "x" * 20 + "日本語の町" + "y" * 9), (None, "Malmö"), (4, "bay"), (5, None)]
    texts = spark.createDataFrame(rows, "id long, t string")
    names = spark.createDataFrame([("Malmö", "M", 1.0), ("Malmö S", "L", 9.0), ("bay", "B", 2.0), ("日本語", "J", 1.0), ("ab", "N", 0.0), ("bay", "A", 2.0)], "name string, division string, area double")
    found = matching.contains_match(texts, "id", "t", names)
    assert "regexp_extract_all" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, "L", "Malmö S"), (3, "J", "日本語"), (4, "A", "bay")]


def test_windows_over_slices(monkeypatch):
    body = bytes(range(97, 123)).decode() * 3
    want = {int.from_bytes(body.encode()[i : i + w], "big") for w in (3, 6) for i in range(len(body) - w + 1)}
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([body, "ab", "abcd"])], names=["k", "t"])
    for piece, most in ((1 << 20, 1 << 20), (5, 1), (1, 4)):
        monkeypatch.setattr(blocks, "_SLICE", piece)
        monkeypatch.setattr(blocks, "_WINDOWS", most)
        got = [r for out in blocks.byte_windows(iter([batch])) for r in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        assert {h for k, h in got if k == 7} == want and {h for k, h in got if k == 9} == {0x616263, 0x626364} and {k for k, _ in got} == {7, 9}
