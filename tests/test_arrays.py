"""Array files in many splits against the reader that takes a file as a whole; rejects."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.sources import arrays, files

SCHEMA = "id string, text string, n array<int>, s struct<a:string,b:array<struct<c:string>>>"


@pytest.fixture()
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "700")
    spark.conf.set(keys[1], "1")
    yield
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def some_records(n):
    rng = random.Random(n)
    bits = ['"', "\\", "{", "}", "[", "]", ",", "\n", "a", "é", '\\"', "}]", '":{', " "]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    return [{"id": str(k), "text": say() if rng.random() < 0.9 else None, "n": list(range(rng.randrange(4))), "s": {"a": say(), "b": [{"c": say()} for _ in range(rng.randrange(3))]}} for k in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_array_files_in_splits(spark, tmp_path, small_splits, indent):
    rows = some_records(150)
    path = tmp_path / "a.json"
    path.write_text("\n " + json.dumps(rows, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    got = arrays.array_rows(spark, str(path), SCHEMA)
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() >= 8
    want = spark.read.option("multiLine", True).schema(SCHEMA).json(str(path))
    order = lambda df: sorted(df.collect(), key=lambda r: int(r.id))
    assert order(got) == order(want) and got.count() == 150
    assert order(files.json_rows(spark, str(path), SCHEMA, strict=True, array=True)) == order(want)


def test_several_and_odd_arrays(spark, tmp_path, small_splits):
    (tmp_path / "x").mkdir()
    for k, text in enumerate(["[]", " [ ] ", '[{"id": "1"}]', '[{"id": "2"}, 7, {"id": "3"}, {"id": "4", "n": [1]}]', '[{"id": "5"}, {"id": '], 1):
        (tmp_path / "x" / f"{k}.json").write_text(text)
    got = arrays.array_rows(spark, str(tmp_path / "x"), SCHEMA)
    assert sorted(r.id for r in got.collect()) == ["1", "2", "4", "5"]  # the number is glued to the third, the last is cut
    with pytest.raises(Exception):
        arrays.array_rows(spark, str(tmp_path / "x"), SCHEMA, strict=True).collect()
    assert arrays.array_rows(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_written_arrays_come_back(spark, tmp_path, small_splits):
    df = spark.createDataFrame([(k, f'"{{[{k}') for k in range(300)], "k long, v string")
    files.write_array(df, str(tmp_path / "one"), "k")
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "one").glob("part*"))))
    assert whole == [{"k": k, "v": f'"{{[{k}'} for k in range(300)]
    arrays.write_array(df, str(tmp_path / "many"), "k", 4)
    assert sorted(map(tuple, arrays.array_rows(spark, str(tmp_path / "many"), "k long, v string").collect())) == sorted(map(tuple, df.collect()))
    files.write_array(df.limit(0), str(tmp_path / "none"), "k")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part*"))) == []


@pytest.mark.parametrize("array", [False, True])
def test_rejects(spark, tmp_path, array):
    good = [{"id": str(k), "tokens": ["a", "b"], "labels": ["B-X", "I-Y"]} for k in range(5)]
    bad = [{"tokens": ["a"], "labels": ["O"]}, {"id": "x", "tokens": ["a"]}, {"id": "y", "tokens": ["a"], "labels": ["O", "O"]}, {"id": "z", "tokens": [], "labels": []}]
    texts = [json.dumps(r) for r in good + bad] + ['{"id": 5, "tokens": }']
    path = tmp_path / "f.json"
    path.write_text("[" + ",".join(texts) + "]" if array else "\n\n".join(texts) + "\n")
    rows, rejects = arrays.with_rejects(spark, str(path), array)
    assert sorted((r.id, r.labels) for r in rows.collect()) == [(str(k), ["B-X", "O"]) for k in range(5)]
    got = rejects.groupBy("reason").agg(F.count("*").alias("n"), F.max("value").alias("v"), F.max("file").alias("f")).collect()
    assert {r.reason: r.n for r in got} == {"missing id": 1, "missing field": 1, "length mismatch": 1, "empty": 1, "no JSON": 1}
    assert all(r.f.endswith("f.json") for r in got) and next(r.v for r in got if r.reason == "no JSON").strip() == texts[-1]
