"""JSON arrays in splits against the whole file read at once."""

import json
import random

import pytest

from termweave.sources.readers import read_json_array

SCHEMA = "id string, text string, tags array<string>, sub struct<a: string, b: array<struct<c: string>>>"


def rows_of(df):
    return sorted((r.asDict(True) for r in df.collect()), key=lambda r: str(r["id"]))


def record(rng, i):
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", "é", "\n", ",", "a", "𝒳", " "]) for _ in range(rng.choice([0, 3, 40, 900])))
    return {"id": str(i), "text": text, "tags": [text[:5], "}]"], "sub": {"a": None, "b": [{"c": "{"}, {"c": text[5:9]}]}}


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_borders_fall_anywhere(spark, tmp_path, size):
    rng = random.Random(size)
    records = [record(rng, i) for i in range(120)]
    for name, some, indent in (("a", records[:70], None), ("b", records[70:], 2), ("c", [], None)):
        (tmp_path / f"{name}.json").write_text(json.dumps(some, indent=indent, ensure_ascii=name == "b"), encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = read_json_array(spark, str(tmp_path), SCHEMA)
        if size < 1000:
            assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert rows_of(found) == sorted(records, key=lambda r: r["id"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_elements_that_are_no_objects(spark, tmp_path):
    (tmp_path / "x.json").write_text('[1, "}{", [{"id": "no"}, {"id": "no"}], null, {"id": "yes"}, {}, {"id": "last", "text": null}]\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("15", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = read_json_array(spark, str(tmp_path / "x.json"), "id string, text string")
            assert sorted(str(r["id"]) for r in found.collect()) == ["None", "last", "yes"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_without_text(spark, tmp_path):
    (tmp_path / "x.json").write_text("")
    assert read_json_array(spark, str(tmp_path / "x.json"), "id string").count() == 0
