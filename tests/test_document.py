"""The payload as one document in lines: its text is the document, and no row or task has all of it."""

import glob
import gzip
import json

import pytest
from pyspark.sql import functions as F

from test_places import _catalogue, small_splits  # noqa: F401

from spindrift.sources import document, files


def odd(spark, n=1000):
    rows = _catalogue(spark, n).withColumn("name", F.when(F.col("id") % 9 == 0, F.lit(']}{[",\n\r\\ü')).when(F.col("id") % 9 == 3, F.lit("")).otherwise(F.col("name"))).withColumn("cospar", F.when(F.col("id") % 2 == 0, F.col("cospar")))
    return rows.unionByName(rows.filter("id = 30")).unionByName(rows.filter("id = 30"))


def text(path, opened=open):
    return "".join(opened(p, "rt", encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_the_text_is_the_document(spark, tmp_path, small_splits):  # noqa: F811
    rows = odd(spark)
    want = files.write_payload(rows, {"mode": "live", "note": 'a "note"'}, "now")
    path = document.write_document(rows, str(tmp_path / "p"), {"mode": "live", "note": 'a "note"'}, "now", 64)
    found = text(path)
    whole = json.loads(want.toJSON().first())
    got = json.loads(found)
    assert len(glob.glob(f"{path}/part-*")) > 1 and max(map(len, found.split("\n"))) < 64 * 40
    assert got["count"] == 1002 and got["dict"] == whole["dict"] and {k: v for k, v in got["source"].items() if v is not None} == whole["source"]
    assert got["cols"] == whole["cols"]
    # Read again from its parts, from one file in many splits, and compressed.
    rows_of = lambda p: sorted(document.read_document(spark, p).collect(), key=str)
    told = files.payload_rows(want)
    assert document.read_document(spark, path).columns == told.columns and rows_of(path) == sorted(told.collect(), key=str)
    (tmp_path / "one.json").write_text(found, encoding="utf-8")
    assert len(found) > 10 * 3000 and rows_of(str(tmp_path / "one.json")) == rows_of(path)
    packed = document.write_document(rows, str(tmp_path / "z"), {}, "now", 100, compression="gzip")
    assert json.loads(text(packed, gzip.open))["cols"] == whole["cols"] and rows_of(packed) == rows_of(path)
    # One that isn't in lines.
    (tmp_path / "flat.json").write_text(json.dumps(got), encoding="utf-8")
    (tmp_path / "deep.json").write_text(json.dumps(got, indent=1), encoding="utf-8")
    assert rows_of(str(tmp_path / "flat.json")) == rows_of(path) == rows_of(str(tmp_path / "deep.json"))


def test_no_step_has_all_rows_as_one(spark, tmp_path):
    path = document.write_document(odd(spark, 300), str(tmp_path / "p"), {}, "now", 50)
    stored = spark.read.parquet(str(tmp_path / "p" / "rows"))
    assert stored.agg(F.max("n"), F.sum("n")).first() == (50, 302)
    assert "multiLine" not in document.read_document(spark, path)._jdf.queryExecution().toString()


def test_documents_that_do_not_agree(spark, tmp_path):
    path = document.write_document(odd(spark, 200), str(tmp_path / "p"), {}, "now", 50)
    lines = text(path).split("\n")
    values = [k for k, x in enumerate(lines) if x and x[0] not in "{]"]
    ids, last = next(k for k in values if lines[k - 1].endswith('"id":[')), values[-1]
    for k, change in enumerate((lambda x: x[:ids] + x[ids + 1 :], lambda x: x[:last] + x[last + 1 :], lambda x: x[:-2], lambda x: [x[0].replace('"version":1', '"version":2'), *x[1:]])):
        (tmp_path / f"{k}.json").write_text("\n".join(change(lines)))
        with pytest.raises(Exception, match="payload of version 1|differ in length"):
            document.read_document(spark, str(tmp_path / f"{k}.json")).collect()
    empty = document.write_document(odd(spark, 0), str(tmp_path / "e"), {}, "now")
    assert json.loads(text(empty))["cols"]["id"] == []
    with pytest.raises(files.SourceError):
        document.read_document(spark, empty)
