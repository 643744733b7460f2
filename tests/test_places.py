"""Places of rows in files that are read in many splits, cells over lines, and the payload in parts."""

import pytest
from pyspark.sql import functions as F

from spindrift.sources import catalog, chunks, files


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_the_last_row_of_a_key_wins_over_splits(spark, small_splits, tmp_path):
    lines = [f"N{'x' * (v % 7)},{i},C{v},PAY" for v in range(12) for i in range(200)]
    (tmp_path / "s.csv").write_text("OBJECT_NAME,NORAD_CAT_ID,OWNER,OBJECT_TYPE\n" + "\n".join(lines) + "\n")
    raw = files.read_csv(spark, str(tmp_path / "s.csv"), "OBJECT_NAME")
    assert raw.count() == 2400 and raw.select(f"{files.PLACE}.split").distinct().count() > 5
    in_order = raw.orderBy(files.PLACE).select("NORAD_CAT_ID", "OWNER").collect()
    assert [(r[0], r[1]) for r in in_order] == [tuple(x.split(",")[1:3]) for x in lines]
    got = files.read_registry(spark, str(tmp_path / "s.csv")).collect()
    assert len(got) == 200 and {r["owner"] for r in got} == {"C11"} and set(got[0].asDict()) == {"id", "owner", "registered", "object_type"}


def test_files_of_a_folder_go_by_path(spark, small_splits, tmp_path):
    for i, n in enumerate((900, 3, 400)):  # the largest split is dealt first, so tasks are in another order than paths
        (tmp_path / f"{i}.csv").write_text("OBJECT_NAME,NORAD_CAT_ID,OWNER\n" + "".join(f"n,{k},F{i}\n" for k in range(n)))
    got = {r["id"]: r["owner"] for r in files.read_registry(spark, str(tmp_path)).collect()}
    assert got == {k: "F2" if k < 400 else "F0" for k in range(900)}


def test_tsv_places(spark, small_splits, tmp_path):
    body = "".join(f"{k % 50}\tv{k}\n" for k in range(2000))
    (tmp_path / "t.tsv").write_text("#Key\tValue\n# Updated 1\n" + body + "# Updated 2\n")
    rows, updated = files.read_tsv(spark, str(tmp_path / "t.tsv"))
    assert updated == "2"
    assert {r["Key"]: r["Value"] for r in files.last_by(rows, "Key").collect()} == {str(k): f"v{1950 + k}" for k in range(50)}
    sat = "".join(f"S{k}\t{k % 40}\tA{k // 40}\tJ\t1999 Jan  5\t1\n" for k in range(400))
    (tmp_path / "sat.tsv").write_text("#JCAT\tSatcat\tOwner\tState\tLDate\tMass\n" + sat)
    (tmp_path / "p.tsv").write_text("#JCAT\tCategory\tClass\n" + "".join(f"S{k % 400}\tC{k // 400}\tD\n" for k in range(1200)))
    (tmp_path / "o.tsv").write_text("#Code\tShortEName\tEName\tShortName\tName\n" + "".join(f"A9\t-\tName {k}\tx\ty\n" for k in range(300)))
    read = lambda n: files.read_tsv(spark, str(tmp_path / n))[0]
    # number 0 is no catalogue number
    got = catalog.general_registry(read("sat.tsv"), read("p.tsv"), read("o.tsv")).collect()
    assert len(got) == 39 and {(r["g_owner_name"], r["g_category"]) for r in got} == {("Name 299", "C2")} and files.PLACE not in got[0].asDict()


@pytest.mark.parametrize(
    "line, spans",
    [('a,"b, c",d', False), ('a,"x ""y"" z",b', False), ('"""x""",b', False), ('"","",', False), ("plain,line", False), ('a,"open', True), ('a,"b,""', True), ('""",b', True), ('a"b,"c', True), ('"a"b,"c"', True)],
)
def test_cells_over_lines_are_seen(spark, tmp_path, line, spans):
    (tmp_path / "x.csv").write_text(f"OBJECT_NAME,B,C\n{line}\n")
    assert files.spans_lines(spark, str(tmp_path / "x.csv")) == spans


def test_both_ways_of_reading_agree(spark, small_splits, tmp_path):
    (tmp_path / "x.csv").write_bytes(("﻿OBJECT_NAME,B,C\r\n" + "".join(f'"n, ""{k}""",{k},\r\n' for k in range(700))).encode())
    ways = [files.read_csv(spark, str(tmp_path / "x.csv"), "OBJECT_NAME", way).drop(files.PLACE).collect() for way in (None, False, True)]
    assert sorted(ways[0]) == sorted(ways[1]) == sorted(ways[2]) and len(ways[0]) == 700
    (tmp_path / "y.csv").write_text('OBJECT_NAME,B\n"two\nlines",1\nlast,2\n')
    assert [r["OBJECT_NAME"] for r in files.read_csv(spark, str(tmp_path / "y.csv"), "OBJECT_NAME").collect()] == ["two\nlines", "last"]


def _catalogue(spark, n):
    k = F.col("k")
    return spark.range(n).toDF("k").select(
        (k * 3).cast("int").alias("id"), F.concat(F.lit("N"), k.cast("string")).alias("name"), F.lit("1998-067A").alias("cospar"), (k * 1000 + 1).alias("epoch_ms"),
        *[F.lit(float(i)).alias(c) for i, c in enumerate(("mean_motion", "eccentricity", "inclination", "raan", "arg_pericenter", "mean_anomaly", "bstar", "mean_motion_dot", "mean_motion_ddot"))],
        F.lit(999).alias("element_set_no"), F.lit(5).alias("rev_at_epoch"), F.concat(F.lit("Op "), ((k * 7) % 41).cast("string")).alias("operator"), F.when(k % 3 == 0, "KR").otherwise("US").alias("country"),
        F.when(k % 5 == 0, "gps").alias("constellation"), F.lit("nav").alias("mission"), F.lit("civil").alias("sector"), F.when(k % 2 == 0, "1999").otherwise("").alias("launch_date"), F.when(k % 4 == 0, F.lit(12.5)).cast("float").alias("mass_kg"),
    )


def test_payload_in_parts(spark, tmp_path):
    rows = _catalogue(spark, 1000)
    rows = rows.unionByName(rows.filter("id = 30")).unionByName(rows.filter("id = 30"))
    folder = str(tmp_path / "p")
    assert chunks.write_chunks(rows, folder, {"mode": "live", "note": "x"}, "now", 64) == 1002
    assert chunks.read_head(spark, folder)["source"]["note"] == "x"
    held = [r["n"] for r in spark.read.json(f"{folder}/chunks").select(F.size("cols.id").alias("n")).collect()]
    assert sum(held) == 1002 and max(held) <= 64 and len(held) >= 16
    whole = files.payload_rows(files.write_payload(rows, {}, "now"))
    parts = chunks.read_chunks(spark, folder)
    assert parts.columns == whole.columns and sorted(parts.collect(), key=str) == sorted(whole.collect(), key=str)
    firsts = {r["value"]: r["code"] for r in chunks.dictionaries(rows, 16).filter("dict = 'operators'").collect()}
    seen = list(dict.fromkeys(f"Op {k * 7 % 41}" for k in range(1000)))
    assert firsts == {v: i for i, v in enumerate(seen)}


def test_parts_that_do_not_agree(spark, tmp_path):
    folder = str(tmp_path / "p")
    with pytest.raises(files.SourceError):
        chunks.read_chunks(spark, folder)
    chunks.write_chunks(_catalogue(spark, 50), folder, {}, "now", 10)
    spark.read.json(f"{folder}/chunks").limit(1).write.mode("append").json(f"{folder}/chunks")
    with pytest.raises(files.SourceError):
        chunks.read_chunks(spark, folder)
    assert chunks.write_chunks(_catalogue(spark, 0), str(tmp_path / "e"), {}, "now") == 0
    assert chunks.read_chunks(spark, str(tmp_path / "e")).count() == 0
