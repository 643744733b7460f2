"""Versions, the pointer, gates and the chain of sources over failing writes."""

import pytest
from pyspark.sql import functions as F

from spindrift.sources import catalog, files, store


def broken(spark, n):
    """Rows that end in an error while they are written."""
    return spark.range(n).select(F.when(F.col("id") == n - 1, F.raise_error(F.lit("cut off"))).otherwise(F.col("id")).cast("long").alias("id"))


def test_versions(spark, tmp_path):
    kept = store.VersionedStore(spark, str(tmp_path), clock=lambda: 5.0)
    assert kept.last() is None and kept.log().count() == 0
    with pytest.raises(files.SourceError):
        kept.read()
    one = kept.publish(spark.range(10).toDF("id"), {"top": F.max("id")})
    first = kept.read()
    assert one["number"] == 1 and one["figures"] == {"rows": 10.0, "top": 9.0} and one["written_s"] == 5.0
    with pytest.raises(Exception, match="cut off"):
        kept.publish(broken(spark, 1000))
    assert kept.last()["version"] == one["version"] and kept.read().count() == 10
    # An empty version, with a figure that is null; then one that the gate refuses.
    two = kept.publish(spark.range(0).toDF("id"), {"top": F.max("id")})
    assert two["figures"] == {"rows": 0.0} and kept.read().count() == 0 and first.count() == 10 and kept.read(one["version"]).count() == 10
    with pytest.raises(store.Refused, match="too few"):
        kept.publish(spark.range(3).toDF("id"), gate=lambda now, before: "too few" if now["rows"] < 5 and before == {"rows": 0.0} else None)
    assert kept.last()["number"] == 2 and store.VersionedStore(spark, str(tmp_path)).last()["version"] == two["version"]


def test_gate():
    judge = store.coverage_gate(least_rows=10, unknown_share=0.2, shrink=0.5)
    assert judge({"rows": 9.0, "unknown_country": 0.0}, None) and judge({"rows": 100.0, "unknown_country": 21.0}, None) and judge({"rows": 40.0, "unknown_country": 0.0}, {"rows": 100.0})
    assert judge({"rows": 50.0, "unknown_country": 10.0}, {"rows": 100.0}) is None


def test_chain_over_a_failing_write(spark, tmp_path):
    state = {"live": lambda: spark.range(1200).toDF("id"), "t": 0.0}
    make = lambda **k: catalog.CatalogStore(spark, lambda: state["live"](), lambda: spark.range(3).toDF("id"), str(tmp_path / "warm"), clock=lambda: state["t"], **k)
    said = lambda f: (f.count(), *f.select("source_mode", "source_note").first())
    assert said(make(offline=True).get()) == (3, "snapshot", "Offline mode: serving bundled snapshot.")
    good = state["live"]
    state["live"] = lambda: broken(spark, 5000)
    assert said(make().get())[1:] == ("snapshot", catalog.NOTES["snapshot"])
    with pytest.raises(Exception, match="cut off"):
        make(production=True).get()
    state["live"] = good
    live = make(production=True).get()
    assert said(live) == (1200, "live", None)
    state["t"], state["live"] = 8000.0, lambda: broken(spark, 5000)
    assert said(make(production=True).get()) == (1200, "warm-cache", catalog.NOTES["warm-cache"]) and said(live) == (1200, "live", None)

    def refused():
        raise files.SourceError("rate-limited", "403")

    state["live"] = refused
    assert said(make(production=True).get())[1] == "warm-cache"
    # A live source that has lost most of its rows is held back by a gate.
    state["live"] = lambda: spark.range(20).toDF("id")
    assert said(make(gate=store.coverage_gate(least_rows=10)).get())[:2] == (1200, "warm-cache")
    state["live"] = lambda: spark.range(1300).toDF("id")
    assert said(make(gate=store.coverage_gate(least_rows=10)).get()) == (1300, "live", None) and said(live)[0] == 1200
