"""The stages on a small corpus with known good and bad documents."""

import numpy as np
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeionrstlhd"), rng.integers(2, 8))) for _ in range(300)]
    prose = lambda n: ". ".join(" ".join(rng.choice(words, 12)).capitalize() for _ in range(n)) + "."
    good = [prose(int(rng.integers(3, 12))) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(words, 40)) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(good + bad)]
    near = good[0].split(" ")
    near[5] = "changed"
    docs += [(500, good[1]), (501, " ".join(near)), (502, good[2] + "\n" + prose(3)), (503, "Mail someone@host.example.org, " + prose(4))]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["quality"] >= set(range(120)) and not ids["quality"] & set(range(120, 180))
    assert 500 not in ids["line_dedup"] and ids["line_dedup"] >= {501, 502, 503}
    assert 501 not in ids["near_dedup"] and ids["near_dedup"] >= set(range(120)) | {502, 503}
    texts = {r["doc_id"]: r for r in seen["pii"].collect()}
    assert "someone@host" not in texts[503]["text"] and texts[503]["text"].startswith("Mail ") and "\n" not in texts[502]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    assert ids["packing"] == ids["pii"]


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100
