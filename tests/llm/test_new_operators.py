"""Conversation repair, toxicity and whitening against brute force, and on odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import conversations, toxicity, whitening

TURNS = "conv_id long, turn long, role string, text string, audit string"
BLANK = " \t\n\x0b\x0c\r"


def fits(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """All ways to edit, with at most two insertions at each place, by trying them."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    options = []
    for (_, role, _), mark in zip(rows, marks):
        more = 3 if mark == "truncated" else 0
        keep = [] if mark in ("blank", "duplicate") else [("K", role[:1] or "?", more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        options.append([*keep, ("D", "", 4)])
    for edits in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            said = "".join(g + e[1] for g, e in zip(gaps, edits)) + gaps[-1]
            cost = sum(e[2] for e in edits) + 3 * sum(map(len, gaps))
            if (best is None or cost <= best[0]) and fits(said):
                audit = "".join("I" * len(g) + e[0] for g, e in zip(gaps, edits)) + "I" * len(gaps[-1])
                found = (cost, audit, said)
                best = found if best is None else min(best, found)
    return best


def repaired(rows, audit, said):
    out, at, k = [], 0, 0
    for edit in audit:
        if edit == "I":
            out.append(f"{conversations.ROLES[said[k]]}:")
        elif edit != "D":
            out.append(f"{rows[at][1] if edit == 'K' else conversations.ROLES[said[k]]}:{rows[at][2]}")
        at, k = at + (edit != "I"), k + (edit != "D")
    return "\n".join(out)


def summary(rows, hold=cheapest):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marks = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] if a[1] and b[1] else "?" for a, b in zip(rows, rows[1:])]
    cost, audit, said = hold(rows, marks)
    text = repaired(rows, audit, said)
    return (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_repair_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(0, 4)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "s"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, rng.choice(["Yes.", "Yes.", "no", " \n", "", None, "Why? \t", "é", f"Turn {turn}!"]), "x"))
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.audit_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    want = {c: summary([r[1:4] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def forward(rows, marks):
    """A plain table over places and states: no settling, no bound."""
    table = {"": (0, "", "")}
    key = lambda e: e[:2]

    def close(table):
        for _ in range(3):
            for state, (cost, audit, said) in list(table.items()):
                for c in "ua":
                    if fits(said + c) or fits(said + c + "a"):
                        e = (cost + 3, audit + "I", said + c)
                        table[c] = min(table.get(c, e), e, key=key)
        return table

    table = close(table)
    for (_, role, _), mark in zip(rows, marks):
        new = {}
        for state, (cost, audit, said) in table.items():
            ways = [(state, (cost + 4, audit + "D", said))]
            if mark not in ("blank", "duplicate"):
                for e, c, price in [("K", role[:1], 0), ("R", "u", 3), ("R", "a", 3)]:
                    if c and (said + c == "s" or fits(said + c) or fits(said + c + "a")):
                        ways.append((c, (cost + price + 3 * (mark == "truncated"), audit + e, said + c)))
            for to, way in ways:
                new[to] = min(new.get(to, way), way, key=key)
        table = close(new)
    return min((e for s, e in table.items() if s in ("", "a")), key=key)


def test_repair_of_long_conversations(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system"] if rng.random() < 0.3 else [["user", "assistant"][t % 2]]), rng.choice([f"Line {t}.", f"Line {t % 7}.", "cut", "", "Odd 漢字!"]), "x") for c in range(6) for t in range(300)]
    rows += [(7, t, "user", "Same.", "x") for t in range(400)] + [(8, 3, "user", "Same.", "x")] * 300 + [(9, t, "system", f"x{t}.", "x") for t in range(300)]
    df = spark.createDataFrame(rows, TURNS)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.audit_conversations(df).collect()}
    assert got == {c: summary([r[1:4] for r in rows if r[0] == c], forward) for c in {r[0] for r in rows}}
    # The repaired turns spell the text of the hash, and give legal roles.
    turns = conversations.repaired_turns(df).orderBy("conv_id", "place").collect()
    for c, line in got.items():
        mine = [t for t in turns if t["conv_id"] == c]
        assert [t["place"] for t in mine] == list(range(1, len(mine) + 1)) and fits("".join(t["role"][0] for t in mine))
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in mine).encode()).hexdigest() == line[-1]
        assert "".join(t["edit"] for t in mine) == line[-2].replace("D", "")


def test_repair_query_on_damaged_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", None]), rng.choice(["A. B!", "Ça va?", "no", None, "x " * 5_000 + "."]), "x") for _ in range(100)]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    hurt = {r[0]: [] for r in rows}
    for conv, turn, role, text, _ in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if lot == 1 else "".join(c for c in text if c not in ".!?") if lot == 2 else text
        hurt[conv] += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.op11_repair(spark, str(tmp_path)).collect()}
    assert got == {c: summary(r, forward) for c, r in hurt.items()}
    assert conversations.audit_conversations(spark.createDataFrame([], TURNS)).count() == 0
    assert conversations.repaired_turns(spark.createDataFrame([], TURNS)).count() == 0


DOCS = "doc_id long, text string, lang string, score double, offences string"
CLEAN = ["The river runs quietly to the sea.", "Seven trains left the station on time.", "Prices rose a little in spring.", "She reads old maps by the window.", "Is the bridge open today?"]
RUDE = ["You miserable blockhead.", "What a rotten nitwit he is!", "Get lost, you blockhead and nitwit."]


def mixed(n, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        hot = rng.random() < 0.3
        lines = [rng.choice(CLEAN) for _ in range(rng.randrange(1, 12))] + [rng.choice(RUDE)] * hot
        rng.shuffle(lines)
        rows.append((i, " ".join(lines), "en", 0.5, "mine"))
        labels.append((i, int(hot if rng.random() > 0.02 else not hot)))
    return rows, labels


def test_toxicity_learns_from_document_labels(spark):
    rows, labels = mixed(600)
    docs, labelled = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labelled)
    scored = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    truth = {i: any(x in t for x in RUDE) for i, t, *_ in rows}
    assert np.mean([(scored[i]["score"] >= toxicity.TOXIC_FROM) == truth[i] for i in truth]) > 0.99
    # The sentences that it blames are the rude ones, at their places.
    found = toxicity.locate(docs, model).collect()
    text = {i: t for i, t, *_ in rows}
    assert all(r["sentence"] == text[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in found)
    assert {r["sentence"].strip() for r in found} == set(RUDE) and {r["doc_id"] for r in found} == {i for i, t in truth.items() if t}
    # Length alone makes nothing toxic; labels of held-out rows change nothing; a smaller sample still works.
    assert model.reader()(" ".join(CLEAN * 400))[2] < 0.2
    turned = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels], "doc_id long, toxic int")
    other = toxicity.train(docs, turned)
    assert other.index == model.index and np.array_equal(other.weight, model.weight)
    assert toxicity.train(docs, labelled, rows=100).leak > 0


def test_toxicity_gradient_and_noisy_or():
    """Scores by their definition, and weights where the loss is flat."""
    model = toxicity.Model({"=bad": 0, "^bad": 1, "=day": 2}, np.array([3.0, 1.0, -0.5]), -2.0, 0.1)
    where, each, whole = model.reader()("Bad day. Badly put! Fine\nEnd")
    assert [(a, b) for a, b in where] == [(0, 8), (8, 19), (19, 24), (25, 28)]
    z = np.array([1.0 - 2.0 + 1.0 + 1.0 + 0.5, 1.0 - 2.0, -2.0, -2.0])
    z[0] = 3.0 - 0.5 - 2.0
    p = np.array([*1 / (1 + np.exp(-z[:2])), 0.0, 0.0])
    assert each == pytest.approx(p) and whole == pytest.approx(1 - np.exp(-0.1) * np.prod(1 - p))


def test_toxicity_odd_rows(spark):
    rows, labels = mixed(80)
    odd = [(1, rows[1][1], "en", 0.1, "x"), (1000, None, None, None, None), (1001, "", "en", 1.0, "x"), (1002, " \n\n ", "en", 1.0, "x"), (None, RUDE[0], "en", 0.0, "x"), (1003, "nitwit " * 50_000, "en", 0.0, "x"), (1004, "... !! ?", "en", 0.0, "x"), (1005, "Ünïcödé 漢字 😀. " * 50, "de", 0.0, "x")]
    docs, labelled = spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame([*labels, (1, 1), (1, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labelled)
    got = toxicity.score_documents(docs, model)
    assert sorted(got.columns) == sorted(DOCS.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")) and got.count() == 88
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1000]["score"] == by[1001]["score"] == by[1002]["score"] and 0 <= by[1003]["score"] <= 1
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    for none in (toxicity.train(docs, labelled.limit(0)), toxicity.train(docs.limit(0), labelled), toxicity.train(docs, labelled.filter("toxic = 1"))):
        assert len({r["score"] for r in toxicity.score_documents(docs, none).select("score").collect()}) == 1


def brute_whitening(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64)) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    v = ((x - s / n).T @ (x - s / n)) / n
    e, u = np.linalg.eigh(v)
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x], ((x - s / n) @ u[:, ::-1] / np.sqrt(e[::-1])), e[::-1] / e.sum()


VECTORS = "vec_id long, embedding array<float>, whitened string, y int"


def test_whitening_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) + 3).astype(np.float32)
    vectors[7] = vectors[8]
    rows = [(i, [float(c) for c in v], "x", 1) for i, v in enumerate(vectors)]
    odd = [(900, None, "x", 1), (901, [None] + [0.0] * 39, "x", 1), (902, [float("nan")] * 40, "x", 1), (903, [float("inf")] * 40, "x", 1), (904, [], "x", 1), (905, [1.0] * 39, "x", 1)]
    df = spark.createDataFrame(rows + odd, VECTORS)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    n, deviation, whitened, explained = brute_whitening([r[1] for r in rows])
    got = whitening.op13_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 300 * 32 and {r["n"] for r in got} == {n} and {r["deviation"] for r in got if r["vec_id"] == 5} == {deviation[5]}
    table = np.zeros((300, 32))
    for r in got:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]] and r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    assert np.abs(np.abs(table) - np.abs(whitened[:, :32])).max() < 1e-7
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    out, _, _ = whitening.whiten_embeddings(df)
    assert sorted(out.columns) == ["deviation", "embedding", "vec_id", "whitened", "y"]


def test_whitening_odd_rows(spark):
    for rows in ([], [(1, None, "x", 1)], [(1, [1.0, 2.0], "x", 1)], [(1, [], "x", 1)], [(None, [1.0, 2.0], "x", 1)] * 5):
        out, model, error = whitening.whiten_embeddings(spark.createDataFrame(rows, VECTORS))
        assert len(model.eigenvalues) == 0 and error == 0.0
        assert out.count() == sum(r[1] is not None for r in rows) and all(r["whitened"] == [] for r in out.collect())
    # A dimension without variance and one that follows another have no component of their own.
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(a), 5.0, float(b)], "x", 1) for i, (a, b) in enumerate(rng.integers(-9, 9, (200, 2)))]
    out, model, error = whitening.whiten_embeddings(spark.createDataFrame(rows, VECTORS))
    assert len(model.eigenvalues) == 2 and error < 1e-9
    # Very large entries are held; deviations stay exact beyond 64 bits, and are null beyond 38 digits.
    out, model, error = whitening.whiten_embeddings(spark.createDataFrame([(1, [1e30], "x", 1), (2, [1e8], "x", 1), (3, [-3.0], "x", 1)], VECTORS))
    y = [2**52, 6_400_000_000, -192]
    want = [sum((3 * v - sum(y)) ** 2 for v in [x]) for x in y]
    assert [int(r["deviation"]) for r in out.orderBy("vec_id").select(F.col("deviation").cast("string").alias("deviation")).collect()] == want


def test_pii_hosts_of_many_labels(spark):
    """A host of a million labels is no address and harms nobody; addresses beside it are found."""
    from spindrift.llm import pii

    for labels in (1_500, 1_000_000):
        text = "see a@" + ".".join("a" * labels) + " and jo@mail.example.com.\n" + "@".join("b" * 5_000)
        (got,) = pii.replace_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"), "key", count="n").collect()
        assert got["n"] == 1 and "jo@mail" not in got["text"] and got["text"].startswith(text[: text.index(" and")])
    (got,) = pii.replace_pii(spark.createDataFrame([(1, "x@a." + "ab." * 120 + "com, y@b.co.123")], "doc_id long, text string"), "key", count="n").collect()
    assert got["n"] == 2 and got["text"].endswith(".123")


def test_quality_stage_keeps_a_score_of_the_caller(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(200)], "doc_id long, quality int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, "Plain words here. " * 30 if i % 5 else "!! ## @@ " * 30, "en", 0.123, None) for i in range(200)], DOCS)
    kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {0.123} and {r["doc_id"] % 5 > 0 for r in kept.collect()} == {True}
