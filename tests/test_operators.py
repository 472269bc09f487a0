import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import calls, gates, manifest, scoring, similarity, validate
from sievework.sources import files, sinks
from sievework.streaming import events as stream


def key(t):
    return " ".join(t.split()).casefold()


def score(a, b):
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)} or ({t} if t else set())
    x, y = grams(key(a)), grams(key(b))
    return len(x & y) / len(x | y) if x | y else 1.0


def corpus(seed, n):
    rng = random.Random(seed)
    words = "anchor lists each leaked squid claim to of code kd-6327 and plain yarrow message".split()
    texts = ["", " ", "ab", "AB", "abcde"]
    while len(texts) < n:
        if len(texts) > 9 and rng.random() < 0.6:
            t = list(rng.choice(texts[5:]))
            for _ in range(rng.choice([0, 1, 2, 4])):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.choice([0, 1, 3])] = rng.choice(["x", "", " y "])
            texts.append("".join(t))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.choice([1, 3, 12, 50]))))
    return texts


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"i{k:03}", t, random.Random(k).choice(["bipia_text", "mcptox_t1"])) for k, t in enumerate(corpus(1, 220))]
    return rows, spark.createDataFrame(rows, "id string, text string, family string").repartition(5)


def test_pairs(items):
    rows, df = items
    want = {(a[0], b[0]): s for a in rows for b in rows if a[0] < b[0] if (s := score(a[1], b[1])) >= 0.85}
    pairs = similarity.self_pairs(df, "id", X.collapse(F.col("text")))
    got = {(r.id_a, r.id_b): r.score for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = [(r.id_a, r.id_b) for r in similarity.closest(pairs).collect()]
    assert top == sorted(want, key=lambda k: (-want[k], k))[:5]
    held = F.col("family") == "bipia_text"
    family = {r[0]: r[2] for r in rows}
    cross = {(r.left_id, r.right_id) for r in similarity.cross_pairs(df.where(held), df.where(~held), "id", X.collapse(F.col("text"))).collect()}
    assert cross == {(a, b) if family[a] == "bipia_text" else (b, a) for a, b in want if family[a] != family[b]}


def rearranged(seed, n):
    """Texts with values that swap their places between equal words, and with doubled words."""
    rng = random.Random(seed)
    words = "bread lamp crane violet ledger gasket meadow walnut ribbon cactus spindle orchard".split()
    texts = ["please send the key to bob at once. then kindly send the log to amy by the end of day", "please send the log to bob at once. then kindly send the key to amy by the end of day"]
    for _ in range(n):
        values = rng.sample(words, 4)
        other = values[::-1] if rng.random() < 0.5 else [values[1], values[0], *values[2:]]
        form = " and then ".join(f"we {rng.choice(words)} sort the {{}} for the {rng.choice(words)}" for _ in values)
        texts += [form.format(*values), form.format(*other)]
        doubled = form.format(*values).split()
        k = rng.randrange(len(doubled))
        texts.append(" ".join(doubled[: k + 1] + doubled[k:]))
    return texts


def test_pairs_of_rearranged_texts(spark):
    rows = [(f"r{k:03}", t, "bipia_text" if k % 2 else "mcptox_t1") for k, t in enumerate(rearranged(3, 40))]
    df = spark.createDataFrame(rows, "id string, text string, family string")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and score(a[1], b[1]) >= 0.85}
    assert ("r000", "r001") in want
    assert {(r.id_a, r.id_b) for r in similarity.self_pairs(df, "id", X.collapse(F.col("text"))).collect()} == want
    held = F.col("family") == "bipia_text"
    cross = {tuple(sorted((r.left_id, r.right_id))) for r in similarity.cross_pairs(df.where(held), df.where(~held), "id", X.collapse(F.col("text"))).collect()}
    assert cross == {p for p in want if (int(p[0][1:]) - int(p[1][1:])) % 2}


def test_greedy(items):
    rows, df = items
    kept, want = [], {}
    for i, t, f in sorted(rows, key=lambda r: (r[2] != "bipia_text", r[0])):
        twin = next((k for k, u in kept if key(u) == key(t)), None)
        near = twin or next((k for k, u in kept if score(u, t) >= 0.85), None)
        want[i] = (near is None, None if near is None else "exact" if twin else "near", near)
        if near is None:
            kept.append((i, t))
    got = {r.id: (r.kept, r.reason, r.of) for r in similarity.greedy(df, X.collapse(F.col("text")), F.col("family") == "bipia_text").collect()}
    assert got == want


def test_empty_tables(items):
    _, df = items
    none = df.limit(0)
    assert similarity.self_pairs(none, "id", F.col("text")).count() == 0 and similarity.greedy(none, F.col("text"), F.lit(True)).count() == 0


def test_kill_rule(spark):
    def run(families, fp=(6, 200)):
        f = spark.createDataFrame([(f"f{k}", *c) for k, c in enumerate(families)], "family string, hits long, total long")
        return gates.kill_rule(f, spark.createDataFrame([fp], "hits long, total long")).first()

    r = run([(8, 10), (14, 20), (10, 10), (18, 19)])
    assert r.passed and r.floor_failures == []
    r = run([(9, 10), (7, 10), (10, 10), (6, 19)])
    assert not r.average_pass and r.floor_pass and round(r.average, 4) == 0.7289
    assert run([(13, 20), (10, 10), (10, 10), (10, 10)]).floor_failures == ["f0"]
    assert run([(8, 10)] * 4).average_pass and not run([(8, 10)] * 4, (7, 200)).fp_pass
    for families, fp in (([(8, 10)] * 3, (6, 200)), ([(8, 10)] * 4, (6, 199)), ([(8, 10)] * 3 + [(0, 0)], (6, 200))):
        with pytest.raises(Exception, match="gate needs"):
            run(families, fp)


def test_scoring(spark):
    rows = [("a", "f", "c", "attack", "h", v) for v in ("attack", "benign", "error", "unsure")] + [("b", "q", "c", "benign", "h", v) for v in ("attack", "benign", "error", "unsure")]
    df = spark.createDataFrame(rows, "id string, family string, channel string, label string, author string, verdict string")
    assert scoring.counts_by(df, "attack", F.col("family")).first()[1:] == (1, 4) and scoring.counts_by(df, "benign", F.col("family")).first()[1:] == (2, 4)
    got = {r.label: (r.primary, r.secondary, r.adr35) for r in scoring.conventions(scoring.verdict_cells(df, "label")).collect()}
    assert got == {"benign": (3, 2, 3), "attack": (2, 1, 1)}
    for errors, n, valid in ((0, 100, True), (1, 100, True), (2, 200, True), (2, 100, False), (3, 200, False)):
        rows = [("error",)] * errors + [("attack",)] * (n - errors)
        assert scoring.error_stats(spark.createDataFrame(rows, "verdict string")).first().valid == valid


def test_order_dependent(spark):
    events = [("r", k, "error" if k in (2, 5, 6, 7, 9) else "attack") for k in range(1, 12)]
    df = spark.createDataFrame(events, "run string, seq int, verdict string")
    out = calls.circuit_break(df, "run", [F.col("seq")], F.col("verdict") == "error")
    assert sorted(r.seq for r in out.where("stopped").collect()) == [8, 9, 10, 11]
    assert calls.within_budget(df, "run", [F.col("seq")], F.lit(True), 4).where("blocked").count() == 7
    assert sorted(r.done for r in calls.progress_marks(df, "run", [F.col("seq")], 5).collect()) == [5, 10, 11]
    pool = spark.createDataFrame([(f"{g}{k}", g) for g, n in (("a", 9), ("b", 2), ("c", 9)) for k in range(n)], "id string, family string")
    sizes = {r.family: r["count"] for r in calls.quota_sample(pool, 11, "family", "s").groupBy("family").count().collect()}
    assert sizes == {"a": 4, "b": 2, "c": 3}
    dup = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "id string, line int")
    assert [tuple(r) for r in validate.duplicate_ids(dup, "id", "line").collect()] == [("a", 3, 1)] and validate.first_rows(dup, "id", "line").count() == 2


def test_classify_and_cache(spark):
    def stub(t):
        if t == "boom":
            raise ValueError("no")
        return ("attack", None) if "x" in t else ("benign", None)

    df = spark.createDataFrame([("1", "ax"), ("2", "b"), ("3", "boom"), ("4", "cx")], "key string, text string")
    cache = spark.createDataFrame([("4", "benign")], "key string, verdict string")
    got = {r.key: (r.verdict, r.cached) for r in calls.with_cache(df, cache, stub).collect()}
    assert got == {"1": ("attack", False), "2": ("benign", False), "3": ("error", False), "4": ("benign", True)}
    for workers in (1, 3):
        assert {r.key: r.error for r in calls.classify(df, stub, workers=workers).collect()}["3"] == "ValueError: no"


def test_manifest_and_overlap(spark):
    rows = [(f"i{k}", "s", "mcptox_t3" if k % 2 else "x", "c", "attack", f"text {k}", "") for k in range(6)]
    df = spark.createDataFrame(rows, files.ITEM)
    fresh = manifest.manifest(df)
    stored = fresh.where("id <> 'i0'").withColumn("sha256", F.when(F.col("id") == "i1", "0").otherwise(F.col("sha256"))).withColumn("label", F.when(F.col("id") == "i2", "benign").otherwise(F.col("label")))
    stored = stored.unionByName(fresh.where("id = 'i5'").withColumn("id", F.lit("i9")))
    got = {r.id: r.problem for r in manifest.differences(stored, fresh).collect()}
    assert got == {"i0": "extra", "i1": "text changed", "i2": "attributes changed", "i9": "missing"}
    assert manifest.first_problems(manifest.differences(stored, fresh), 2) == ([("attributes changed", "i2"), ("extra", "i0")], 4)
    assert manifest.differences(fresh, fresh).count() == 0
    attacks = spark.createDataFrame([("b", "x" * 10 + "the quick brown fox jumps over the lazy dog", 1), ("a", "THE quick brown fox jumps over the lazy", 2), ("s", "tiny", 3)], "id string, text string, place int")
    texts = spark.createDataFrame([("1", "so the quick  brown fox jumps over the moon"), ("2", "nothing of that sort stands in here at all"), ("3", "Tiny"), ("4", "")], "id string, text string")
    assert {tuple(r) for r in validate.window_overlap(texts, attacks).collect()} == {("1", "b"), ("3", "s")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"S_0_1": {"paradigm": "Template-3", "tool_content": "x"}, "S_0_2": {"paradigm": "Template-1", "tool_content": "y"}}]')
    assert {(r.id, r.family) for r in files.template_collection(spark, str(tmp_path / "t.json")).collect()} == {("mcptox/S_0_1", "mcptox_t3"), ("mcptox/S_0_2", "mcptox_t1")}
    (tmp_path / "u.json").write_text('[{"S": {"paradigm": "other", "tool_content": "x"}}]')
    with pytest.raises(Exception, match="unknown paradigm"):
        files.template_collection(spark, str(tmp_path / "u.json")).collect()
    with pytest.raises(files.LoadError):
        files.template_collection(spark, str(tmp_path / "none.json"))
    for k in ("code", "text"):
        for s in ("train", "test"):
            (tmp_path / f"{k}_attack_{s}.json").write_text('{"Base": ["a", "b"], "Other": ["c"]}')
    got = files.category_collection(spark, str(tmp_path))
    assert got.count() == 12 and "bipia/text/test/Base/1" in {r.id for r in got.collect()} and files.repeated_ids(got).count() == 0
    for v in files.VARIANTS:
        (tmp_path / f"test_cases_{v}.json").write_text('[{"Tool Response": "r", "x": 1}, {"Tool Response": "s"}]')
    assert files.record_collection(spark, str(tmp_path)).count() == 8
    (tmp_path / "l.jsonl").write_bytes('{"id": "a", "n": 1}\r\n\n{"id": "b ", "n": 2}\n{"id": "to'.encode())
    lines = files.json_lines(spark, str(tmp_path / "l.jsonl")).orderBy("line_no").collect()
    assert [r.line_no for r in lines] == [1, 3, 4]
    assert files.tolerant_lines(spark, str(tmp_path / "l.jsonl"), "id string, n int", "id").count() == 2
    assert files.strict_lines(spark, str(tmp_path / "no.jsonl"), "id string").count() == 0
    with pytest.raises(Exception):
        files.strict_lines(spark, str(tmp_path / "l.jsonl"), "id string, n int").collect()
    (tmp_path / "raw.bin").write_bytes(b"hello\n")
    pins = spark.createDataFrame([("raw.bin", "ce013625030ba8dba906f756967f9e9ca394464a")], "name string, blob_sha string")
    assert files.verified_files(spark, [str(tmp_path / "raw.bin")], pins).first().verified
    outcomes = spark.createDataFrame([("a", "attack", None, "r1", 2), ("b", "error", "bad", "r2", 1)], "id string, verdict string, error string, raw string, place int")
    sinks.write_run(outcomes, str(tmp_path / "run"))
    assert "raw" not in spark.read.json(str(tmp_path / "run/events")).columns and spark.read.json(str(tmp_path / "run/errors")).count() == 1
    sinks.write_results(outcomes, str(tmp_path / "results"))
    assert {r.id for r in spark.read.json(str(tmp_path / "results")).collect()} == {"a", "b"}
    names = [sinks.write_report("R", {"t": outcomes.select("id")}, str(tmp_path / "r.md")) for _ in range(2)]
    assert names[1].endswith("r-2.md") and "| a |" in open(names[0]).read()


def test_validators(spark):
    lines = spark.createDataFrame([(1, '{"a": 1, "z": 2}'), (2, "[1]"), (3, '{"a": 1, "b": 2}')], "line_no int, line string")
    assert [tuple(r) for r in validate.key_problems(lines, "line", ("a", "b")).orderBy("line_no", "problem").collect()] == [(1, "missing field 'b'"), (1, "unknown field 'z'"), (2, "row is not a JSON object")]
    df = spark.createDataFrame([("x", "one"), ("y", "w " * 30)], "clause_position string, text string").union(spark.createDataFrame([("start", "w")], "clause_position string, text string"))
    assert [tuple(r) for r in validate.bucket_crosstab(df).orderBy("bucket").collect()] == [("long", 0, 0, 0, 0), ("medium", 0, 0, 0, 0), ("short", 1, 0, 0, 0)]
    assert [(r.value, r["count"]) for r in validate.zero_filled(df, "clause_position", ("end", "start")).orderBy("place").collect()] == [("end", 0), ("start", 1)]


def test_streams(spark, tmp_path):
    rows = [("r1", "a", "attack", "2026-01-01 00:10:00"), ("r1", "b", "error", "2026-01-01 00:50:00"), ("r1", "b", "error", "2026-01-01 00:50:00"), ("r2", "a", "benign", "2026-01-01 02:10:00")]
    df = spark.createDataFrame(rows, "run_id string, id string, verdict string, t string").withColumn("logged_at", F.col("t").cast("timestamp")).drop("t")
    df.write.json(str(tmp_path / "in"))
    got = []
    stream.keep_counters(stream.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda b, n: got.extend(tuple(r) for r in b.collect())).awaitTermination(60)
    assert sorted(got) == [("r1", 3, 2, 0), ("r2", 1, 0, 0)]
    q = stream.window_counts(stream.once(stream.event_stream(spark, str(tmp_path / "in")))).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.exception() is None
