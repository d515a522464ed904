import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.functions import vectors as V
from lodestream.operators import faults, knn, kv, metrics
from lodestream.sources import files


def test_gate_learns_in_order(spark):
    """Records by hand: what a signal fired before, and the truth one checkpoint later."""
    rng = random.Random(1)
    rows, want = [], {}
    for sensor in range(40):
        hits, misses, before = dict.fromkeys(faults.SIGNALS, 0), dict.fromkeys(faults.SIGNALS, 0), []
        for cp in range(rng.randint(1, 30)):
            fired, truth = rng.sample(faults.SIGNALS, rng.randint(0, 4)), rng.random() < 0.3
            for s in before:
                (hits if truth else misses)[s] += 1
            want[sensor, cp] = any(s in faults.TRIGGERS and faults.allowed(hits[s], misses[s]) for s in fired)
            before = fired
            rows.append((sensor, cp, fired, int(truth), 0.5, True))
    scored = spark.createDataFrame(rows, "sensor bigint, cp bigint, fired array<string>, has_anomaly int, probability double, predicted boolean").repartition(5)
    assert {(r.sensor, r.cp): r.predicted for r in faults.gated(scored).collect()} == want and len(set(want.values())) == 2
    record = {(r.sensor, r.signal): (r.hits, r.misses) for r in faults.explain(scored).collect()}
    assert record[39, "overdue"] == (hits["overdue"], misses["overdue"]) and len(record) == 40 * len(faults.SIGNALS)


def by_hand(commands):
    out = []
    for op, n, v in commands:
        if op == "rpush":
            out.append(v)
        elif op == "lpush":
            out.insert(0, v)
        elif op == "rpop":
            out = out[:-1]
        elif op == "lpop":
            out = out[1:]
        elif op == "set" and -len(out) <= n < len(out):
            out[n] = v
        elif op == "rem":
            for _ in range(abs(n) or len(out)):
                if v in out:
                    del out[out.index(v) if n >= 0 else len(out) - 1 - out[::-1].index(v)]
        elif op == "trim":
            out = out[max(0, len(out) + n) if n < 0 else n : 6]
        elif op in ("before", "after") and "a" in out:
            out.insert(out.index("a") + (op == "after"), v)
    return out


def test_list_commands(spark):
    rng = random.Random(7)
    ops = ["rpush", "lpush", "rpush", "rpop", "lpop", "rem", "set", "trim", "before", "after"]
    logs = [[(rng.choice(ops), rng.randint(-3, 3), rng.choice("abc")) for _ in range(rng.randint(0, 40))] for _ in range(150)]
    rows = [(key, seq, op, n, 5, "a", v) for key, log in enumerate(logs) for seq, (op, n, v) in enumerate(log)]
    found = kv.replay_lists(spark.createDataFrame(rows, "key bigint, seq bigint, op string, arg int, stop int, pivot string, value string").repartition(4))
    got = {}
    for r in found.orderBy("key", "pos").collect():
        got.setdefault(r.key, []).append(r.value)
        assert r.pos == len(got[r.key]) - 1
    assert got == {k: by_hand(log) for k, log in enumerate(logs) if by_hand(log)}


def test_set_with_flags_and_expiry(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for key in range(100):
        value = expires = None
        for seq in range(12):
            flag, ttl = rng.choice(["", "nx", "xx"]), rng.choice([None, 2, 5])
            alive = value is not None and (expires is None or expires > seq)
            if flag == "" or (flag == "nx") != alive:
                value, expires = str(seq), None if ttl is None else seq + ttl
            elif not alive:
                value = expires = None
            rows.append((key, seq, seq, flag, str(seq), ttl))
        want[key] = value, expires
    log = spark.createDataFrame(rows, "key bigint, seq bigint, at bigint, flag string, value string, ttl bigint")
    assert {r.key: (r.value, r.expires) for r in kv.set_replay(log.repartition(3)).collect()} == want
    few = spark.createDataFrame([("a", 1, "xx", "1"), ("b", 1, "nx", "1"), ("b", 2, "nx", "2"), ("b", 3, "xx", "3"), ("c", 1, "nx", "1"), ("c", 2, "", "2")], "key string, seq int, flag string, value string")
    assert sorted(tuple(r) for r in kv.set_if(few).collect()) == [("b", "3"), ("c", "2")]


def test_hash_slots(spark):
    """Known slots of the cluster specification's hash."""
    df = spark.createDataFrame([("123456789", 12739), ("", 0), ("foo", 12182), ("{foo}bar", 12182), ("x{foo}{bar}", 12182), ("{}foo", None), ("{a", None), (None, 0)], "key string, slot int")
    for r in df.select("key", "slot", kv.hash_slot(F.col("key")).alias("got")).collect():
        assert 0 <= r.got < 16384 and (r.slot is None or r.got == r.slot)


def test_scores_and_expiries(spark):
    z = spark.createDataFrame([("k", m, s) for m, s in (("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", float("-inf")), ("e", float("inf")))], "key string, member string, score double")
    names = lambda df: [r.member for r in df.orderBy("score", "member").collect()]
    assert names(kv.by_score(z)) == ["d", "a", "b", "c", "e"] and names(kv.by_score(z, low=1, open_low=True)) == ["c", "e"]
    assert names(kv.by_score(z, high=2, open_high=True, offset=1, count=1)) == ["a"] and names(kv.by_score(z, 1, 2, offset=2)) == ["c"]
    assert names(kv.by_rank(z, -2, -1)) == ["c", "e"] and names(kv.by_rank(z, 0, 0, reverse=True)) == ["e"] and names(kv.by_rank(z, 3, 1)) == []
    log = spark.createDataFrame([("a", 1, "expire", 0, 3), ("a", 2, "set", 0, 0), ("b", 1, "pexpire", 5, 7), ("c", 1, "expireat", 0, 9), ("c", 2, "persist", 0, 0), ("d", 1, "expireat", 0, 9)], "key string, seq int, op string, at bigint, arg bigint")
    assert {r.key: r.expires for r in kv.expiries(log).collect()} == {"a": None, "b": 12, "c": None, "d": 9000}
    assert kv.drawn(z, 2).count() == 2 and kv.drawn(z, 9).count() == 5 and kv.drawn(z.limit(0), 2).count() == 0


@pytest.mark.parametrize("pattern,yes,no", [("a*", ["a", "abc"], ["ba"]), ("h?llo", ["hallo"], ["hllo"]), ("x[ab]", ["xa"], ["xc"]), ("p\\*", ["p*"], ["pq"]), ("a.c", ["a.c"], ["abc"])])
def test_glob(spark, pattern, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "key string")
    assert sorted(r.key for r in kv.scan(df, "key", pattern).collect()) == sorted(yes)


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1", "ip", "int8", "hamming"])
def test_knn_over_blocks(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 7)
    monkeypatch.setattr(knn, "ROWS", 13)
    monkeypatch.setattr(knn, "SLICE", 3)
    rng = np.random.default_rng(3)
    data = np.round(rng.uniform(-1, 1, (60, 8)), 3)
    data[7] = data[11]
    data[5] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in knn.knn(df.filter("vec_id % 3 = 0"), df, 5, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    def distance(a, b):
        if metric == "int8":
            a, b = (np.clip(np.trunc((x + 1) / (2 / 255) - 128), -128, 127) for x in (a, b))
        if metric in ("cosine", "int8"):
            n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            return 1 - (a * b).sum() / n if n else 1.0
        return {"l2": lambda: np.sqrt(((a - b) ** 2).sum()), "l1": lambda: abs(a - b).sum(), "ip": lambda: -(a * b).sum(), "hamming": lambda: ((a > 0) != (b > 0)).sum()}[metric]()

    d = np.round([[distance(a, b) for b in data] for a in data[::3]], 6)
    for k, q in enumerate(range(0, 60, 3)):
        assert got[q] == sorted(range(60), key=lambda j: (d[k, j], j))[:5]


def test_knn_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert knn.knn(df, df, 0).count() == 0
    assert knn.knn(df, df, 9).count() == 4
    assert knn.knn(df.limit(0), df, 3).count() == 0
    for k in (-1, 4097):
        with pytest.raises(ValueError):
            knn.knn(df, df, k)


def test_index(spark, monkeypatch):
    """Clustered vectors: few lists give nearly all neighbours; all lists give exactly them; blocks don't matter."""
    monkeypatch.setattr(knn, "ROWS", 50)
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(12, 16))[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 16))).round(4)
    data[3] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>")
    queries, index = df.filter("vec_id % 20 = 0"), knn.build_index(df, 12, sample=400)
    exact = knn.knn(queries, df, 10)
    assert index[1].count() == 900 and knn.recall(knn.search_index(index, queries, 10, 3), exact).first().recall >= 0.9
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(knn.search_index(index, queries, 10, 12)) == rows(exact)
    few = df.select("vec_id").filter("vec_id < 30")
    assert rows(knn.within(queries, df, few, 4)) == rows(knn.knn(queries, df.filter("vec_id < 30"), 4))
    assert knn.search_index(knn.build_index(df.limit(0), 4), queries, 3).count() == 0


def test_vector_texts(spark):
    row = spark.createDataFrame([("[1.5, -2]", "[1, x]", None, [1, -129], "0fA0")], "a string, b string, c string, i array<int>, h string")
    got = row.select(V.from_text(F.col("a")).alias("a"), V.from_text(F.col("b")).alias("b"), V.from_text(F.col("c")).alias("c"), V.int8(F.col("i")).alias("i"), V.bits(F.col("h")).alias("h"), V.kind(F.col("i"), "tinyint").alias("k")).first()
    assert (got.a, got.b, got.c, got.i, got.h, got.k) == ([1.5, -2.0], None, None, None, [15, 160], "int8")
    values = np.array([0.0, 1.0, -0.1, 65504.0, 3.1e-5, 1e-8, 0.333333, 2049.0, 2051.0])
    half = spark.createDataFrame([(values.tolist(),)], "v array<double>").select(V.half(F.col("v")).alias("h")).first().h
    assert half == values.astype(np.float16).astype(float).tolist()
    with pytest.raises(ValueError):
        V.slice_bits(F.col("h"), 0, 12)


def test_vectors(spark):
    row = spark.range(1).select(
        F.array(F.lit(0.0), F.lit(0.0)).alias("z"), F.array(F.lit(3.0), F.lit(4.0)).alias("a"), F.array(F.lit(-1.0), F.lit(1.0), F.lit(float("nan")), F.lit(0.0)).alias("q")
    )
    got = row.select(V.cosine_distance(F.col("z"), F.col("a")).alias("c"), V.normalize(F.col("a")).alias("n"), V.normalize(F.col("z")).alias("nz"), V.quantize_int8(F.col("q")).alias("i"), V.slice_of(F.col("q"), 0, 2).alias("s")).first()
    assert got.c is None and got.n == [0.6, 0.8] and got.nz == [0.0, 0.0] and got.i == [-128, 127, 127, 0] and got.s == [-1.0, 1.0]
    with pytest.raises(ValueError):
        V.slice_of(F.col("q"), 2, 2)


def test_answers(spark):
    df = spark.createDataFrame([("The cat, a cat!", "cat cat", 1.0, True), ("", "", 1.0, False), ("dog", "", 0.0, False), ("an old dog", "old cat", 0.5, False)], "p string, g string, f1 double, inside boolean")
    p, g = X.answer_tokens(F.col("p")), X.answer_tokens(F.col("g"))
    for r in df.select("f1", "inside", X.token_f1(p, g).alias("got"), X.contains_tokens(p, g).alias("c"), (p == g).alias("em")).collect():
        assert r.got == pytest.approx(r.f1) and r.c == r.inside and (not r.em or r.got == 1.0)


def test_bootstrap_holds_the_mean(spark):
    random.seed(5)
    df = spark.createDataFrame([(i, "k", random.gauss(10, 2)) for i in range(400)], "row_id bigint, key string, x double")
    got = metrics.bootstrap_mean(df, "key", "x", 200).first()
    assert got.low < got.mean < got.high and got.high - got.low < 1.0
    again = metrics.bootstrap_mean(df.repartition(5), "key", "x", 200).first()
    assert again.low == pytest.approx(got.low) and again.high == pytest.approx(got.high)


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"metadata": {"seed": 1}, "readings": [{"minute": 0, "temp_c": 20.5}, {"minute": 1, "temp_c": 30.0, "status_code": "FAULT"}]}')
    assert [r.status_code for r in files.sensor_dataset(spark, str(tmp_path / "d.json")).orderBy("minute").collect()] == ["OK", "FAULT"]
    vectors = np.arange(6, dtype="<f4").reshape(2, 3)
    buffer = io.BytesIO()
    np.save(buffer, vectors)
    (tmp_path / "v.npy").write_bytes(buffer.getvalue())
    assert [r.vector for r in files.npy(spark, str(tmp_path / "v.npy")).orderBy("row").collect()] == vectors.tolist()
    (tmp_path / "m.bin").write_bytes(b"\0\0\0\2\0\0\0\3" + vectors.astype(">f4").tobytes())
    assert [r.vector for r in files.matrices(spark, str(tmp_path / "m.bin")).orderBy("row").collect()] == vectors.tolist()
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"n": 3}')
    (tmp_path / "r" / "b.json").write_text("{not json")
    assert [r.n for r in files.results(spark, str(tmp_path / "r"), "n int").collect()] == [3]
    spark.createDataFrame([(" q ", "a"), ("", "b")], "query string, passage string").write.parquet(str(tmp_path / "p"))
    assert [tuple(r) for r in files.pairs(spark, str(tmp_path / "p")).collect()] == [("q", "a")]
    state = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "c", False), (1, "", True), (3, "d", False)], "id int, v string, _deleted boolean")
    assert sorted(tuple(r) for r in files.upsert(state, changes, "id").collect()) == [(2, "c"), (3, "d")]
    twice = changes.withColumn("seq", F.lit(1)).union(spark.createDataFrame([(2, "e", False, 2), (3, "", True, 2)], "id int, v string, _deleted boolean, seq int"))
    assert sorted(tuple(r) for r in files.upsert(state, twice, "id", "seq").collect()) == [(2, "e")]
    (tmp_path / "passages.jsonl").write_text('{"_id": "p1", "text": "one"}\n{"_id": "p2"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "who", "gold": ["p1"], "short_answers": null}\n')
    assert [tuple(r) for r in files.passages(spark, str(tmp_path / "passages.jsonl")).collect()] == [("p1", "one"), ("p2", None)]
    assert [tuple(r) for r in files.rag_queries(spark, str(tmp_path / "queries.jsonl")).collect()] == [("q1", "who", ["p1"], None)]
    files.write_csv(state.orderBy("id"), str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == [("1", "a"), ("2", "b")]
    assert files.tex(spark.createDataFrame([(1, "a_b & 5%")], "id int, v string")).splitlines()[3] == r"1 & a\_b \& 5\% \\"
    assert files.markdown(state.orderBy("id")).splitlines()[2] == "| 1 | a |"


def test_snapshot_needs_its_marker(spark, tmp_path):
    """A save that fails half way leaves no version, and none that was there is harmed."""
    path = str(tmp_path / "snap")
    one = spark.createDataFrame([(1,)], "x int")
    files.save_snapshot({"a": one, "b": one}, path, 1)
    broken = one.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        files.save_snapshot({"a": one.union(one), "b": broken}, path, 2)
    with pytest.raises(Exception):  # noqa: B017
        files.load_snapshot(spark, path, 2)
    with pytest.raises(Exception, match="no"):
        files.save_snapshot({"a": one.union(one), "b": broken}, path, 1)
    assert {n: df.count() for n, df in files.load_snapshot(spark, path, 1).items()} == {"a": 1, "b": 1}


def test_published_files(spark, tmp_path):
    from lodestream.streaming import sensor as stream

    spark.createDataFrame([(1, 2), (3, 4)], "a int, b int").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("a int, b int").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing new
        stream.publish(live, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2), (3, 4)]


def test_scripts(spark):
    from lodestream.operators.scripts import Scripts

    scripts, t = Scripts(spark), spark.createDataFrame([(1,), (5,)], "x int")
    digest = scripts.load("SELECT x + :y AS z FROM {t} WHERE x > 2")
    assert scripts.exists(digest, "0" * 40) == [True, False] and [r.z for r in scripts.evalsha(digest.upper(), {"y": 2}, t=t).collect()] == [7]
    assert [r.x for r in scripts.eval("SELECT max(x) AS x FROM {t}", t=t).collect()] == [5]
    scripts.flush()
    with pytest.raises(KeyError):
        scripts.evalsha(digest)


def test_paired_results_must_match(spark):
    a = spark.createDataFrame([("q1", 1.0), ("q2", 2.0)], "qid string, value double")
    assert sorted(tuple(r) for r in metrics.paired(a, a).collect()) == [("q1", 1.0, 1.0), ("q2", 2.0, 2.0)]
    for b in (a.filter("qid = 'q1'"), a.union(a)):
        with pytest.raises(Exception, match="results differ"):
            metrics.paired(a, b).collect()


def test_numbers_over_ranges(spark):
    from lodestream.operators import memory

    df = spark.createDataFrame([(k % 2, 37 * k) for k in range(200)], "g int, id bigint").repartition(5)
    got = {(r.g, r.id): r.number for r in memory.numbered(df, "id", ("g",), width=500).collect()}
    assert got == {(g, 37 * k): n for g in (0, 1) for n, k in enumerate(range(g, 200, 2))}
    assert [r.number for r in memory.numbered(df.filter("id < 333"), "id", width=10).orderBy("id").collect()] == list(range(9))


def test_precursor_match(spark):
    """Per checkpoint the 3 nearest of the windows before the last 8 faults, within 0.35, by hand."""
    import math

    from lodestream.operators import faults as T
    from lodestream.operators import sensor as S

    rng = random.Random(3)
    data = [(s, 3 * i, rng.choice([30, 120, 210, 270, 300]) + rng.randrange(9), rng.choice(["OK"] * 5 + ["FAULT"]) if s else "OK", i + 1) for s in (0, 1, 2) for i in range(240)]
    r = spark.createDataFrame(data, "sensor bigint, minute bigint, t10 bigint, status string, seq bigint")

    def vector(ts):
        unit = lambda x: max(-1.0, min(1.0, x))
        return [unit((max(ts) / 10 - 20) / 20), unit((sum(ts) / len(ts) / 10 - 20) / 20), unit((ts[-1] - ts[0]) / 10 / len(ts) / 2), float(max(ts) > 280 or min(ts) < 50)]

    def distance(a, b):
        n = math.hypot(*a) * math.hypot(*b)
        return 1 - sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 1.0

    want = {}
    for s in (0, 1, 2):
        own = [x for x in data if x[0] == s]
        for cp in range(12):
            faults = [x for x in own[: 20 * cp + 20] if x[3] == "FAULT"][-8:]
            before = [[y[2] for y in own if f[1] - 40 <= y[1] <= f[1] - 20] for f in faults]
            q = vector([x[2] for x in own[20 * cp : 20 * cp + 20]])
            near = min(3, sum(round(distance(q, vector(b)), 6) <= 0.35 for b in before if b))
            want[s, cp] = 100 * near // min(3, len(faults)) if faults else 0
    cps = S.precursor_match(r, S.checkpoints(r))
    got = {(x.sensor, x.cp): x.precursor_pct for x in cps.collect()}
    assert got == want and len(set(want.values())) > 2
    fired = T.score(T.features(r, cps), F.col("precursor_pct")).collect()
    assert {(x.sensor, x.cp) for x in fired if "precursor_strong" in x.fired} == {k for k, v in want.items() if v >= 67}


def test_old_engine_has_no_status_signals(spark):
    from conftest import SMALL

    from lodestream.plans import sensor

    old = sensor.tfi_old(spark, SMALL)
    assert old.filter("fired like '%status%'").count() == 0 and sensor.signal_flags(spark, SMALL).filter("fired like '%status%'").count() > 0
