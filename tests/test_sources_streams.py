"""Readers, writers, the measurement parser, and streams against their batch twins."""

import gzip

import pytest
from pyspark.sql import functions as F

from tessera.operators import selection as T
from tessera.operators import similarity as S
from tessera.sources import measurements as ME
from tessera.sources import tables as TB
from tessera.streaming import streams as ST

c = F.col


def test_csv_round_trip_and_nan(spark, tmp_path):
    df = spark.createDataFrame([("CCO", 1.0), ("C", float("nan"))], "smiles string, v double")
    TB.write_csv(df, f"{tmp_path}/a")
    got = {r.smiles: r.v for r in TB.read_csv(spark, f"{tmp_path}/a", "smiles string, v double").collect()}
    assert got == {"CCO": 1.0, "C": None}
    assert TB.read_csv(spark, f"{tmp_path}/a", "smiles string, v double", ["smiles"]).columns == ["smiles"]


def test_tolerant_reads(spark, tmp_path):
    schema = spark.createDataFrame([], "a string, b double").schema
    assert TB.read_csv_or_empty(spark, f"{tmp_path}/none", schema).count() == 0
    (tmp_path / "one.csv").write_text("a\nx\n")
    assert TB.read_csv_or_empty(spark, f"{tmp_path}/one.csv", schema).count() == 0
    (tmp_path / "two.csv").write_text("a,b\nx,1.5\ny,bad\n")
    assert [r.b for r in TB.read_csv_or_empty(spark, f"{tmp_path}/two.csv", schema).orderBy("a").collect()] == [1.5, None]
    assert TB.read_first(spark, [f"{tmp_path}/none", f"{tmp_path}/two.csv"], schema).count() == 2


def test_runs_by_directory(spark, tmp_path):
    for tau, seed in ((0.1, 1), (0.25, 2)):
        d = tmp_path / f"tau{tau}_seed{seed}"
        d.mkdir()
        (d / "x.csv").write_text("a,b\nq,1\n")
    schema = spark.createDataFrame([], "a string, b double").schema
    got = TB.read_runs(spark, f"{tmp_path}/tau*/*.csv", schema, r"tau([0-9.]+)_seed(\d+)", {"tau": "double", "seed": "int"})
    assert {(r.tau, r.seed) for r in got.collect()} == {(0.1, 1), (0.25, 2)}


def test_append_pads(spark, tmp_path):
    for g, cols in ((0, "smiles string, generation int, fom1 double"), (1, "generation int, smiles string, extra int")):
        TB.append_generation(spark.createDataFrame([("C", 0, 1.0) if g == 0 else (1, "CC", 5)], cols), f"{tmp_path}/log")
    got = spark.read.parquet(f"{tmp_path}/log")
    assert got.count() == 2 and set(got.columns) == set(TB.EVALUATED.names)


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1.5, None)], "k string, v double, w string")
    TB.write_metrics(df, f"{tmp_path}/j")
    TB.write_report(df.select("k"), f"{tmp_path}/t")
    assert spark.read.json(f"{tmp_path}/j").first().v == 1.5 and spark.read.text(f"{tmp_path}/t").first()[0] == "a_b"
    assert df.select(TB.latex_rows(["k", "v", "w"])).first()[0] == r"a\_b & 1.5 & -- \\"
    with gzip.open(tmp_path / "x.gz", "wt") as f:
        f.write("1\tCC\n2\tCCC\n")
    assert {r.fields[1] for r in TB.read_gzip_lines(spark, f"{tmp_path}/x.gz", 2).collect()} == {"CC", "CCC"}
    g = TB.grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).orderBy("index").collect()
    assert [(r.a, r.b) for r in g] == [(1, "x"), (1, "y"), (1, "z"), (2, "x"), (2, "y"), (2, "z")]
    assert TB.find_columns(["SMILES", "BP (C)"], {"smiles": ["smiles"], "bp": ["bp", "boil"]}) == {"SMILES": "smiles", "BP (C)": "bp"}
    with pytest.raises(KeyError):
        TB.find_columns(["a"], {"smiles": ["smiles"]})


def test_lines_stop_on_accepted_rows(spark, tmp_path):
    """What follows the last wanted line is damaged: a reader that went on would fail."""
    from tessera.sources import lines as L

    L.register(spark)
    text = "".join(f"{'keep' if k % 3 == 0 else 'drop'} {k}\n" for k in range(200_000)).encode()
    whole = gzip.compress(text)
    (tmp_path / "a.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "b.txt").write_text("keep x\r\ndrop\nkeep é")
    read = lambda **o: spark.read.format("lines").option("path", f"{tmp_path}/*").options(**o).load()
    got = [tuple(r) for r in read(accept="^keep", stop=5).orderBy("file", "line_no").collect()]
    assert got == [("a.gz", 3 * k, f"keep {3 * k}") for k in range(5)] + [("b.txt", 0, "keep x"), ("b.txt", 2, "keep é")]
    with pytest.raises(Exception):
        read(accept="^keep").count()
    assert read().where("file = 'b.txt'").count() == 3  # the damaged file isn't opened
    assert spark.read.format("lines").option("path", f"{tmp_path}/none-*").load().count() == 0


def test_measurements(spark):
    text = ["junk", "12 CH4O methanol [67-56-1]", "T/K 293.2 298.2 303.2", "eps 33.6 32.6 31.7 51AB", "13 C2H6O ethanol [64-17-5]", "eps 9 9", "T/K 290.0 310.0", "eps 25.0 23.0", "T/K 200 300.5", "eps x 5"]
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(text)], "file string, line int, value string")
    rows = ME.records(lines, ["file"], "line", "value")
    assert rows.count() == 7
    est = {r.name: (r.dc_method, r.dc_25c) for r in ME.at_25c(ME.valid(rows)).collect()}
    assert est["methanol"] == ("direct", 32.6) and est["ethanol"][0] == "interpolated" and round(est["ethanol"][1], 3) == 9.476
    names = spark.createDataFrame([("67-56-1",), ("0-0-0",)], "cas string")
    a, b = (spark.createDataFrame(x, "cas string, s string") for x in ([("67-56-1", "CO")], [("67-56-1", "OC"), ("0-0-0", "N")]))
    got = {r.cas: (r.smiles, r.source) for r in ME.resolve(names, "cas", [(a, "s", "one"), (b, "s", "two")]).collect()}
    assert got == {"67-56-1": ("CO", "one"), "0-0-0": ("N", "two")}


def _stream(spark, tmp_path, df):
    df.repartition(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def _run(writer, tmp_path, name):
    q = writer.option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_streams_match_batches(spark, tmp_path):
    rows = [(k, k % 7, (k * 37) % 101, float((k * 13) % 29)) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, g long, w long, v double")
    s = _stream(spark, tmp_path, df)
    _run(ST.first_seen(s, "g").writeStream.format("memory").queryName("seen"), tmp_path, "seen")
    assert spark.sql("select * from seen").count() == 7
    _run(ST.capped(s, "g", "k", 3).writeStream.format("memory").queryName("capped").outputMode("append"), tmp_path, "capped")
    want = {tuple(r) for r in T.capped(df, ["g"], [c("k")], 3).collect()}
    assert {tuple(r) for r in spark.sql("select * from capped").collect()} == want
    _run(ST.online_leaders(s, "g", "k", "w", 0.5).writeStream.format("memory").queryName("lead").outputMode("append"), tmp_path, "lead")
    assert {tuple(r) for r in spark.sql("select g, k, cluster from lead").collect()} == {tuple(r) for r in S.leaders(df, "g", "k", "w", "k", 0.5).collect()}
    order = [c("v").desc(), c("k")]
    _run(s.writeStream.foreachBatch(ST.keep_top(f"{tmp_path}/top", order, 5)), tmp_path, "top")
    assert {r.k for r in spark.read.parquet(f"{tmp_path}/top/v=0").collect()} == {r.k for r in T.top_k(df, order, 5).collect()}
    _run(s.writeStream.foreachBatch(ST.keep_replay(f"{tmp_path}/replay", "g", order, 2, 6)), tmp_path, "replay")
    assert {r.k for r in spark.read.parquet(f"{tmp_path}/replay/v=0").collect()} == {r.k for r in T.replay_buffer(df, "g", order, 2, 6).collect()}


@pytest.fixture
def store(spark):
    for k, v in ST.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in ST.STORE:
        spark.conf.unset(k)


def _go_on(spark, tmp_path, frames, make, name):
    """Each frame is a batch of a run that stops after it; the checkpoint carries the state to the next."""
    schema = frames[0].schema
    for k, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
        s = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}-in")
        q = make(s).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        last = q.lastProgress
    return spark.read.parquet(f"{tmp_path}/{name}-out"), last


def test_patience_survives_restarts(spark, tmp_path, store):
    values = [1.0, 2.0, 2.005, None, 1.5, 3.0, 2.9, 2.9, 3.005, 3.2]
    rows = [(g, k, v if v is None else v + g) for g in (0, 1) for k, v in enumerate(values)]
    frames = [spark.createDataFrame([r for r in rows if a <= r[1] < b], "g long, k long, v double") for a, b in ((0, 3), (3, 7), (7, 10))]
    got, _ = _go_on(spark, tmp_path, frames, lambda s: ST.patience(s, "g", "k", "v", 0.01, 3), "patience")
    want = set()
    for g in (0, 1):
        best, stale = None, 0
        for _, k, v in sorted(r for r in rows if r[0] == g):
            best, stale = (v, 0) if v is not None and (best is None or v > best + 0.01) else (best, stale + 1)
            want.add((g, k, best, stale, stale >= 3))
    assert {(r.g, r.k, r.best, r.stale, r.exhausted) for r in got.collect()} == want and any(w[4] for w in want)


def test_idle_groups_are_forgotten(spark, tmp_path, store):
    """Three runs an hour apart, each with groups of its own and one that never rests: the state doesn't grow with the runs."""
    frames, sizes = [], []
    for hour in range(3):
        rows = [(f"h{hour}-{k}", m, f"2024-01-01 {hour * 2:02d}:00:{k % 60:02d}") for k in range(20) for m in ("a", "b", "a", "c")] + [("always", f"m{hour}", f"2024-01-01 {hour * 2:02d}:00:30"), ("always", "m0", f"2024-01-01 {hour * 2:02d}:00:40")]
        frames.append(spark.createDataFrame(rows, "g string, m string, t string").withColumn("ts", F.to_timestamp("t")))
    for k in range(1, 4):
        got, last = _go_on(spark, tmp_path / str(k), frames[:k], lambda s: ST.arrivals_within(s, "g", "m", "ts", "30 minutes", 2), "idle")
        sizes.append(last["stateOperators"][0]["numRowsTotal"])
    per = {r.g: r.n for r in got.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert per.pop("always") == 2 and set(per.values()) == {2} and len(per) == 60  # m0, then m1; no more than two
    assert max(sizes) < 2.5 * sizes[0]


def test_event_windows(spark, tmp_path):
    df = spark.range(50).select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=c("id"))).alias("ts"), (c("id") % 3).alias("u"), c("id").cast("double").alias("v"))
    s = _stream(spark, tmp_path, df)
    _run(ST.windowed(s, "ts", ["u"], "v", "10 minutes").writeStream.format("memory").queryName("win").outputMode("complete"), tmp_path, "win")
    assert spark.sql("select sum(n) from win").first()[0] == 50
    _run(ST.sessions(s, "ts", "u", "5 minutes").writeStream.format("memory").queryName("ses").outputMode("complete"), tmp_path, "ses")
    assert spark.sql("select count(*) from ses").first()[0] == 3


def test_gzip_lines_are_read_by_file(spark, monkeypatch, tmp_path):
    from tessera.plans import io

    rows = spark.range(0, 4000, 1, 8).select(F.col("id").alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"))
    monkeypatch.setattr(io, "read", lambda *_: rows)
    monkeypatch.setattr(io, "_path", lambda _, name: f"{tmp_path}/{name}")
    assert sorted(r.line for r in io.gzip_lines(spark, "").collect()) == sorted(f"{k}\t{k % 7}" for k in range(4000))
    files = [p.stat().st_size for p in (tmp_path / "gz").glob("*.gz")]
    assert len(files) == 8 and max(files) < 2 * min(files)  # none has all lines
    many = TB.read_gzip_lines(spark, f"{tmp_path}/gz", 1)
    assert many.count() == 4000 and "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
