"""Log readers on generated files, stores, scalar functions and the streaming variants."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from trialspark.functions import scalars, stats
from trialspark.operators import pulses
from trialspark.sources import logs
from trialspark.streaming import live


def test_read_din(spark, tmp_path):
    head = b"<Start settings>\nClock rate: 30000\nFields: <time uint32><state uint8>\n<End settings>\n"
    for folder, rows in (("a.DIO", [(0, 0), (5, 1)]), ("b.DIO", [(9, 1), (12, 0)])):
        (tmp_path / "rec1" / folder).mkdir(parents=True)
        (tmp_path / "rec1" / folder / "x.dio_Din1.dat").write_bytes(head + b"".join(struct.pack("<IB", *r) for r in rows))
        (tmp_path / "rec1" / folder / "x.dio_Din2.dat").write_bytes(head)
    din = logs.read_din(spark, str(tmp_path), 1)
    assert sorted((r.rec_id, r.part, r.seq, r.t, r.state) for r in din.collect()) == [("rec1", 1, 0, 0, 0), ("rec1", 1, 1, 5, 1), ("rec1", 2, 0, 9, 1), ("rec1", 2, 1, 12, 0)]
    assert pulses.concat_parts(din, ["rec_id"]).count() == 3
    with pytest.raises(ValueError):
        logs.parse_din(b"no header")
    t, state = logs.parse_din(b"<Start settings>\nfields: <time uint32><pair 2*uint16><state uint8>\n<End settings>\n" + struct.pack("<IHHB", 7, 1, 2, 1))
    assert (t.tolist(), state.tolist()) == ([7], [1])


def test_malformed_and_streamed_din(spark, tmp_path):
    head = b"<Start settings>\nFields: <time uint32><state uint8>\n<End settings>\n"

    def put(folder, body):
        (tmp_path / "in" / "rec1" / folder).mkdir(parents=True)
        (tmp_path / "in" / "rec1" / folder / "x.dio_Din1.dat").write_bytes(body)

    put("a.DIO", head + struct.pack("<IB", 3, 1))
    put("b.DIO", b"no header at all")
    path = str(tmp_path / "in")
    with pytest.raises(Exception, match="no settings header"):
        logs.read_din(spark, path, 1).collect()
    assert [(r.part, r.t, r.state) for r in logs.read_din(spark, path, 1, malformed="drop").collect()] == [(1, 3, 1)]
    [bad] = logs.din_errors(spark, path, 1).collect()
    assert "b.DIO" in bad.path and bad.error == "no settings header"

    def run():
        q = logs.stream_din(spark, path, 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.folder, r.t) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a.DIO", 3)]
    put("c.DIO", head + struct.pack("<IB", 9, 0))
    assert run() == [("a.DIO", 3), ("c.DIO", 9)]


def test_read_grid_log(spark, tmp_path):
    row = "\t".join(["3", "7", "2024-01-02 03:04:05", "0.5", "1.0", "-10.5", "20", "1", "2"])
    (tmp_path / "g.txt").write_text(f"# Grid Range: -30.5..40\n# Animal: m1\nTrial\tStim\n{row}\n1\t2\tshort\nOriginal Trial Sequence\n3,1,2\n")
    header, trials = logs.read_grid_log(spark, str(tmp_path / "g.txt"))
    h, t = header.first(), trials.collect()
    assert h.meta["animal"] == "m1" and h.numbers["grid_range"] == [-30.5, 40.0] and h.sequence == [3, 1, 2]
    assert len(t) == 1 and (t[0].trial_index, t[0].azimuth, t[0].trial_start) == (3, -10.5, dt.datetime(2024, 1, 2, 3, 4, 5))


def test_read_grating_log(spark, tmp_path):
    (tmp_path / "l.txt").write_text("Animal ID: m2\nAngles: [0, 45, 90]\nTRIAL DATA:\nTrial\tL Orient\tHeading\n1\t45\t0.5\n2\t90\n3\tx\t1.5\nSUMMARY:\nHit rate: 75.5%\nTotal: 3\n")
    header, trials = logs.read_grating_log(spark, str(tmp_path / "l.txt"))
    h = header.first()
    assert h.meta["animal_id"] == "m2" and h.ranges["angles"] == [0, 45, 90] and h.summary == {"hit_rate": 75.5, "total": 3.0}
    out = logs.typed(trials, {"trial": "int", "l_orient": "double"}).orderBy("row_no").collect()
    assert [(r.trial, r.l_orient) for r in out] == [(1, 45.0), (3, None)]


def test_csv_lists_and_names(spark, tmp_path):
    (tmp_path / "t.csv").write_text("trial_index,right_ori,stim_on_s\n0,90,1.5\n1,x,2\n")
    out = logs.read_trial_csv(spark, str(tmp_path / "t.csv")).orderBy("trial_index").collect()
    assert (out[0].right_ori, out[0].left_ori, out[1].right_ori) == (90.0, None, None)
    (tmp_path / "n.txt").write_text("3\n1.5\n\n2\n")
    assert [r.value for r in logs.read_number_list(spark, str(tmp_path / "n.txt")).orderBy("idx").collect()] == [3, 1.5, 2]
    names = spark.createDataFrame([("m1_240101_a",), ("m1_240105_b",), ("m2_240102_c",), ("bad",), ("m1_2401_x",)], "name string")
    assert [r.name for r in logs.discover_sessions(spark, names, "231231", "240102", ["m1", "m2"]).orderBy("name").collect()] == ["m1_240101_a", "m2_240102_c"]
    assert logs.parse_sessions(names).filter("animal IS NULL").count() == 2


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1, [0.1, 0.2]), ("s2", 2, [])], "session_id string, trial int, spike_times array<double>")
    path = str(tmp_path / "trials")
    logs.write_trials(df, path)
    logs.write_trials(df.filter("trial = 2").withColumn("trial", F.lit(9)), path)
    assert {(r.session_id, r.trial, len(r.spike_times)) for r in logs.read_trials(spark, path).collect()} == {("s1", 1, 2), ("s2", 9, 0)}
    done = spark.createDataFrame([("s1", "ok")], "session_id string, status string")
    assert logs.unprocessed(df, done, ["session_id"]).count() == 1 and logs.unprocessed(df, done, ["session_id"], True).count() == 2
    assert logs.run_summary(done).first().n == 1
    logs.write_result(df, str(tmp_path / "r"), sigma=2.0)
    assert spark.read.parquet(str(tmp_path / "r")).first().sigma == 2.0
    logs.write_metrics_csv(df.drop("spike_times"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    logs.write_segments(df.selectExpr("session_id AS rec_id", "trial AS segment", "size(spike_times) AS n"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("segment = 1").count() == 1


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalars.date_range(lit("240228"), lit("240301"))) == ["240228", "240229", "240301"]
    assert one(spark, scalars.time_key(scalars.name_time(lit("run_2024-03-05_14-07-09_x.csv")))) == "20240305_1407"
    assert one(spark, scalars.name_time(lit("none"))) is None
    assert one(spark, scalars.signed_decimals(lit("a -1.5 b 2"))) == [-1.5, 2.0]
    assert tuple(one(spark, scalars.number_range(lit("-3..4.5")))) == (-3.0, 4.5)
    assert one(spark, scalars.number_list(lit("[]"))) == [] and one(spark, scalars.number_list(lit("[1, 2.5]"))) == [1, 2.5]
    assert [tuple(p) for p in one(spark, scalars.pair_list(lit("0:45, 90:135")))] == [(0, 45), (90, 135)]
    assert one(spark, scalars.normal_key(lit(" Hit  Rate "))) == "hit_rate" and one(spark, scalars.percent(lit("75.5 %"))) == 75.5
    assert one(spark, scalars.seconds_of(lit("1.5s"))) == 1.5
    assert one(spark, scalars.short_unit(lit("shank2_kilo_unit17"))) == "shank2_unit17" and one(spark, scalars.short_unit(lit("other"))) == "other"
    assert one(spark, scalars.unit_key(lit("shank0"), lit("ks"), lit(4))) == "shank0_ks_unit4"
    assert one(spark, scalars.visual_angle(lit(2.0), lit(1.0))) == pytest.approx(45)
    assert tuple(one(spark, scalars.dot_place(lit(5), 4))) == (1, 0)
    assert [one(spark, scalars.drift_direction(lit(a))) for a in (0.0, 90.0, 180.0)] == [1, 1, -1]
    arr = F.array(lit(1.0), lit(2.0), lit(4.0))
    assert one(spark, scalars.steps(arr)) == [1, 2] and one(spark, scalars.array_var(arr)) == pytest.approx(14 / 9)
    assert one(spark, pulses.to_samples(lit(2.5), 1)) == 2 and one(spark, pulses.to_samples(lit(3.5), 1)) == 4
    assert [one(spark, stats.stars(lit(p))) for p in (1e-5, 0.005, 0.05, 0.2)] == ["****", "**", "*", "n.s."]
    assert one(spark, stats.tier(lit(0.7))) == "moderate" and one(spark, stats.stars3(lit(0.0005))) == "***" and one(spark, stats.above_chance(lit(0.6), lit(0.5))) == "some"


def streamed(spark, tmp_path, rows, build, name):
    source = str(tmp_path / f"in-{name}")
    df = spark.createDataFrame(rows, "k int, ts timestamp")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    q = build(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    spark.createDataFrame([(99, dt.datetime(2024, 1, 2))], "k int, ts timestamp").write.mode("append").parquet(source)
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_live_rate(spark, tmp_path):
    out = streamed(spark, tmp_path, [(1, at(s)) for s in (0, 1, 5, 12)], lambda s: live.live_rate(s, "ts", "10 seconds", "1 second", 10.0), "live_rate")
    assert sorted((r.start, r.n, r.rate) for r in out if r.start < at(60)) == [(at(0), 3, 0.3), (at(10), 1, 0.1)]


def test_live_segments(spark, tmp_path):
    out = streamed(spark, tmp_path, [(1, at(s)) for s in (0, 4, 20, 21)] + [(2, at(3))], lambda s: live.live_segments(s, "ts", "10 seconds", "1 second", ["k"]), "live_segments")
    assert sorted((r.k, r.start, r.end, r.n) for r in out if r.k < 9) == [(1, at(0), at(4), 2), (1, at(20), at(21), 2), (2, at(3), at(3), 1)]


def test_live_refractory(spark, tmp_path):
    out = streamed(spark, tmp_path, [(1, at(s)) for s in (0, 1, 4, 5, 8)] + [(2, at(3))], lambda s: live.live_refractory(s, "k", "ts", 4.0, "1 minute"), "live_refractory")
    assert sorted((r.k, r.ts) for r in out if r.k < 9) == [(1, at(0)), (1, at(4)), (1, at(8)), (2, at(3))]


def test_live_refractory_drops_late_rows_and_idle_keys(spark, tmp_path):
    """Over a restart from the checkpoint: rows behind the watermark are dropped, and keys idle for long have no state."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def feed(rows):
        spark.createDataFrame(rows, "k int, ts timestamp").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("k int, ts timestamp").parquet(source)
        q = live.live_refractory(stream, "k", "ts", 4.0, "10 seconds", idle=30.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    def held():
        return {r.key["k"]: r.value["groupState"]["last"] for r in spark.read.format("statestore").load(checkpoint).collect()}

    feed([(1, at(s)) for s in (0, 1, 5)] + [(2, at(100))])
    run()
    assert set(held()) == {2}
    feed([(2, at(103)), (2, at(104)), (3, at(20)), (3, at(95))])
    run()
    feed([(2, at(200)), (1, at(199)), (1, at(93))])
    run()
    feed([(2, at(300))])
    run()
    got = sorted((r.k, r.ts) for r in spark.read.parquet(out).collect())
    assert got == [(1, at(0)), (1, at(5)), (1, at(199)), (2, at(100)), (2, at(104)), (2, at(200)), (2, at(300)), (3, at(95))]
    assert set(held()) == {2}


def test_fallbacks_of_texts(spark):
    rows = spark.createDataFrame([("2024-05-01 10:20:30", " TRUE", "1.5s"), ("soon", "off", "long"), (None, "maybe", None)], "t string, f string, d string")
    got = rows.select(scalars.time_or_text(F.col("t")).alias("t"), scalars.flag(F.col("f")).alias("f"), scalars.duration(F.col("d"), 2.0).alias("d"), scalars.duration(F.col("d"), 2.0, F.lit(3)).alias("o")).collect()
    assert [r.t.time is None for r in got] == [False, True, True] and [r.t.text for r in got] == [None, "soon", None]
    assert [(r.f, r.d, r.o) for r in got] == [(True, 1.5, 3.0), (False, 2.0, 3.0), (None, 2.0, 3.0)]


def test_sides_of_trains_and_empty_reports(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 4.0],), ([],), (None,)], "a array<double>")
    got = rows.select(scalars.before_and_after(F.col("a"), 2.0).alias("s"), scalars.millis(F.col("a")).alias("m")).collect()
    assert [(r.s.before, r.s.after, r.m) for r in got] == [([-1.0], [0.0, 2.0], [1000.0, 2000.0, 4000.0]), ([], [], []), (None, None, None)]
    trials = spark.createDataFrame([("a", "x", 1, 2.0), ("a", "y", 5, None), ("b", "x", 9, 4.0)], "rec string, kind string, t long, v double")
    one = logs.session_report(trials, ["rec"], "kind", "t", "v").first()
    assert (one.recordings, one.trials, one.stimuli, one.duration, one.n_values, one.mean, one.most_trials) == (2, 3, 2, 8, 2, 3.0, 2)
    none = logs.session_report(trials.limit(0), ["rec"], "kind", "t", "v").collect()
    assert len(none) == 1 and none[0].trials == 0 and none[0].duration is None
