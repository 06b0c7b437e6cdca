"""Digital lines: edges, pulses, segments, thresholds, peaks. A user's events are a line that is high where value > 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.operators import intervals, pulses, selection
from trialspark.plans.base import DAY, HOUR, LEVELS, events, levels, onsets, query, table

MIN_HIGH, MIN_LOW = 12 * HOUR, 6 * HOUR

EDGES = f"{LEVELS}, st AS (SELECT user_id, us, state - coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY us), state) AS edge FROM din), edges AS (SELECT * FROM st WHERE edge IN (-1, 1))"
PAIRS = f"""{EDGES}, fr AS (SELECT user_id, min(us) AS f FROM edges WHERE edge = 1 GROUP BY user_id),
r AS (SELECT user_id, us AS rise, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS pulse_idx FROM edges WHERE edge = 1),
fl AS (SELECT e.user_id, e.us AS fall, row_number() OVER (PARTITION BY e.user_id ORDER BY e.us) - 1 AS pulse_idx FROM edges e JOIN fr USING (user_id) WHERE e.edge = -1 AND e.us > fr.f),
pairs AS (SELECT r.user_id, CAST(r.pulse_idx AS INTEGER) AS pulse_idx, r.rise, fl.fall FROM r JOIN fl USING (user_id, pulse_idx))"""
CLEAN = f"""{PAIRS}, hi AS (SELECT * FROM pairs WHERE fall - rise >= {MIN_HIGH}),
nw AS (SELECT *, coalesce(CAST(rise - lag(fall) OVER (PARTITION BY user_id ORDER BY rise) >= {MIN_LOW} AS INTEGER), 0) AS n FROM hi),
isl AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY rise) AS i FROM nw),
clean AS (SELECT user_id, CAST(i AS BIGINT) AS pulse_idx, min(rise) AS rise, max(fall) AS fall FROM isl GROUP BY user_id, i)"""


def _edges(spark, d):
    return pulses.edges(levels(spark, d), ["user_id"], "us")


def _pairs(spark, d):
    return pulses.pair_edges(_edges(spark, d), ["user_id"], "us")


@query(f"WITH {EDGES} SELECT user_id, us, CAST(edge AS INTEGER) AS edge FROM edges")
def edges(spark, d):
    return _edges(spark, d)


@query(f"""WITH {LEVELS}, e AS (SELECT user_id, us, CASE WHEN state = 1 THEN 1 ELSE -1 END AS edge FROM din), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, edge ORDER BY us) AS k FROM e)
SELECT user_id, us, CAST(edge AS INTEGER) AS edge FROM k WHERE NOT (edge = -1 AND k = 1)""")
def edges_by_level(spark, d):
    return pulses.edges_by_level(levels(spark, d), ["user_id"], "us", skip_first_fall=True)


@query(f"WITH {LEVELS} SELECT user_id, us - min(us) OVER (PARTITION BY user_id) AS us, state FROM din")
def anchor_zero(spark, d):
    return pulses.anchor_zero(levels(spark, d), ["user_id"], "us").select("user_id", "us", "state")


@query(f"""WITH {LEVELS}, m AS (SELECT *, CAST(user_id % 3 AS INTEGER) AS rec, CAST(us // 864000000000 AS INTEGER) AS part FROM din),
w AS (SELECT *, lag(state) OVER (PARTITION BY rec ORDER BY part, event_id) AS b, row_number() OVER (PARTITION BY rec, part ORDER BY event_id) AS k FROM m)
SELECT rec, part, event_id, state FROM w WHERE NOT (k = 1 AND b IS NOT NULL AND b = state)""")
def concat_parts(spark, d):
    din = levels(spark, d).withColumns({"rec": (F.col("user_id") % 3).cast("int"), "part": F.floor(F.col("us") / (10 * DAY)).cast("int")})
    return pulses.concat_parts(din, ["rec"], "part", "event_id").select("rec", "part", "event_id", "state")


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def pair_edges(spark, d):
    return _pairs(spark, d)


@query(f"WITH {CLEAN} SELECT * FROM clean")
def deglitch(spark, d):
    return pulses.deglitch(_pairs(spark, d), ["user_id"], MIN_HIGH, MIN_LOW)


@query(f"""WITH {CLEAN}, c AS (SELECT user_id, count(*) AS clean_highs FROM clean GROUP BY user_id)
SELECT p.user_id, count(*) AS raw_highs, count(*) FILTER (WHERE fall - rise < {MIN_HIGH}) AS dropped_highs, coalesce(any_value(c.clean_highs), 0) AS clean_highs, count(*) FILTER (WHERE fall - rise >= {MIN_HIGH}) - coalesce(any_value(c.clean_highs), 0) AS merged_lows
FROM pairs p LEFT JOIN c USING (user_id) GROUP BY p.user_id""")
def clean_report(spark, d):
    return pulses.clean_report(_pairs(spark, d), ["user_id"], MIN_HIGH, MIN_LOW)


@query(f"""WITH {EDGES}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, edge ORDER BY us) - 1 AS idx FROM edges) SELECT user_id, us, CAST(edge AS INTEGER) AS edge FROM k WHERE NOT (edge = 1 AND idx IN (0, 3))""")
def drop_manual_edges(spark, d):
    e = _edges(spark, d)
    drops = e.select("user_id").distinct().select("user_id", F.lit(1).alias("edge"), F.explode(F.array(F.lit(0), F.lit(3))).alias("idx"))
    return pulses.drop_manual(e, drops, ["user_id"], "us")


@query(f"WITH {EDGES} SELECT user_id, us AS rise, us + 7200000000 AS fall FROM edges WHERE edge = 1")
def synth_falls(spark, d):
    return pulses.synth_falls(_edges(spark, d).filter("edge = 1").select("user_id", F.col("us").alias("rise")), 2 * HOUR)


SEG = f"""g AS (SELECT user_id, epoch_us(ts) AS us, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) > {12 * HOUR} AS INTEGER), 0) AS n FROM events),
seg AS (SELECT user_id, us, CAST(1 + sum(n) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS segment FROM g)"""


@query(f"WITH {SEG} SELECT * FROM seg")
def gap_segments(spark, d):
    return pulses.split_by_gap(events(spark, d).select("user_id", "us"), ["user_id"], "us", 12 * HOUR)


@query(f"""WITH {SEG}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS i FROM seg) SELECT user_id, segment, CAST(min(i) AS INTEGER) AS start_index, count(*) AS n_trials, min(us) AS "first", max(us) AS "last" FROM i GROUP BY ALL""")
def segment_table(spark, d):
    return pulses.segment_table(gap_segments(spark, d), ["user_id"], "us")


@query(f"""WITH {SEG}, m AS (SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(segment, params)) SELECT s.user_id, s.segment, m.params, count(*) AS n FROM seg s LEFT JOIN m USING (segment) GROUP BY ALL""")
def segment_metadata(spark, d):
    seg = gap_segments(spark, d)
    meta = seg.select("user_id").distinct().select("user_id", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("segment"), F.lit("a").alias("params")), F.struct(F.lit(2).cast("long").alias("segment"), F.lit("b").alias("params")))).alias("m")).select("user_id", "m.*")
    return pulses.attach_segment_metadata(seg, meta, ["user_id"]).groupBy("user_id", "segment", "params").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) - 1 AS i, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC) AS j FROM events)
SELECT user_id, us, 'slice' AS kind FROM k WHERE i >= 2 AND i < 7 UNION ALL SELECT user_id, us, 'last' FROM k WHERE j <= 3""")
def slice_edges(spark, d):
    ev = events(spark, d).select("user_id", "us")
    a = pulses.slice_edges(ev, ["user_id"], "us", 2, 7).withColumn("kind", F.lit("slice"))
    return a.unionByName(pulses.last_edges(ev, ["user_id"], "us", 3).withColumn("kind", F.lit("last")))


STEP = "s AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS d FROM events)"


@query(f"""WITH {STEP} SELECT user_id, count(*) AS n, round(quantile_cont(d, 0.5), 2) AS median, round(quantile_cont(d, 0.25), 2) AS p25, round(quantile_cont(d, 0.75), 2) AS p75, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 2) AS iqr, min(d) AS low, max(d) AS high,
count(*) FILTER (WHERE d > {DAY}) AS n_wide FROM s WHERE d IS NOT NULL GROUP BY user_id""")
def interval_stats(spark, d):
    out = pulses.interval_stats(events(spark, d), ["user_id"], "us", DAY)
    return out.withColumns({c: F.round(c, 2) for c in ("median", "p25", "p75", "iqr")})


@query(f"""WITH k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) - 1 AS idx, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) - epoch_us(ts) AS step FROM events),
m AS (SELECT user_id, median(step) AS m FROM k WHERE step IS NOT NULL GROUP BY user_id) SELECT k.user_id, CAST(k.idx AS INTEGER) AS idx, k.step FROM k JOIN m USING (user_id) WHERE k.step IS NOT NULL AND abs(k.step - m.m) > {2 * DAY}""")
def off_intervals(spark, d):
    return pulses.off_interval(events(spark, d), ["user_id"], "us", 2 * DAY)


CMP = """v AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'), c AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS idx, us - min(us) OVER (PARTITION BY user_id) AS t FROM v), b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS idx, us - min(us) OVER (PARTITION BY user_id) AS t FROM c),
m AS (SELECT user_id, idx, a.t AS ta, b.t AS tb, a.t - b.t AS diff FROM a JOIN b USING (user_id, idx))"""


def _kinds(spark, d):
    ev = events(spark, d)
    return ev.filter("event_type = 'view'").select("user_id", "us"), ev.filter("event_type = 'click'").select("user_id", "us")


@query(f"WITH {CMP} SELECT user_id, count(*) AS n, round(median(diff), 2) AS median, round(stddev_pop(diff) / 1e6, 4) AS std_s, min(diff) AS low, max(diff) AS high, count(*) FILTER (WHERE abs(diff) > {DAY}) AS n_off FROM m GROUP BY user_id")
def compare_edges(spark, d):
    out = pulses.compare_edges(*_kinds(spark, d), ["user_id"], "us", DAY)
    return out.select("user_id", "n", F.round("median", 2).alias("median"), F.round(F.col("std") / 1e6, 4).alias("std_s"), "low", "high", "n_off")


@query(f"WITH {CMP} SELECT user_id, CAST(idx AS INTEGER) AS idx, diff FROM m WHERE abs(diff) > {DAY} ORDER BY abs(diff) DESC, user_id, idx LIMIT 10")
def first_mismatches(spark, d):
    m = pulses.matched(*_kinds(spark, d), ["user_id"], "us").filter(F.abs("diff") > DAY)
    return m.orderBy(F.abs("diff").desc(), "user_id", "idx").limit(10).select("user_id", "idx", "diff")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events), k AS (SELECT user_id, min(us) AS us FROM e GROUP BY user_id UNION ALL SELECT k.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = k.user_id AND e.us >= k.us + {6 * HOUR}) FROM k WHERE k.us IS NOT NULL)
SELECT user_id, us FROM k WHERE us IS NOT NULL""")
def refractory(spark, d):
    return pulses.refractory(events(spark, d), ["user_id"], "us", 6 * HOUR)


@query(f"WITH {PAIRS} SELECT user_id, pulse_idx, fall - rise >= {MIN_HIGH} AS good FROM pairs")
def drop_bad_trials(spark, d):
    return pulses.drop_bad_trials(_pairs(spark, d), MIN_HIGH).select("user_id", "pulse_idx", "good")


TRI = "tri AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) - 1 AS INTEGER) AS trial_index, event_id AS trial FROM events WHERE event_type = 'purchase')"


def _params(spark, d):
    from trialspark.plans.base import row_index

    return row_index(onsets(spark, d), ["user_id"], ["on"], "trial_index").select("user_id", "trial_index", "trial")


@query(f"WITH {PAIRS}, {TRI} SELECT p.user_id, p.pulse_idx AS trial_index, p.rise, p.fall, tri.trial FROM pairs p JOIN tri ON tri.user_id = p.user_id AND tri.trial_index = p.pulse_idx")
def align_trials(spark, d):
    return pulses.align_trials(_pairs(spark, d), _params(spark, d), ["user_id"])


@query(f"WITH {PAIRS}, {TRI}, a AS (SELECT user_id, count(*) AS n FROM pairs GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM tri GROUP BY user_id) SELECT user_id, coalesce(a.n, 0) AS n_pulses, coalesce(b.n, 0) AS n_trials, coalesce(a.n, 0) = coalesce(b.n, 0) AS same FROM a FULL JOIN b USING (user_id)")
def validate_counts(spark, d):
    return pulses.count_check(_pairs(spark, d), _params(spark, d), ["user_id"])


@query("""WITH s AS (SELECT user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts))) / 1e6 AS s FROM events) SELECT user_id, event_id, round(CASE WHEN s > 0 THEN 1 / s / 1000 * 1e6 END, 6) AS mhz FROM s""")
def pulse_frequency(spark, d):
    return pulses.pulse_frequency(events(spark, d), ["user_id"], "us", 1e6).select("user_id", "event_id", (F.col("khz") * 1e6).alias("mhz"))


@query(f"""WITH {LEVELS}, s AS (SELECT user_id, us, CASE WHEN value > 40 THEN 1 WHEN value < 10 THEN 0 END AS told FROM ev) SELECT user_id, us, coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM s""")
def schmitt(spark, d):
    return pulses.schmitt(events(spark, d), ["user_id"], ["us"], "value", F.lit(10.0), F.lit(40.0)).select("user_id", "us", "state")


@query(f"""WITH {LEVELS}, a AS (SELECT user_id, us, sum(value) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS v FROM ev),
r AS (SELECT *, min(v) OVER (PARTITION BY user_id) AS a, max(v) OVER (PARTITION BY user_id) AS b FROM a), t AS (SELECT user_id, us, CASE WHEN v > a + (b - a) * 0.9 THEN 1 WHEN v < a + (b - a) * 0.25 THEN 0 END AS told FROM r),
st AS (SELECT user_id, us, coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM t),
e AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY us), 0) AS before FROM st) SELECT user_id, us, state FROM e WHERE state <> before""")
def schmitt_edges(spark, d):
    return pulses.schmitt_edges(events(spark, d), ["user_id"], ["us"], "value")


@query(f"""WITH {LEVELS}, a AS (SELECT user_id, us, sum(value) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS v FROM ev),
r AS (SELECT *, min(v) OVER (PARTITION BY user_id) AS a, max(v) OVER (PARTITION BY user_id) AS b FROM a), t AS (SELECT user_id, us, CASE WHEN v > a + (b - a) * 0.9 THEN 1 WHEN v < a + (b - a) * 0.25 THEN 0 END AS told FROM r)
SELECT user_id, us, coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM t""")
def schmitt_auto(spark, d):
    from trialspark.operators.windows import moving_average

    smooth = moving_average(events(spark, d), ["user_id"], ["us"], "value", 5)
    return pulses.schmitt_auto(smooth, ["user_id"], ["us"], "smooth").select("user_id", "us", "state")


@query(f"""WITH {LEVELS}, n AS (SELECT user_id, us, value, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i, lag(value) OVER (PARTITION BY user_id ORDER BY us) AS b FROM ev),
r AS (SELECT *, sum(CASE WHEN value <> b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS run FROM n), g AS (SELECT user_id, run, any_value(value) AS v, min(i) AS a, max(i) AS z FROM r GROUP BY ALL),
t AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY run) AS l, lead(v) OVER (PARTITION BY user_id ORDER BY run) AS q FROM g)
SELECT t.user_id, n.us, round(t.v, 6) AS peak FROM t JOIN n ON n.user_id = t.user_id AND n.i = (t.a + t.z) // 2 WHERE t.v > t.l AND t.v > t.q AND t.v >= 30""")
def find_peaks(spark, d):
    return pulses.find_peaks(events(spark, d), ["user_id"], "us", "value", height=30.0)


@query()
def find_peaks_apart(spark, d):
    """Peaks at least three events apart; thinning looks at neighbours in the order of height (see the tests)."""
    return pulses.find_peaks(events(spark, d), ["user_id"], "us", "value", height=30.0, distance=3)


PEAKS = f"""{LEVELS}, n AS (SELECT user_id, us, value, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i, lag(value) OVER (PARTITION BY user_id ORDER BY us) AS b FROM ev),
r AS (SELECT *, sum(CASE WHEN value <> b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS run FROM n), g AS (SELECT user_id, run, any_value(value) AS v, min(i) AS a, max(i) AS z FROM r GROUP BY ALL),
t AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY run) AS l, lead(v) OVER (PARTITION BY user_id ORDER BY run) AS q FROM g), p AS (SELECT n.user_id, n.us, n.i, n.value AS v FROM t JOIN n ON n.user_id = t.user_id AND n.i = (t.a + t.z) // 2 WHERE t.v > t.l AND t.v > t.q)"""


@query(f"""WITH {PEAKS}, e AS (SELECT p.user_id, p.i, coalesce(max(n.i) FILTER (WHERE n.i < p.i), 0) AS lo, coalesce(min(n.i) FILTER (WHERE n.i > p.i), 1000000000) AS hi FROM p LEFT JOIN n ON n.user_id = p.user_id AND n.value > p.v GROUP BY ALL),
m AS (SELECT p.user_id, p.us, p.v, min(n.value) FILTER (WHERE n.i <= p.i) AS l, min(n.value) FILTER (WHERE n.i >= p.i) AS r FROM p JOIN e USING (user_id, i) JOIN n ON n.user_id = p.user_id AND n.i > e.lo AND n.i < e.hi GROUP BY p.user_id, p.us, p.i, p.v)
SELECT user_id, us, round(v, 6) AS peak, round(v - greatest(l, r), 6) AS prominence FROM m WHERE v - greatest(l, r) >= 10""")
def find_peaks_prominent(spark, d):
    return pulses.find_peaks_prominent(events(spark, d), ["user_id"], "us", "value", least=10.0)


@query(f"WITH {LEVELS} SELECT user_id, count(*) AS n FROM ev WHERE us BETWEEN 1704067200000000 + {5 * DAY} AND 1704067200000000 + {9 * DAY} GROUP BY user_id")
def in_window(spark, d):
    return events(spark, d).filter(F.col("us").between(1_704_067_200_000_000 + 5 * DAY, 1_704_067_200_000_000 + 9 * DAY)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT a.event_type AS a, b.event_type AS b FROM (SELECT DISTINCT event_type FROM events) a JOIN (SELECT DISTINCT event_type FROM events) b ON a.event_type < b.event_type""")
def label_pairs(spark, d):
    return selection.label_pairs(events(spark, d), "event_type")


@query("""SELECT r.r_name, o.p AS o_orderpriority FROM (SELECT DISTINCT r_name FROM region) r CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) o""")
def factor_levels(spark, d):
    r = table(spark, d, "region").select("r_name")
    o = table(spark, d, "orders").select("o_orderpriority")
    return selection.factor_levels(r.join(o, F.lit(True), "cross"), ["r_name", "o_orderpriority"])


@query("""SELECT event_type, CAST(user_id % 4 AS INTEGER) AS shank, count(*) AS n FROM events GROUP BY CUBE (event_type, CAST(user_id % 4 AS INTEGER))""")
def counts_by_factor(spark, d):
    return selection.counts_by(events(spark, d).withColumn("shank", (F.col("user_id") % 4).cast("int")), "event_type", "shank")


@query("""WITH k AS (SELECT DISTINCT epoch_us(ts) // 86400000000 AS day FROM events), a AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM k), b AS (SELECT day + (day % 7 = 0)::BIGINT AS day, row_number() OVER (ORDER BY day) AS k FROM k)
SELECT count(a.day) AS n_a, count(b.day) AS n_b, count(*) FILTER (WHERE coalesce(abs(a.day - b.day) > 0.5, true)) AS n_off, count(*) FILTER (WHERE coalesce(abs(a.day - b.day) > 0.5, true)) = 0 AS same FROM a FULL JOIN b USING (k)""")
def axis_check(spark, d):
    from trialspark.plans.base import row_index

    days = row_index(events(spark, d).select(F.floor(F.col("us") / DAY).alias("day")).distinct(), [], ["day"], "k")
    return intervals.axis_check(days, days.withColumn("day", F.col("day") + (F.col("day") % 7 == 0).cast("long")), "k", "day", 0.5)
