"""Events around trials: interval joins, histograms, rates, as-of joins, interpolation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialspark.functions.stats import stars, t_tails
from trialspark.operators import decode, intervals, rates, selection, tuning, windows
from trialspark.plans.base import DAY, EV, HOUR, events, onsets, query, spikes, table
from trialspark.sources import logs


def _hits(spark, d, before=DAY, after=DAY):
    w = intervals.trial_windows(onsets(spark, d), "on", before, after)
    hit = intervals.interval_join(spikes(spark, d), w, ["user_id"], "us", "low", "high", before + after)
    return hit.withColumn("rel", F.col("us") - F.col("on"))


@query(f"WITH {EV} SELECT t.user_id, t.trial, count(h.rel) AS n FROM trials t LEFT JOIN hits h ON h.trial = t.trial AND h.user_id = t.user_id GROUP BY t.user_id, t.trial")
def interval_join_counts(spark, d):
    n = _hits(spark, d).groupBy("user_id", "trial").agg(F.count("*").alias("n"))
    return onsets(spark, d).join(n, ["user_id", "trial"], "left").select("user_id", "trial", F.coalesce("n", F.lit(0)).alias("n"))


PSTH = f"""{EV}, nt AS (SELECT quarter, count(*) AS n_trials FROM trials GROUP BY quarter),
b AS (SELECT quarter, CAST((rel + 86400000000) // 3600000000 AS INTEGER) AS bin, count(*) AS n FROM hits GROUP BY ALL),
grid AS (SELECT q.quarter, CAST(r.bin AS INTEGER) AS bin FROM (SELECT DISTINCT quarter FROM hits) q, range(48) r(bin)),
psth AS (SELECT g.quarter, g.bin, coalesce(b.n, 0) AS n, nt.n_trials, coalesce(b.n, 0) / (nt.n_trials * 3600.0) AS rate FROM grid g JOIN nt USING (quarter) LEFT JOIN b ON b.quarter = g.quarter AND b.bin = g.bin)"""


def _psth(spark, d):
    return rates.psth(_hits(spark, d), onsets(spark, d), ["quarter"], "rel", -DAY, HOUR, 48, 1e6)


@query(f"WITH {PSTH} SELECT quarter, bin, n, n_trials, round(rate, 6) AS rate FROM psth")
def psth(spark, d):
    return _psth(spark, d)


_W = ", ".join(f"({k - 8}, {w!r})" for k, w in enumerate(windows.gaussian_weights(2.0).tolist()))


@query(f"""WITH {PSTH}, w(k, w) AS (VALUES {_W}), m AS (SELECT p.quarter, p.bin, w.w, ((p.bin + w.k) % 96 + 96) % 96 AS pl FROM psth p, w),
s AS (SELECT m.quarter, m.bin, sum(m.w * p.rate) AS smooth FROM m JOIN psth p ON p.quarter = m.quarter AND p.bin = CASE WHEN m.pl < 48 THEN m.pl ELSE 95 - m.pl END GROUP BY m.quarter, m.bin)
SELECT quarter, bin, round(smooth, 6) AS smooth FROM s""")
def psth_smoothed(spark, d):
    out = windows.gaussian_smooth(_psth(spark, d), ["quarter"], "bin", "rate", 2.0)
    return out.select("quarter", "bin", "smooth")


@query(f"""WITH {EV}, b AS (SELECT quarter, weekday, CAST((rel + 86400000000) // 21600000000 AS INTEGER) AS bin FROM hits),
n AS (SELECT quarter, weekday, bin, grouping(quarter, weekday) AS g, count(*) AS n FROM b GROUP BY GROUPING SETS ((quarter, weekday, bin), (quarter, bin), (weekday, bin), (bin))),
t AS (SELECT quarter, weekday, grouping(quarter, weekday) AS g, count(*) AS n_trials FROM trials GROUP BY CUBE (quarter, weekday))
SELECT n.quarter, n.weekday, CAST(n.g AS BIGINT) AS "grouping", n.bin, n.n, t.n_trials, round(n.n / (t.n_trials * 21600.0), 6) AS rate
FROM n JOIN t ON n.g = t.g AND n.quarter IS NOT DISTINCT FROM t.quarter AND n.weekday IS NOT DISTINCT FROM t.weekday""")
def psth_grouping_sets(spark, d):
    return rates.psth_modes(_hits(spark, d), onsets(spark, d), ["quarter", "weekday"], "rel", -DAY, 6 * HOUR, 8, 1e6).withColumn("grouping", F.col("grouping").cast("long"))


@query(f"""WITH {EV}, r AS (SELECT user_id, quarter, trial, row_number() OVER (PARTITION BY user_id ORDER BY quarter, trial) - 0.5 AS y FROM trials)
SELECT r.user_id, r.quarter, r.trial, CAST(r.y AS DOUBLE) AS y, h.rel FROM r JOIN hits h ON h.trial = r.trial AND h.user_id = r.user_id WHERE h.rel >= -3600000000 AND h.rel < 3600000000""")
def raster(spark, d):
    hits = _hits(spark, d, HOUR, HOUR)
    return rates.raster(hits, onsets(spark, d), ["user_id"], ["quarter"], "trial", "rel").select("user_id", "quarter", "trial", F.col("y").cast("double").alias("y"), "rel")


def _trains(spark, d):
    """(user_id, trial, times): spike times of each trial in hours from its onset; empty where it has none."""
    got = _hits(spark, d).groupBy("user_id", "trial").agg(F.array_sort(F.collect_list(F.col("rel") / HOUR)).alias("times"))
    return onsets(spark, d).join(got, ["user_id", "trial"], "left").withColumn("times", F.coalesce("times", F.array().cast("array<double>")))


@query(f"""WITH {EV} SELECT t.user_id, t.trial, round(count(h.rel) FILTER (WHERE h.rel / 3600000000.0 >= 1 AND h.rel / 3600000000.0 < 7) / 6.0, 6) AS rate,
round(count(h.rel) FILTER (WHERE h.rel / 3600000000.0 >= 1 AND h.rel / 3600000000.0 <= 7) / 6.0, 6) AS rate_closed FROM trials t LEFT JOIN hits h ON h.trial = t.trial AND h.user_id = t.user_id GROUP BY t.user_id, t.trial""")
def windowed_rate(spark, d):
    out = rates.windowed_rate(_trains(spark, d), "times", 1.0, 7.0)
    return rates.windowed_rate(out, "times", 1.0, 7.0, "both", "rate_closed").select("user_id", "trial", "rate", "rate_closed")


@query(f"""WITH {EV} SELECT t.user_id, t.trial, CAST(count(h.rel) FILTER (WHERE h.rel < 0) AS INTEGER) AS pre_count, CAST(count(h.rel) FILTER (WHERE h.rel >= 0) AS INTEGER) AS post_count,
round(count(h.rel) FILTER (WHERE h.rel < 0) / 24.0, 6) AS pre_rate, round(count(h.rel) FILTER (WHERE h.rel >= 0) / 24.0, 6) AS post_rate FROM trials t LEFT JOIN hits h ON h.trial = t.trial AND h.user_id = t.user_id GROUP BY t.user_id, t.trial""")
def pre_post_rate(spark, d):
    return rates.pre_post(_trains(spark, d), "times", 24, 24).select("user_id", "trial", "pre_count", "post_count", "pre_rate", "post_rate")


@query(f"""WITH {EV}, o AS (SELECT user_id, min(onset) AS o FROM trials GROUP BY user_id)
SELECT s.user_id, round(count(*) FILTER (WHERE s.us >= o.o - 864000000000 AND s.us < o.o) / 864000.0, 6) AS blank_rate FROM spikes s JOIN o USING (user_id) GROUP BY s.user_id""")
def blank_rate(spark, d):
    s = spikes(spark, d).withColumn("unit", F.col("user_id"))
    return rates.blank_rate(s, onsets(spark, d), ["user_id"], "unit", "us", "on", 10 * DAY, 1e6).select("user_id", "blank_rate")


@query(f"""WITH {EV}, w AS (SELECT user_id, trial, onset, lead(onset) OVER (PARTITION BY user_id ORDER BY onset, trial) AS stop FROM trials)
SELECT w.user_id, w.trial, round(CASE WHEN any_value(w.stop) > any_value(w.onset) THEN count(s.us) / ((any_value(w.stop) - any_value(w.onset)) / 3600000000.0) ELSE 0 END, 6) AS rate
FROM w LEFT JOIN spikes s ON s.user_id = w.user_id AND s.us >= w.onset AND s.us < w.stop WHERE w.stop IS NOT NULL GROUP BY w.user_id, w.trial""")
def trial_mean_rate(spark, d):
    w = Window.partitionBy("user_id").orderBy("on", "trial")
    trials = onsets(spark, d).withColumn("off", F.lead("on").over(w)).filter("off IS NOT NULL")
    hit = intervals.interval_join(spikes(spark, d), trials, ["user_id"], "us", "on", "off", 7 * DAY)
    return rates.mean_rate(hit, trials, ["user_id", "trial"], "on", "off", HOUR).select("user_id", "trial", "rate")


@query(f"""WITH {EV}, r AS (SELECT t.user_id, t.trial, count(*) / 12.0 AS rate FROM trials t JOIN spikes s ON s.user_id = t.user_id AND s.us >= t.onset + 3600000000 AND s.us < t.onset + 46800000000 GROUP BY ALL)
SELECT user_id, trial, round(rate, 6) AS rate FROM r""")
def delayed_response_rate(spark, d):
    s = spikes(spark, d).withColumn("unit", F.col("user_id"))
    return rates.response_rate(s, onsets(spark, d), ["user_id"], "unit", "trial", "us", "on", HOUR, 12 * HOUR, HOUR).select("user_id", "trial", "rate")


MUA = """g AS (SELECT CAST(r.bin AS INTEGER) AS bin FROM range(0, (SELECT (max(epoch_us(ts)) - 1704067200000000) // 3600000000 FROM events)) r(bin)),
c AS (SELECT CAST((epoch_us(ts) - 1704067200000000) // 3600000000 AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1),
mua AS (SELECT g.bin, coalesce(c.n, 0) AS n, CAST(1704067200000000 + g.bin * 3600000000 + 1800000000 AS DOUBLE) AS t, coalesce(c.n, 0) / 3600.0 AS rate FROM g LEFT JOIN c USING (bin))"""
START = 1_704_067_200_000_000


def _mua(spark, d):
    ev = events(spark, d)
    end = ev.agg(F.max("us")).first()[0]
    return rates.mua_rate(ev, [], "us", START, end, HOUR, 1e6)


@query(f"WITH {MUA} SELECT bin, n, t, round(rate, 6) AS rate FROM mua")
def mua_rate(spark, d):
    return _mua(spark, d)


@query(f"""WITH {MUA}, u AS (SELECT bin, rate, bin - row_number() OVER (ORDER BY bin) AS run FROM mua WHERE rate > (SELECT avg(rate) + 0.5 * stddev_pop(rate) FROM mua))
SELECT min(bin) AS "first", max(bin) AS "last", count(*) AS bins, round(max(rate), 6) AS peak FROM u GROUP BY run""")
def up_states(spark, d):
    return rates.up_states(_mua(spark, d), [])


@query("""SELECT CAST((epoch_us(ts) - 1704067200000000) // 86400000000 AS INTEGER) AS win, event_type AS unit, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events WHERE epoch_us(ts) >= 1704067200000000 GROUP BY 1, 2""")
def window_units(spark, d):
    out = rates.window_units(events(spark, d), "event_type", "us", START, DAY)
    return out.select("win", F.col("event_type").alias("unit"), "n", F.element_at("times", 1).alias("first_us"), F.element_at("times", -1).alias("last_us"))


#: One row a trial: its timing features and those derived from its bins.
TEMPORAL = f"""WITH {EV}, p AS (SELECT user_id, trial, rel, rel / 3600000000.0 AS sec, CAST(rel // 4320000000 AS INTEGER) AS b FROM hits WHERE rel >= 0),
c AS (SELECT user_id, trial, count(*) AS total, min(sec) AS f, max(sec) AS l, var_pop(sec) AS v FROM p GROUP BY ALL),
m AS (SELECT user_id, trial, b, count(*) AS n FROM p GROUP BY ALL),
top AS (SELECT user_id, trial, max(n) AS n, min(b) FILTER (WHERE r = 1) AS pk, count(*) AS k FROM (SELECT *, rank() OVER (PARTITION BY user_id, trial ORDER BY n DESC) AS r FROM m) GROUP BY ALL),
e AS (SELECT user_id, trial, sum(CASE WHEN b >= 13 THEN n ELSE 0 END) / 7.0 - sum(CASE WHEN b < 6 THEN n ELSE 0 END) / 6.0 AS lme, min(n) AS least FROM m GROUP BY ALL)
SELECT t.user_id, t.trial, coalesce(c.total, 0) AS total, round(coalesce(c.f, 24.0), 6) AS first_latency, round(coalesce(c.l, 0), 6) AS last_time, round(coalesce(c.v, 0), 4) AS time_var, round(coalesce(c.total, 0) / 24.0, 6) AS mean_rate,
round(coalesce(top.pk, 0) / 20.0, 6) AS peak_share, round((coalesce(top.n, 0) - CASE WHEN coalesce(top.k, 0) = 20 THEN e.least ELSE 0 END) / 1.2, 6) AS rate_range, round(coalesce(e.lme, 0) / 1.2, 6) AS late_minus_early
FROM trials t LEFT JOIN c USING (user_id, trial) LEFT JOIN top USING (user_id, trial) LEFT JOIN e USING (user_id, trial)"""


@query(TEMPORAL)
def temporal_features(spark, d):
    hits = _hits(spark, d).filter("rel >= 0")
    out = rates.temporal_features(hits, onsets(spark, d), ["user_id", "trial"], "rel", DAY, 20, HOUR)
    return out.drop("binned_counts", "binned_rates", "on", "quarter", "weekday").withColumn("time_var", F.round("time_var", 4))


@query(f"""WITH f AS ({TEMPORAL}), {EV}, bins AS (SELECT user_id, trial, least(CAST(floor(rel / 4320000000.0) AS INT), 19) AS b, count(*) / 1.2 AS r FROM hits WHERE rel >= 0 AND rel < 86400000000 GROUP BY ALL),
v AS (SELECT 'rates' AS family, 'bin_' || k AS feature, t.user_id, t.trial, coalesce(r, 0) AS x FROM trials t CROSS JOIN range(20) g(k) LEFT JOIN bins ON bins.user_id = t.user_id AND bins.trial = t.trial AND bins.b = k
UNION ALL SELECT 'timing', unnest(['first_latency', 'last_time', 'time_var', 'total']), user_id, trial, unnest([first_latency, last_time, time_var, total]) FROM f
UNION ALL SELECT 'derived', unnest(['peak_share', 'rate_range', 'late_minus_early']), user_id, trial, unnest([peak_share, rate_range, late_minus_early]) FROM f),
s AS (SELECT unnest(['binned_rates', 'spike_timing', 'combined', 'combined', 'all', 'all', 'all']) AS feature_set, unnest(['rates', 'timing', 'rates', 'timing', 'rates', 'timing', 'derived']) AS family)
SELECT feature_set, feature, count(*) AS n, round(sum(x), 2) AS total FROM v JOIN s USING (family) GROUP BY ALL""")
def feature_sets(spark, d):
    hits = _hits(spark, d).filter("rel >= 0")
    keys = ["user_id", "trial"]
    features = rates.temporal_features(hits, onsets(spark, d), keys, "rel", DAY, 20, HOUR).withColumn("time_var", F.round("time_var", 4))
    long = rates.feature_sets(features, keys)
    return long.groupBy("feature_set", "feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH {EV}, i AS (SELECT user_id, trial, rel - lag(rel) OVER (PARTITION BY user_id, trial ORDER BY rel) AS isi FROM hits)
SELECT user_id, count(*) AS n, min(isi) AS low, max(isi) AS high, round(avg(isi), 3) AS mean FROM i WHERE isi IS NOT NULL GROUP BY user_id""")
def inter_event_intervals(spark, d):
    out = rates.inter_event(_hits(spark, d), ["user_id", "trial"], "rel")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.min("isi").alias("low"), F.max("isi").alias("high"), F.round(F.avg("isi"), 3).alias("mean"))


@query(f"""WITH {EV}, q AS (SELECT user_id, trial, onset, onset + 7200000000 AS fall, lead(onset) OVER (PARTITION BY user_id ORDER BY onset) AS nxt FROM trials),
w AS (SELECT user_id, trial, 'display' AS phase, onset + 600000000 AS low, fall AS high FROM q UNION ALL SELECT user_id, trial, 'baseline', onset - 3600000000, onset FROM q
UNION ALL SELECT user_id, trial, 'iti', fall, least(fall + 10800000000, coalesce(nxt, fall + 10800000000)) FROM q)
SELECT w.phase, w.trial, count(*) AS n FROM w JOIN spikes s ON s.user_id = w.user_id AND s.us >= w.low AND s.us < w.high GROUP BY ALL""")
def phase_responses(spark, d):
    pulses = onsets(spark, d).select("user_id", "trial", F.col("on").alias("rise"), (F.col("on") + 2 * HOUR).alias("fall"))
    w = intervals.phase_windows(pulses, ["user_id"], HOUR // 6, HOUR, 3 * HOUR)
    hit = intervals.interval_join(spikes(spark, d), w, ["user_id"], "us", "low", "high", 3 * HOUR)
    return hit.groupBy("phase", "trial").agg(F.count("*").alias("n"))


@query(f"""WITH {EV} SELECT s.user_id, s.us, e.onset AS asof_edge, e.trial FROM spikes s ASOF LEFT JOIN (SELECT user_id, onset, trial FROM trials) e ON s.user_id = e.user_id AND s.us >= e.onset""")
def asof_lookup(spark, d):
    return intervals.asof(spikes(spark, d), onsets(spark, d), ["user_id"], "us", "on", ["trial"])


@query(f"""WITH {EV}, g AS (SELECT u.user_id, 1704067200000000 + k * 86400000000 AS moment FROM (SELECT DISTINCT user_id FROM ev) u, range(30) r(k)),
a AS (SELECT g.user_id, g.moment, e.us AS t0, e.value AS v0 FROM g ASOF LEFT JOIN ev e ON g.user_id = e.user_id AND g.moment >= e.us),
b AS (SELECT g.user_id, g.moment, e.us AS t1, e.value AS v1 FROM g ASOF LEFT JOIN ev e ON g.user_id = e.user_id AND g.moment < e.us)
SELECT user_id, moment, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = moment THEN v0 ELSE v0 + (moment - t0) / CAST(t1 - t0 AS DOUBLE) * (v1 - v0) END, 6) AS value_at FROM a JOIN b USING (user_id, moment)""")
def interp_linear(spark, d):
    ev = events(spark, d)
    grid = ev.select("user_id").distinct().withColumn("moment", F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.lit(START) + k.cast("long") * DAY)))
    return intervals.interpolated(grid, ev, ["user_id"], "moment", "us", "value")


@query(f"""WITH {EV}, g AS (SELECT u.user_id, 1704067200000000 + k * 86400000000 AS moment FROM (SELECT DISTINCT user_id FROM ev) u, range(30) r(k)),
a AS (SELECT g.user_id, g.moment, e.us AS t0, e.event_id AS e0 FROM g ASOF LEFT JOIN ev e ON g.user_id = e.user_id AND g.moment >= e.us),
b AS (SELECT g.user_id, g.moment, e.us AS t1, e.event_id AS e1 FROM g ASOF LEFT JOIN ev e ON g.user_id = e.user_id AND g.moment < e.us)
SELECT user_id, moment, CASE WHEN t0 IS NULL THEN t1 WHEN t1 IS NULL OR moment - t0 <= t1 - moment THEN t0 ELSE t1 END AS nearest, CASE WHEN t0 IS NULL THEN e1 WHEN t1 IS NULL OR moment - t0 <= t1 - moment THEN e0 ELSE e1 END AS event_id FROM a JOIN b USING (user_id, moment)""")
def nearest_match(spark, d):
    ev = events(spark, d)
    grid = ev.select("user_id").distinct().withColumn("moment", F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.lit(START) + k.cast("long") * DAY)))
    return intervals.nearest(grid, ev, ["user_id"], "moment", "us", ["event_id"])


@query(f"""WITH {EV}, s AS (SELECT user_id, min(onset) AS a0, max(onset) AS a1, CAST(min(trial) AS DOUBLE) AS b0, CAST(max(trial) AS DOUBLE) AS b1 FROM trials GROUP BY user_id HAVING count(*) > 1)
SELECT p.user_id, p.us, round(b0 + (p.us - a0) * (b1 - b0) / (a1 - a0), 6) AS t_mapped FROM spikes p JOIN s USING (user_id) WHERE p.us BETWEEN a0 AND a1""")
def clock_remap(spark, d):
    sync = onsets(spark, d).select("user_id", F.col("on").alias("t_a"), F.col("trial").cast("double").alias("t_b"))
    clocks = intervals.clock_map(sync, ["user_id"]).filter("a1 > a0")
    return intervals.remapped(spikes(spark, d), clocks, ["user_id"], "us").select("user_id", "us", "t_mapped")


STA = f"""{EV}, fr AS (SELECT user_id, onset, lead(onset, 1, onset + 86400000000) OVER (PARTITION BY user_id ORDER BY onset) AS nxt, CAST(trial % 9 AS INTEGER) AS pixel FROM trials),
on_frame AS (SELECT CAST(s.user_id % 10 AS INTEGER) AS unit, f.pixel FROM spikes s JOIN fr f ON s.user_id = f.user_id AND s.us - 3000000 >= f.onset AND s.us - 3000000 < f.nxt),
nn AS (SELECT unit, count(*) AS n_spikes FROM on_frame GROUP BY unit), px AS (SELECT unit, pixel, count(*) AS n FROM on_frame GROUP BY ALL)
SELECT nn.unit, CAST(p.pixel AS INTEGER) AS pixel, nn.n_spikes, round(coalesce(px.n, 0) / nn.n_spikes, 6) AS white, round(1 - coalesce(px.n, 0) / nn.n_spikes, 6) AS black FROM nn, range(9) p(pixel) LEFT JOIN px ON px.unit = nn.unit AND px.pixel = p.pixel"""


@query(f"WITH {STA}")
def spike_triggered_average(spark, d):
    frames = intervals.interval_index(onsets(spark, d), ["user_id"], "on", DAY).withColumnRenamed("on", "low")
    shifted = spikes(spark, d).withColumn("us", F.col("us") - 3_000_000)
    hit = intervals.interval_join(shifted, frames, ["user_id"], "us", "low", "high", 2 * DAY)
    hit = hit.select((F.col("user_id") % 10).cast("int").alias("unit"), F.col("trial").alias("frame"))
    pixels = onsets(spark, d).select(F.col("trial").alias("frame"), (F.col("trial") % 9).cast("int").alias("pixel"))
    return tuning.spike_triggered_average(hit, pixels, ["unit"], "frame", "pixel", 9)


@query(f"""WITH {EV}, dots AS (SELECT trial AS shown, user_id, onset, CAST(trial % 9 AS INTEGER) AS dot, CASE WHEN (trial // 9) % 2 = 0 THEN 'white' ELSE 'black' END AS polarity FROM trials),
h AS (SELECT CAST(s.user_id % 10 AS INTEGER) AS unit, dots.dot, dots.polarity FROM spikes s JOIN dots ON s.user_id = dots.user_id AND s.us > dots.onset + 3600000000 AND s.us < dots.onset + 39600000000),
n AS (SELECT unit, dot, polarity, count(*) AS n FROM h GROUP BY ALL), t AS (SELECT dot, polarity, count(*) AS t FROM dots GROUP BY ALL),
r AS (SELECT u.unit, t.dot, t.polarity, coalesce(n.n, 0) / t.t / 10.0 AS rate FROM (SELECT DISTINCT unit FROM h) u CROSS JOIN t LEFT JOIN n ON n.unit = u.unit AND n.dot = t.dot AND n.polarity = t.polarity),
b AS (SELECT unit, dot, max(rate) FILTER (WHERE polarity = 'white') AS white, max(rate) FILTER (WHERE polarity = 'black') AS black FROM r GROUP BY ALL)
SELECT unit, dot, round(white, 6) AS white, round(black, 6) AS black, round(white - black, 6) AS difference FROM b""")
def response_map(spark, d):
    dots = onsets(spark, d).select(F.col("trial").alias("shown"), "user_id", "on", (F.col("trial") % 9).cast("int").alias("dot"), F.when(F.floor(F.col("trial") / 9) % 2 == 0, "white").otherwise("black").alias("polarity"))
    w = dots.withColumns({"low": F.col("on") + HOUR, "high": F.col("on") + 11 * HOUR})
    hit = intervals.interval_join(spikes(spark, d), w, ["user_id"], "us", "low", "high", 10 * HOUR, closed="neither").select((F.col("user_id") % 10).cast("int").alias("unit"), "shown")
    return tuning.response_map(hit, dots.select("shown", "dot", "polarity"), ["unit"], "dot", "polarity", "shown", HOUR, 10 * HOUR)


@query(f"""WITH {EV}, n AS (SELECT t.user_id, t.trial, count(h.rel) AS n FROM trials t LEFT JOIN hits h ON h.trial = t.trial AND h.user_id = t.user_id GROUP BY ALL)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE n = 0) AS n_zero FROM n GROUP BY ROLLUP (user_id)""")
def zero_rate_report(spark, d):
    return selection.zero_rate_report(interval_join_counts(spark, d), "user_id", "n")


@query(f"""WITH {EV}, u AS (SELECT DISTINCT event_type AS unit FROM ev WHERE event_type <> 'purchase'), s AS (SELECT event_type AS unit, user_id, us FROM ev WHERE event_type <> 'purchase'),
t AS (SELECT * FROM trials), h AS (SELECT s.unit, t.trial FROM t JOIN s ON s.user_id = t.user_id AND s.us >= t.onset AND s.us < t.onset + 86400000000)
SELECT u.unit, t.trial, count(h.trial) AS n FROM u CROSS JOIN t LEFT JOIN h ON h.unit = u.unit AND h.trial = t.trial GROUP BY u.unit, t.trial""")
def dense_counts(spark, d):
    s = events(spark, d).filter("event_type <> 'purchase'").select("user_id", "us", F.col("event_type").alias("unit"))
    trials = onsets(spark, d)
    hit = intervals.interval_join(s, intervals.trial_windows(trials, "on", 0, DAY), ["user_id"], "us", "low", "high", DAY)
    return intervals.dense_counts(s, trials, hit, [], "unit", "trial").select("unit", "trial", "n")


@query(f"""WITH {EV}, n AS (SELECT t.quarter, t.trial, count(h.rel) AS n FROM trials t LEFT JOIN hits h ON h.trial = t.trial AND h.user_id = t.user_id GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE quarter = 0) AS n_a, count(*) FILTER (WHERE quarter = 2) AS n_b, avg(n) FILTER (WHERE quarter = 0) AS m_a, avg(n) FILTER (WHERE quarter = 2) AS m_b, var_samp(n) FILTER (WHERE quarter = 0) AS v_a, var_samp(n) FILTER (WHERE quarter = 2) AS v_b FROM n)
SELECT n_a, n_b, round(m_a - m_b, 6) AS difference, round((m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b)), 6) AS t, n_a + n_b - 2 AS dof FROM s""")
def t_independent(spark, d):
    n = interval_join_counts(spark, d).join(onsets(spark, d).select("user_id", "trial", "quarter"), ["user_id", "trial"])
    return decode.t_independent(n, [], "quarter", 0, 2, "n")


@query(f"""WITH {EV}, n AS (SELECT t.user_id, t.trial, count(h.rel) FILTER (WHERE h.rel < 0) AS a, count(h.rel) FILTER (WHERE h.rel >= 0) AS b FROM trials t LEFT JOIN hits h ON h.trial = t.trial AND h.user_id = t.user_id GROUP BY ALL),
s AS (SELECT user_id, count(*) AS n, avg(b - a) AS m, stddev_samp(b - a) AS s FROM n GROUP BY user_id)
SELECT user_id, n, round(m, 6) AS mean, round(CASE WHEN s > 0 THEN m / (s / sqrt(n)) END, 6) AS t, n - 1 AS dof FROM s""")
def t_paired(spark, d):
    return decode.t_paired(pre_post_rate(spark, d), ["user_id"], "post_count", "pre_count")


@query()
def t_paired_tails(spark, d):
    """Two-sided tails of t_paired(), with their stars; the tails come from a vectorised function (see the tests)."""
    t = decode.t_paired(pre_post_rate(spark, d), ["user_id"], "post_count", "pre_count").filter("dof > 0")
    return t.withColumn("p", t_tails(F.col("t"), F.col("dof"))).withColumn("mark", stars(F.col("p")))


@query("""SELECT user_id, count(*) AS trials, count(DISTINCT event_type) AS stimuli, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration FROM events GROUP BY user_id""")
def experiment_summary(spark, d):
    return logs.experiment_summary(events(spark, d), ["user_id"], "event_type", "us")


@query("""WITH u AS (SELECT o_custkey AS k, 1 AS r, o_orderstatus AS q, o_orderkey AS i FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, 2, o_orderstatus, o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'),
b AS (SELECT k, r, q, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS rn FROM u), f AS (SELECT k % 7 AS session, k, q FROM b WHERE rn = 1)
SELECT session, k AS unit, q AS quality, CAST(row_number() OVER (PARTITION BY session ORDER BY k) - 1 AS INTEGER) AS unit_index FROM f""")
def unit_catalogue(spark, d):
    o = table(spark, d, "orders")
    first = lambda p: o.filter(F.col("o_orderpriority") == p).groupBy((F.col("o_custkey") % 7).alias("session"), F.col("o_custkey").alias("unit")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("quality"))
    return logs.unit_catalogue([(1, first("1-URGENT")), (2, first("2-HIGH"))], ["session", "unit"])


@query(f"WITH s AS (SELECT DISTINCT user_id, epoch_us(ts) // {DAY} AS day, event_type FROM events) SELECT DISTINCT user_id, day FROM s ANTI JOIN (SELECT user_id, day FROM s WHERE event_type = 'error') e USING (user_id, day)")
def unprocessed_sessions(spark, d):
    """Days of each user on which nothing went wrong, as sessions that no result is known of."""
    days = events(spark, d).select("user_id", F.floor(F.col("us") / DAY).alias("day"), "event_type")
    return logs.unprocessed(days.select("user_id", "day").distinct(), days.filter("event_type = 'error'").select("user_id", "day"), ["user_id", "day"])


@query("""WITH d AS (SELECT DISTINCT user_id, event_type FROM events), f AS (SELECT user_id FROM d GROUP BY user_id HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)) SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM f) GROUP BY user_id""")
def pairs_in_all_sessions(spark, d):
    return intervals.in_all(events(spark, d), ["user_id"], "event_type").groupBy("user_id").agg(F.count("*").alias("n"))
