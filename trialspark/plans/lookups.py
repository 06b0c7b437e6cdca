"""Names, numbers in text, angles, choices of columns and units, and reports, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.functions import scalars
from trialspark.operators import pulses, rates, selection, signals, tuning
from trialspark.plans.base import DAY, EV, HOUR, MEANS, RESP, SAMPLES, events, query, responses, samples, table
from trialspark.sources import logs

UNITS = "u AS (SELECT p_partkey, p_brand, CASE p_size % 4 WHEN 1 THEN 'noise' WHEN 2 THEN 'Good' WHEN 3 THEN 'mua' END AS quality FROM part)"


def _units(spark, d):
    """Parts as units whose quality follows from their size; a fourth have none."""
    quality = F.when(F.col("p_size") % 4 == 1, "noise").when(F.col("p_size") % 4 == 2, "Good").when(F.col("p_size") % 4 == 3, "mua")
    return table(spark, d, "part").select("p_partkey", "p_brand", quality.alias("quality"))


@query(f"WITH {UNITS} SELECT p_partkey, p_brand, coalesce(quality, 'unknown') AS quality FROM u WHERE coalesce(quality, 'unknown') <> 'noise'")
def usable_units(spark, d):
    return selection.without_noise(selection.default_quality(_units(spark, d)))


@query(f"WITH {UNITS} SELECT p_brand, coalesce(lower(quality), 'unknown') AS quality, count(*) AS n FROM u GROUP BY ALL")
def quality_counts(spark, d):
    """Units of each quality, by shank."""
    return selection.default_quality(_units(spark, d)).groupBy("p_brand", F.lower("quality").alias("quality")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, concat('shank', s_nationkey, '_ks_unit', s_suppkey) AS unit_key, concat('shank', s_nationkey, '_unit', s_suppkey) AS short FROM supplier")
def unit_names(spark, d):
    key = scalars.unit_key(F.concat(F.lit("shank"), F.col("s_nationkey").cast("string")), F.lit("ks"), F.col("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", key.alias("unit_key"), scalars.short_unit(key).alias("short"))


@query("WITH c AS (SELECT *, CAST(c_custkey AS DOUBLE) AS k FROM customer) SELECT c_custkey, k - 0.5 AS low, k + 2.25 AS high, k * 2 + 1 AS listed, k + 3.5 AS named, k AS share, k + 1.5 AS seconds, k + 45 AS pair_sum, lower(replace(c_mktsegment || ' Group', ' ', '_')) AS segment_key FROM c")
def text_numbers(spark, d):
    """Numbers read out of text that each customer's row is written into."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    span = scalars.number_range(text(k - F.lit(0.5), "..", k + F.lit(2.25)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    pairs = scalars.pair_list(text(k, ":45"))
    return table(spark, d, "customer").select(
        "c_custkey", span["low"].alias("low"), span["high"].alias("high"), total(scalars.number_list(text("[", k, ", ", k + 1, "]"))).alias("listed"),
        total(scalars.signed_decimals(text("x ", k, " y 3.5"))).alias("named"), scalars.percent(text("hit rate ", k, " %")).alias("share"), scalars.seconds_of(text(k + F.lit(1.5), "s")).alias("seconds"),
        (pairs[0]["a"] + pairs[0]["b"]).alias("pair_sum"), scalars.normal_key(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("  Group "))).alias("segment_key"),
    )


@query("WITH o AS (SELECT o_custkey, o_orderdate + INTERVAL 10 YEAR AS d FROM orders) SELECT o_custkey, CAST(date_diff('day', min(d), max(d)) + 1 AS INTEGER) AS n_days, strftime(min(d), '%y%m%d') AS first_day, strftime(max(d), '%y%m%d') AS last_day, strftime(max(d), '%Y%m%d_%H%M') AS last_key FROM o GROUP BY o_custkey")
def session_days(spark, d):
    """The days from each customer's first order to the last, ten years on, as file names of this century write them."""
    o = table(spark, d, "orders").withColumn("at", (F.col("o_orderdate") + F.expr("INTERVAL 10 YEARS")).cast("timestamp"))
    ends = o.groupBy("o_custkey").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    days = scalars.date_range(F.date_format("a", "yyMMdd"), F.date_format("b", "yyMMdd"))
    name = F.concat(F.lit("rec_"), F.date_format("b", "yyyy-MM-dd_HH-mm-ss"), F.lit(".log"))
    return ends.select("o_custkey", F.size(days).alias("n_days"), days[0].alias("first_day"), F.element_at(days, -1).alias("last_day"), scalars.time_key(scalars.name_time(name)).alias("last_key"))


@query("SELECT p_partkey, round(degrees(atan(p_size / 2.0 / 57)), 6) AS degrees, round(2 * 57 * tan(radians(0.5)) * 1920 / (p_size + 20), 6) AS pixels, CAST((p_partkey) // 12 AS INTEGER) AS dot_row, CAST(p_partkey % 12 AS INTEGER) AS dot_col, CASE WHEN round(cos(radians(p_partkey % 16 * 22.5)), 12) >= 0 THEN 1 ELSE -1 END AS direction FROM part")
def screen_angles(spark, d):
    size, dot = F.col("p_size").cast("double"), F.col("p_partkey") + 1
    place = scalars.dot_place(dot, 12)
    return table(spark, d, "part").select("p_partkey", scalars.visual_angle(size, F.lit(57.0)).alias("degrees"), scalars.pixels_per_degree(F.lit(1920), size + 20, F.lit(57.0)).alias("pixels"), place["row"].alias("dot_row"), place["col"].alias("dot_col"), scalars.drift_direction(F.col("p_partkey") % 16 * 22.5).alias("direction"))


TRAINS = f"h AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) // {HOUR} AS hour FROM events), d AS (SELECT user_id, hour - lag(hour) OVER (PARTITION BY user_id ORDER BY hour) AS step FROM h)"


def _trains(spark, d):
    """Each user's hours of events, in order."""
    hour = F.floor((F.col("us") - 1704067200000000) / HOUR)
    return events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(hour)).alias("times"))


@query(f"WITH {TRAINS} SELECT user_id, count(step) AS n_steps, round(avg(step), 6) AS mean_step, round(var_pop(step), 6) AS var_step FROM d GROUP BY user_id")
def train_steps(spark, d):
    steps = F.transform(scalars.steps(F.col("times")), lambda x: x.cast("double"))
    return _trains(spark, d).select("user_id", F.size(steps).cast("long").alias("n_steps"), scalars.array_mean(steps).alias("mean_step"), scalars.array_var(steps).alias("var_step"))


@query(f"WITH {TRAINS} SELECT user_id, round(count(*) FILTER (WHERE hour BETWEEN 12 AND 36) / 24.0, 6) AS rate, round(count(*) FILTER (WHERE hour >= 12 AND hour < 36) / 24.0, 6) AS half_open FROM h GROUP BY user_id")
def closed_rate(spark, d):
    """Rates in a window with both ends, beside those without the last."""
    both = rates.windowed_rate(_trains(spark, d), "times", 12, 36, closed="both")
    return rates.windowed_rate(both, "times", 12, 36, name="half_open").select("user_id", "rate", "half_open")


@query(f"WITH {RESP}, g AS (SELECT DISTINCT unit, tf FROM resp), p AS (SELECT g.*, CAST(t.k * 22.5 AS DOUBLE) AS theta FROM g, range(8) t(k)) SELECT p.unit, p.tf, p.theta, count(r.rate) AS n, round(coalesce(avg(r.rate), 0), 6) AS mean FROM p LEFT JOIN resp r ON r.unit = p.unit AND r.tf = p.tf AND r.theta = p.theta GROUP BY ALL")
def dense_curve(spark, d):
    """A curve for each temporal frequency, with 0 where a unit has no response."""
    return rates.dense_curve(responses(spark, d), ["unit", "tf"], "theta", [22.5 * k for k in range(8)], "rate")


@query(f"WITH {RESP} SELECT theta AS orientation, count(*) AS n FROM resp GROUP BY theta")
def chosen_orientation(spark, d):
    """Neither the wanted column nor the default is there: the one whose name has ori is taken."""
    r = responses(spark, d).withColumnRenamed("theta", "stim_ori")
    return r.select(selection.orientation_column(r, "angle").alias("orientation")).groupBy("orientation").agg(F.count("*").alias("n"))


@query(f"WITH {RESP}, r AS (SELECT l_orderkey, theta, row_number() OVER (PARTITION BY l_orderkey ORDER BY sf, theta) - 1 AS place FROM resp) SELECT l_orderkey, CAST(place AS INTEGER) AS place, theta AS orientation FROM r")
def parameter_orientation(spark, d):
    """Orders as trials with an array of parameter records, an item each."""
    record = F.struct("sf", F.col("theta").alias("orientation"))
    trials = responses(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(record)).alias("params"))
    return selection.parameter_orientation(trials, ["l_orderkey"], "params")


@query(f"WITH {EV} SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS most FROM ev GROUP BY event_type")
def described(spark, d):
    return selection.described(events(spark, d), ["event_type"], "value")


@query(f"WITH {SAMPLES}, i AS (SELECT channel AS feature, round(avg(abs(value)), 9) AS importance FROM samples GROUP BY channel) SELECT feature, round(importance, 6) AS importance FROM i ORDER BY i.importance DESC, feature LIMIT 15")
def top_features(spark, d):
    """The fifteen features of the greatest mean absolute value."""
    i = samples(spark, d).groupBy(F.col("channel").alias("feature")).agg(F.round(F.avg(F.abs("value")), 9).alias("importance"))
    return selection.top(i, "importance", 15, ["feature"]).select("feature", "importance")


@query(f"""WITH {MEANS}, v AS (SELECT unit, sum(mean * cos(2 * radians(theta))) AS x, sum(mean * sin(2 * radians(theta))) AS y FROM means GROUP BY unit), h AS (SELECT degrees(atan2(y, x)) / 2 AS h FROM v)
SELECT CAST(floor(CASE WHEN h < 0 THEN h + 180 ELSE h END / 22.5) AS INTEGER) AS bin, count(*) AS n FROM h GROUP BY 1""")
def angle_histogram(spark, d):
    """Units by preferred orientation, in eight bins."""
    means = responses(spark, d).groupBy("unit", "theta").agg(F.avg("rate").alias("mean"))
    preferred = tuning.gosi_vector(means, ["unit"], "theta", "mean")
    return rates.histogram(preferred, [], "preferred_vector", 0.0, 22.5, 8).filter("n > 0")


CLEANED = f"""{SAMPLES}, s AS (SELECT channel // 16 AS shank, channel, sample, value, CASE WHEN sample % 3 = 0 THEN value / 2 ELSE value END AS cleaned FROM samples), norms AS (SELECT shank, channel, sample // 20 AS chunk, sqrt(sum(value * value)) AS norm FROM s GROUP BY ALL),
m AS (SELECT shank, channel, avg(norm) + 2 * stddev_pop(norm) AS t FROM norms GROUP BY ALL), bad AS (SELECT DISTINCT n.shank, n.chunk FROM norms n JOIN m USING (shank, channel) WHERE n.norm > m.t), nb AS (SELECT shank, count(*) AS n_bad FROM bad GROUP BY shank),
r AS (SELECT shank, channel, sample // 100 AS win, 100 * (1 - sqrt(avg(cleaned * cleaned)) / sqrt(avg(value * value))) AS reduction FROM s GROUP BY ALL), l AS (SELECT shank, count(DISTINCT sample) AS samples FROM s GROUP BY shank)"""


@query(f"WITH {CLEANED} SELECT CAST(shank AS INTEGER) AS shank, coalesce(n_bad, 0) AS n_bad, round(100 * least(1.0, coalesce(n_bad, 0) * 20 / samples), 6) AS share_of_time, round(coalesce(n_bad, 0) / (samples / 500.0 / 60), 6) AS per_minute, round(avg(reduction), 6) AS reduction_mean, round(median(reduction), 6) AS reduction_median, round(min(reduction), 6) AS reduction_least, round(max(reduction), 6) AS reduction_most FROM r JOIN l USING (shank) LEFT JOIN nb USING (shank) GROUP BY shank, n_bad, samples")
def artifact_summary(spark, d):
    """What was found and lost by shank, where cleaning halves every third sample."""
    raw = samples(spark, d).withColumn("shank", F.floor(F.col("channel") / 16).cast("int"))
    cleaned = raw.withColumn("value", F.when(F.col("sample") % 3 == 0, F.col("value") / 2).otherwise(F.col("value")))
    bad = signals.artifact_chunks(signals.chunk_norms(raw, ["shank", "channel"], "sample", "value", 20), ["channel"], 20, k=2.0, recording=("shank",))
    report = signals.artifact_report(raw, cleaned, ["shank", "channel"], "sample", "value", 100)
    lengths = raw.groupBy("shank").agg(F.count_distinct("sample").alias("samples"))
    return signals.artifact_summary(report, bad, lengths, ["shank"], 20, 500.0)


@query("""WITH n AS (SELECT count(*) AS n FROM events GROUP BY user_id), m AS (SELECT round(avg(n), 6) AS mean_trials, min(n) AS least_trials, max(n) AS most_trials FROM n)
SELECT count(DISTINCT user_id) AS recordings, count(*) AS trials, count(DISTINCT event_type) AS stimuli, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration, count(value) AS n_values, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, any_value(mean_trials) AS mean_trials, any_value(least_trials) AS least_trials, any_value(most_trials) AS most_trials FROM events, m""")
def session_report(spark, d):
    return logs.session_report(events(spark, d), ["user_id"], "event_type", "us", "value")


@query("SELECT event_id, CAST(round_even(value * 500, 0) AS BIGINT) AS sample, CAST(round_even(CAST(event_id AS DOUBLE) / 2, 0) AS BIGINT) AS half FROM events")
def sample_numbers(spark, d):
    """Seconds as sample numbers; halves go to the even number."""
    return events(spark, d).select("event_id", pulses.to_samples(F.col("value"), 500.0).alias("sample"), pulses.to_samples(F.col("event_id"), 0.5).alias("half"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y%m%d_%H%M') END AS at, CASE WHEN o_orderkey % 3 = 0 THEN 'run ' || o_orderkey END AS other, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent,
CASE WHEN o_orderkey % 4 = 0 THEN CAST(0.5 AS DOUBLE) WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey % 5 AS DOUBLE) + 1.5 ELSE 2.0 END AS seconds FROM orders""")
def text_fallbacks(spark, d):
    """Times, flags and durations out of text: a text that is no time stays, an override goes before a text and that before the default."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    told = scalars.time_or_text(F.when(k % 3 == 0, F.concat(F.lit("run "), k.cast("string"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    high = scalars.flag(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), " Yes").otherwise("OFF"))
    length = F.when(k % 4 == 1, F.concat((F.col("o_custkey") % 5 + F.lit(1.5)).cast("string"), F.lit("s"))).when(k % 4 == 2, "unknown")
    seconds = scalars.duration(length, 2.0, F.when(k % 4 == 0, F.lit(0.5)))
    return o.select("o_orderkey", scalars.time_key(told["time"]).alias("at"), told["text"].alias("other"), high.alias("urgent"), seconds.alias("seconds"))


NAMES = """n AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'notes' ELSE 'm' || o_custkey % 4 || '_' || strftime(o_orderdate, '%y%m%d') || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '_s' || o_orderkey END END AS name, o_orderkey AS k, 'm' || o_custkey % 4 AS animal, strftime(o_orderdate, '%y%m%d') AS date FROM orders)"""


@query(f"WITH {NAMES} SELECT animal, date, CASE WHEN k % 5 <> 0 THEN 's' || k END AS session, name FROM n WHERE k % 7 <> 0 AND animal IN ('m1', 'm2') AND date BETWEEN '950301' AND '960210'")
def found_sessions(spark, d):
    """Recordings of two animals in a range of days, out of folder names of which some are malformed or have no session."""
    k, animal = F.col("o_orderkey"), F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string"))
    session = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("_s"), k.cast("string")))
    name = F.when(k % 7 == 0, "notes").otherwise(F.concat(animal, F.lit("_"), F.date_format("o_orderdate", "yyMMdd"), session))
    return logs.discover_sessions(spark, table(spark, d, "orders").select(name.alias("name")), "950301", "960210", ["m1", "m2"])


@query(f"WITH s AS (SELECT user_id, epoch_us(ts) // {DAY} AS day, max(CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS worst FROM events GROUP BY ALL) SELECT CASE worst WHEN 2 THEN 'failed' WHEN 1 THEN 'processed' ELSE 'skipped' END AS status, count(*) AS n FROM s GROUP BY 1")
def run_statuses(spark, d):
    """Users' days as sessions: failed with an error, else processed with a purchase, else skipped."""
    worst = F.max(F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0))
    days = events(spark, d).groupBy("user_id", F.floor(F.col("us") / DAY).alias("day")).agg(worst.alias("worst"))
    status = F.when(F.col("worst") == 2, "failed").when(F.col("worst") == 1, "processed").otherwise("skipped")
    return logs.run_summary(days.withColumn("status", status))


@query(f"WITH {TRAINS} SELECT user_id, CAST(min(hour) * 1000 AS BIGINT) AS first_ms, CAST(max(hour) * 1000 AS BIGINT) AS last_ms, count(*) FILTER (WHERE hour < 300) AS n_before, count(*) FILTER (WHERE hour >= 300) AS n_after, CAST(min(hour - 300) FILTER (WHERE hour >= 300) AS BIGINT) AS latency FROM h GROUP BY user_id")
def train_sides(spark, d):
    """Each user's train about the 300th hour: counts before and after, the first time after it, and both ends in milliseconds."""
    sides = scalars.before_and_after(F.col("times"), F.lit(300))
    ms = scalars.millis(F.col("times"))
    ends = [F.element_at(ms, k).cast("bigint").alias(n) for k, n in ((1, "first_ms"), (-1, "last_ms"))]
    sized = lambda c: F.size(sides[c]).cast("bigint").alias(f"n_{c}")
    return _trains(spark, d).select("user_id", *ends, sized("before"), sized("after"), F.try_element_at(sides["after"], F.lit(1)).cast("bigint").alias("latency"))


@query(f"WITH {RESP} SELECT unit, theta, rate FROM resp SEMI JOIN (SELECT s_suppkey AS unit FROM supplier WHERE s_acctbal > 0) g USING (unit)")
def good_unit_events(spark, d):
    """Orientation and rate alone, of suppliers in credit as good units."""
    good = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("unit"))
    return selection.events_of(responses(spark, d), good, ["unit"], ["unit", "theta", "rate"])


@query(f"WITH {RESP} SELECT unit, l_orderkey, sf, rate, CAST(row_number() OVER (PARTITION BY unit ORDER BY rate, l_orderkey, sf) - 1 AS INTEGER) AS place FROM resp WHERE theta = 45")
def trials_by_class(spark, d):
    """Trials of one orientation, in order of their response's class and then as recorded."""
    one = selection.with_label(responses(spark, d), "theta", 45.0)
    return selection.class_order(one, ["unit"], "rate", ["l_orderkey", "sf"]).select("unit", "l_orderkey", "sf", "rate", "place")
