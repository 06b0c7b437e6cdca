"""Tuning of units: suppliers are units, parts give 8 orientations, line numbers spatial frequencies, quantities responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.functions.stats import f_tail
from trialspark.operators import rates, selection, tuning
from trialspark.plans.base import MEANS, RESP, query, responses, table


def _means(spark, d):
    return rates.condition_stats(responses(spark, d), ["unit", "theta"], "rate").select("unit", "theta", "mean")


@query(f"WITH {RESP} SELECT unit, theta, sf, l_orderkey, l_partkey, rate, CAST(row_number() OVER (PARTITION BY unit, theta, sf ORDER BY l_orderkey, l_partkey, rate) - 1 AS INTEGER) AS repeat_idx FROM resp")
def repeat_idx(spark, d):
    return tuning.repeat_idx(responses(spark, d), ["unit"], ["theta", "sf"], ["l_orderkey", "l_partkey", "rate"]).select("unit", "theta", "sf", "l_orderkey", "l_partkey", "rate", "repeat_idx")


@query(f"WITH {RESP} SELECT unit, theta, sf, tf, count(*) AS n, round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) AS sd, round(stddev_pop(rate) / sqrt(count(*)), 6) AS sem FROM resp GROUP BY ALL")
def condition_tensor(spark, d):
    return rates.condition_stats(responses(spark, d), ["unit", "theta", "sf", "tf"], "rate")


@query(f"WITH {RESP} SELECT unit, theta, count(*) AS n, round(avg(rate), 6) AS mean, round(stddev_samp(rate), 6) AS sd, round(stddev_samp(rate) / sqrt(count(*)), 6) AS sem FROM resp GROUP BY ALL")
def condition_mean_sem(spark, d):
    return rates.condition_stats(responses(spark, d), ["unit", "theta"], "rate", ddof=1)


@query(f"WITH {RESP}, v AS (SELECT unit, theta, sf, dense_rank() OVER (PARTITION BY unit ORDER BY theta) - 1 AS theta_index, dense_rank() OVER (PARTITION BY unit ORDER BY sf) - 1 AS sf_index FROM resp) SELECT unit, theta, sf, CAST(theta_index AS INTEGER) AS theta_index, CAST(sf_index AS INTEGER) AS sf_index, count(*) AS n FROM v GROUP BY ALL")
def condition_indices(spark, d):
    out = tuning.condition_index(tuning.condition_index(responses(spark, d), ["unit"], "theta"), ["unit"], "sf")
    return out.groupBy("unit", "theta", "sf", "theta_index", "sf_index").agg(F.count("*").alias("n"))


OSI = """ix AS (SELECT *, dense_rank() OVER (PARTITION BY unit ORDER BY theta) - 1 AS i FROM m3), nn AS (SELECT *, max(i) OVER (PARTITION BY unit) + 1 AS n FROM ix),
b AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY mean DESC, theta, sf) AS r FROM nn), p AS (SELECT unit, sf, theta AS preferred, mean AS r_pref, (i + n // 2) % n AS i FROM b WHERE r = 1)"""


@query(f"""WITH {RESP}, m3 AS (SELECT unit, theta, sf, avg(rate) AS mean FROM resp GROUP BY ALL), {OSI}
SELECT p.unit, p.sf, p.preferred, round(p.r_pref, 6) AS r_pref, round(o.mean, 6) AS r_orth, round(CASE WHEN p.r_pref + o.mean > 0 THEN (p.r_pref - o.mean) / (p.r_pref + o.mean) ELSE 0 END, 6) AS osi FROM p LEFT JOIN ix o ON o.unit = p.unit AND o.sf = p.sf AND o.i = p.i""")
def osi(spark, d):
    means = rates.condition_stats(responses(spark, d), ["unit", "theta", "sf"], "rate").select("unit", "theta", "sf", "mean")
    return tuning.osi(means, ["unit"], "theta", "mean", ["sf"])


VEC = "v AS (SELECT unit, sum(mean * cos(radians(theta * 2))) AS x, sum(mean * sin(radians(theta * 2))) AS y, sum(mean) AS t FROM means GROUP BY unit)"


@query(f"""WITH {MEANS}, {VEC}, g AS (SELECT unit, sqrt(x * x + y * y) / t AS gosi, degrees(atan2(y, x)) / 2 AS h FROM v)
SELECT unit, round(gosi, 6) AS gosi, round(CASE WHEN h < 0 THEN h + 180 ELSE h END, 6) AS preferred_vector, round(1 - gosi, 6) AS circular_variance FROM g""")
def gosi_vector(spark, d):
    return tuning.gosi_vector(_means(spark, d), ["unit"], "theta", "mean")


@query(f"""WITH {MEANS}, b AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY mean DESC, theta) AS r FROM means), p AS (SELECT unit, theta AS preferred, mean AS rp FROM b WHERE r = 1),
a AS (SELECT m.unit, m.theta, m.mean, p.preferred, p.rp, (abs(m.theta - p.preferred - 90) % 180) AS e FROM means m JOIN p USING (unit)), o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY least(e, 180 - e), theta) AS r FROM a)
SELECT unit, preferred, round(CASE WHEN rp + mean > 0 THEN (rp - mean) / (rp + mean) ELSE 0 END, 6) AS gosi_pref_orth FROM o WHERE r = 1""")
def gosi_pref_orth(spark, d):
    return tuning.gosi_pref_orth(_means(spark, d), ["unit"], "theta", "mean")


@query(f"WITH {MEANS}, s AS (SELECT unit, max(mean) AS h, min(mean) AS l FROM means GROUP BY unit) SELECT unit, round(h, 6) AS high, round(l, 6) AS low, round(CASE WHEN h > 0 THEN (h - l) / h ELSE 0 END, 6) AS osi_max, round(CASE WHEN h + l > 0 THEN (h - l) / (h + l) ELSE 0 END, 6) AS modulation_depth FROM s")
def modulation(spark, d):
    return tuning.modulation(_means(spark, d), ["unit"], "mean")


@query(f"""WITH {RESP}, m AS (SELECT unit, theta, sf, count(*) AS n, avg(rate) AS mean, sum(rate * rate) AS q FROM resp GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY mean DESC, theta, sf) AS r FROM m),
s AS (SELECT m.unit, m.theta AS preferred, max(m.mean) AS r_max, min(m.mean) AS r_min, sum(m.q - m.n * m.mean * m.mean) AS sse, sum(m.n) AS n, count(*) AS k FROM m JOIN b ON b.unit = m.unit AND b.theta = m.theta AND b.r = 1 GROUP BY m.unit, m.theta)
SELECT unit, preferred, round(r_max, 6) AS r_max, round(r_min, 6) AS r_min, round(sse, 4) AS sse, round((r_max - r_min) / (r_max + r_min + CASE WHEN n > k THEN sse / (n - k) ELSE 0 END), 6) AS sfdi FROM s""")
def sfdi(spark, d):
    return tuning.sfdi(responses(spark, d), ["unit"], "theta", "sf", "rate").withColumn("sse", F.round("sse", 4))


@query(f"""WITH {RESP}, m AS (SELECT unit, theta, tf, avg(rate) AS mean FROM resp GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY mean DESC, theta, tf) AS r FROM m),
s AS (SELECT m.unit, m.theta AS preferred, max(m.mean) AS a, min(m.mean) AS z FROM m JOIN b ON b.unit = m.unit AND b.theta = m.theta AND b.r = 1 GROUP BY m.unit, m.theta) SELECT unit, preferred, round((a - z) / (a + z), 6) AS index FROM s""")
def tf_discrimination(spark, d):
    means = rates.condition_stats(responses(spark, d), ["unit", "theta", "tf"], "rate")
    return tuning.factor_index(means, ["unit"], "theta", "tf", "mean")


ANOVA = f"""{RESP}, g AS (SELECT unit, theta, count(*) AS n, sum(rate) AS s, sum(rate * rate) AS q FROM resp GROUP BY ALL),
an AS (SELECT unit, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS ssb, sum(q - s * s / n) AS ssw FROM g GROUP BY unit)"""


@query(f"WITH {ANOVA} SELECT unit, k, n, round(ssb, 4) AS ss_between, round(ssw, 4) AS ss_within, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f_stat FROM an")
def anova(spark, d):
    out = tuning.anova(responses(spark, d), ["unit"], "theta", "rate")
    return out.withColumns({c: F.round(c, 4) for c in ("ss_between", "ss_within")})


@query()
def anova_tails(spark, d):
    """The F statistics' tails, from a vectorised function (see the tests), and whether a unit is tuned."""
    out = tuning.anova(responses(spark, d), ["unit"], "theta", "rate")
    p = f_tail(F.col("f_stat"), F.col("k") - 1, F.col("n") - F.col("k"))
    return out.select("unit", "f_stat", p.alias("p")).withColumn("tuned", F.col("p") < 0.05)


@query(f"""WITH {RESP}, s AS (SELECT unit, theta, avg(rate) AS mean, stddev_pop(rate) / sqrt(count(*)) AS sem FROM resp GROUP BY ALL), w AS (SELECT *, avg(mean) OVER (PARTITION BY unit) AS m, nullif(stddev_pop(mean) OVER (PARTITION BY unit), 0) AS sd FROM s)
SELECT unit, theta, round((mean - m) / sd, 6) AS z, round(avg(sem / sd) OVER (PARTITION BY unit), 6) AS z_noise FROM w""")
def z_tuning(spark, d):
    stats = rates.condition_stats(responses(spark, d), ["unit", "theta"], "rate")
    return tuning.z_tuning(stats, ["unit"]).select("unit", "theta", "z", "z_noise")


@query()
def tuning_fit(spark, d):
    """Grid fits of circular Gaussians; the tests hold them against a dense search."""
    return tuning.tuning_fit(_means(spark, d), ["unit"], "theta", "mean")


@query()
def fitted_curves(spark, d):
    fits = tuning.tuning_fit(_means(spark, d), ["unit"], "theta", "mean")
    return tuning.tuning_curve(fits).select("unit", "theta", "response")


@query(f"""WITH {MEANS}, {VEC}, g AS (SELECT unit, sqrt(x * x + y * y) / t AS gosi, degrees(atan2(y, x)) / 2 AS h FROM v)
SELECT count(*) AS n_units, round(median(gosi), 6) AS median_gosi, round(median(CASE WHEN h < 0 THEN h + 180 ELSE h END), 6) AS median_preferred, round(avg(CASE WHEN gosi > 0.05 THEN 1.0 ELSE 0 END), 6) AS tuned_share FROM g""")
def population_summary(spark, d):
    m = tuning.gosi_vector(_means(spark, d), ["unit"], "theta", "mean")
    return tuning.population_summary(m.withColumn("tuned", F.col("gosi") > 0.05), "preferred_vector", "gosi", "tuned")


@query(f"""WITH {MEANS}, {VEC}, g AS (SELECT unit, sqrt(x * x + y * y) / t AS gosi FROM v) SELECT CAST(least(floor((gosi - 0.0) / 0.01), 19) AS INTEGER) AS bin, count(*) AS n FROM g WHERE gosi >= 0 AND gosi <= 0.2 GROUP BY 1""")
def gosi_histogram(spark, d):
    m = tuning.gosi_vector(_means(spark, d), ["unit"], "theta", "mean")
    return rates.histogram(m, [], "gosi", 0.0, 0.01, 20).filter("n > 0")


@query(f"WITH {MEANS}, {VEC}, g AS (SELECT unit, sqrt(x * x + y * y) / t AS gosi FROM v) SELECT unit, round(gosi, 6) AS gosi FROM g ORDER BY g.gosi DESC, unit LIMIT 10")
def top_units(spark, d):
    m = tuning.gosi_vector(_means(spark, d), ["unit"], "theta", "mean")
    return selection.top(m, "gosi", 10, ["unit"]).select("unit", "gosi")


@query(f"""WITH {RESP}, r AS (SELECT theta, sf, tf, avg(rate) AS score FROM resp GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY theta ORDER BY score DESC, sf, tf) AS a, row_number() OVER (PARTITION BY theta ORDER BY score, sf, tf) AS b FROM r)
SELECT x.theta, x.sf AS best_sf, x.tf AS best_tf, round(x.score, 6) AS best_score, y.sf AS worst_sf, y.tf AS worst_tf, round(y.score, 6) AS worst_score FROM w x JOIN w y ON x.theta = y.theta AND x.a = 1 AND y.b = 1""")
def best_worst(spark, d):
    r = rates.condition_stats(responses(spark, d), ["theta", "sf", "tf"], "rate").withColumnRenamed("mean", "score")
    out = selection.best_worst(r, ["theta"], "score", ["sf", "tf"])
    return out.select("theta", F.col("best.sf").alias("best_sf"), F.col("best.tf").alias("best_tf"), "best_score", F.col("worst.sf").alias("worst_sf"), F.col("worst.tf").alias("worst_tf"), "worst_score")


@query(f"WITH {RESP}, f AS (SELECT unit, sf, tf, theta, avg(rate) AS v FROM resp GROUP BY ALL), t AS (SELECT unit, sf, tf FROM f GROUP BY ALL HAVING count(*) = 8) SELECT unit, sf, tf, theta, round(v, 6) AS v FROM f SEMI JOIN t USING (unit, sf, tf)")
def valid_trials(spark, d):
    """Of each unit's conditions, those with a mean at all eight orientations."""
    f = responses(spark, d).groupBy("unit", "sf", "tf", "theta").agg(F.avg("rate").alias("v"))
    return selection.valid_trials(f, ["unit", "sf", "tf"], "v", 8)


@query("""SELECT CAST(l_linenumber AS INTEGER) AS trial, l_shipdate IS NOT NULL AS known, CASE WHEN l_returnflag = 'R' THEN 'x' ELSE 'y' END AS "left", CASE WHEN l_returnflag = 'R' THEN 'y' ELSE 'x' END AS "right", count(*) AS n FROM lineitem GROUP BY ALL""")
def left_right(spark, d):
    from trialspark.operators.intervals import left_right as sides

    li = table(spark, d, "lineitem").withColumns({"target_position": F.when(F.col("l_returnflag") == "R", "LEFT").otherwise("RIGHT"), "target": F.lit("x"), "distractor": F.lit("y")})
    return sides(li).groupBy(F.col("l_linenumber").alias("trial"), F.col("l_shipdate").isNotNull().alias("known"), "left", "right").agg(F.count("*").alias("n"))


@query(f"WITH {RESP} SELECT unit, CAST(class AS INTEGER) AS class, count(*) AS n FROM (SELECT unit, theta, dense_rank() OVER (ORDER BY theta) - 1 AS class FROM resp) GROUP BY ALL")
def encoded_labels(spark, d):
    return selection.encoded(responses(spark, d), "theta").groupBy("unit", "class").agg(F.count("*").alias("n"))


@query(f"WITH {RESP} SELECT unit, CAST(theta = 90 AS INTEGER) AS class, count(*) AS n FROM resp WHERE theta IN (0, 90) GROUP BY ALL")
def pair_subset(spark, d):
    return selection.pair_subset(responses(spark, d), "theta", 0.0, 90.0).groupBy("unit", "class").agg(F.count("*").alias("n"))


@query(f"WITH {RESP}, m(theta, name) AS (VALUES (0.0, 'horizontal'), (90.0, 'vertical')) SELECT r.theta, m.name, count(*) AS n FROM resp r LEFT JOIN m ON m.theta = r.theta GROUP BY ALL")
def orientation_lookup(spark, d):
    from trialspark.operators.intervals import lookup

    return lookup(responses(spark, d), "theta", {0.0: "horizontal", 90.0: "vertical"}, "name", "string").groupBy("theta", "name").agg(F.count("*").alias("n"))


ZN = f"{RESP}, zs AS (SELECT unit, theta, avg(rate) AS mean, stddev_pop(rate) / sqrt(count(*)) AS sem FROM resp GROUP BY ALL), zw AS (SELECT *, nullif(stddev_pop(mean) OVER (PARTITION BY unit), 0) AS sd FROM zs), zn AS (SELECT unit, avg(sem / sd) AS z FROM zw GROUP BY unit)"


@query(f"WITH {ZN}, t(threshold) AS (VALUES (0.8), (1.0), (1.2), (1.5)) SELECT CAST(t.threshold AS DOUBLE) AS threshold, count(*) AS n FROM zn, t WHERE zn.z < t.threshold GROUP BY t.threshold")
def threshold_sweep(spark, d):
    stats = rates.condition_stats(responses(spark, d), ["unit", "theta"], "rate")
    noise = tuning.z_tuning(stats, ["unit"]).select("unit", "z_noise").distinct()
    return selection.kept_by_threshold(noise, "z_noise", [0.8, 1.0, 1.2, 1.5]).groupBy("threshold").agg(F.count_distinct("unit").alias("n"))


@query(f"WITH {MEANS}, {VEC}, g AS (SELECT unit, sqrt(x * x + y * y) / t AS gosi FROM v) SELECT r.unit, count(*) AS n FROM resp r JOIN g USING (unit) WHERE g.gosi > 0.04 GROUP BY r.unit")
def tuned_unit_trials(spark, d):
    m = tuning.gosi_vector(_means(spark, d), ["unit"], "theta", "mean")
    keep = selection.tuned_units(m, "gosi", 0.04).select("unit")
    return responses(spark, d).join(keep, "unit", "left_semi").groupBy("unit").agg(F.count("*").alias("n"))


@query(f"WITH {RESP}, m AS (SELECT theta, avg(rate) AS m FROM resp GROUP BY theta), p AS (SELECT a.theta AS a, b.theta AS b, abs(a.m - b.m) AS score, least((b.theta - a.theta) % 180, 180 - (b.theta - a.theta) % 180) AS d FROM m a JOIN m b ON a.theta < b.theta) SELECT CASE WHEN d = 90 THEN 'orthogonal' WHEN d = 45 THEN 'adjacent' WHEN d < 45 THEN 'near' ELSE 'far' END AS family, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(avg(score) FILTER (WHERE a IN (0, 90) AND b IN (0, 90)), 6) AS cardinal FROM p GROUP BY 1")
def pair_families(spark, d):
    from trialspark.operators import decode

    m = responses(spark, d).groupBy("theta").agg(F.avg("rate").alias("m"))
    pairs = m.select(F.col("theta").alias("a"), F.col("m").alias("ma")).join(m.select(F.col("theta").alias("b"), F.col("m").alias("mb")), F.col("a") < F.col("b"))
    return decode.family_summary(pairs.withColumn("score", F.abs(F.col("ma") - F.col("mb"))), [], "score")


@query("SELECT CAST(s_nationkey AS BIGINT) AS shank, CAST(count(DISTINCT s_suppkey) AS INTEGER) AS n, min(s_suppkey) AS first_unit, max(s_suppkey) AS last_unit FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY s_nationkey")
def good_units(spark, d):
    quality = F.element_at(F.array(F.lit("noise"), F.lit("Good"), F.lit("UNSORTED")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    s = table(spark, d, "supplier").withColumn("quality", quality)
    out = selection.good_units(s, "s_nationkey", "s_suppkey")
    return out.select(F.col("s_nationkey").cast("bigint").alias("shank"), F.size("units").alias("n"), F.element_at("units", 1).alias("first_unit"), F.element_at("units", -1).alias("last_unit"))


@query("""WITH n AS (SELECT l_suppkey AS unit, CAST(l_linestatus = 'F' AS INTEGER) AS file_no, count(*) AS n FROM lineitem GROUP BY ALL), q AS (SELECT s_suppkey AS unit, 0 AS file_no, CASE s_suppkey % 3 WHEN 1 THEN 'good' WHEN 2 THEN 'mua' END AS quality FROM supplier UNION ALL SELECT s_suppkey, 1, CASE s_suppkey % 2 WHEN 1 THEN 'good' END FROM supplier),
w AS (SELECT unit, min_by(quality, file_no) FILTER (WHERE quality IS NOT NULL) AS first_quality, count(DISTINCT quality) <= 1 AS agree FROM q GROUP BY unit) SELECT n.unit, n.file_no, n.n, q.quality, w.first_quality, w.agree FROM n LEFT JOIN q USING (unit, file_no) LEFT JOIN w USING (unit)""")
def combined_qualities(spark, d):
    """Two recordings of the same units, each with ratings of its own."""
    from trialspark.operators.intervals import combined_units, with_qualities

    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), "l_linestatus")
    both = combined_units([li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F'")]).groupBy("unit", "file_no").agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"))
    first = s.withColumn("quality", F.when(F.col("unit") % 3 == 1, "good").when(F.col("unit") % 3 == 2, "mua"))
    return with_qualities(both, [first, s.withColumn("quality", F.when(F.col("unit") % 2 == 1, "good"))], "unit")


@query("SELECT l_suppkey AS unit, 0 AS file_no, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 UNION ALL SELECT l_suppkey, 1, count(*) FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def combined_recordings(spark, d):
    from trialspark.operators.intervals import combined_units

    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), "l_linestatus")
    both = combined_units([li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F'")])
    return both.groupBy("unit", "file_no").agg(F.count("*").alias("n"))
