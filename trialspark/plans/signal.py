"""Signals: embeddings as traces (a channel for each dimension, a sample for each vector) and events as tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.operators import coherence as coh
from trialspark.operators import intervals, motion, rates, signals, windows
from trialspark.plans.base import SAMPLES, events, query, row_index, samples, table
from trialspark.plans.pulse_lines import STEP

CHUNK = 64


def _traces(spark, d):
    return signals.chunk_traces(samples(spark, d), ["channel"], "sample", "value", CHUNK)


@query(f"WITH {SAMPLES} SELECT channel, sample // 64 AS chunk, min(sample) AS start, CAST(count(*) AS INTEGER) AS n, round(sum(value), 6) AS total FROM samples GROUP BY ALL")
def chunk_traces(spark, d):
    t = _traces(spark, d)
    return t.select("channel", "chunk", "start", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(f"WITH {SAMPLES} SELECT channel, sample, round(value, 6) AS value FROM samples")
def traces_round_trip(spark, d):
    return signals.long_traces(_traces(spark, d), ["channel"])


@query(f"WITH {SAMPLES} SELECT channel, sample, round(value, 6) AS value FROM samples WHERE sample >= 50 AND sample < 150")
def crop(spark, d):
    return signals.crop(samples(spark, d), "sample", 100.0, 0.5, 1.5)


@query(f"WITH {SAMPLES} SELECT channel, sample, round(value - median(value) OVER (PARTITION BY CAST(channel // 16 AS INTEGER), sample), 6) AS value FROM samples")
def median_reference(spark, d):
    s = samples(spark, d).withColumn("shank", F.floor(F.col("channel") / 16))
    return signals.median_reference(s, ["shank"], "sample", "value").select("channel", "sample", "value")


@query(f"WITH {SAMPLES} SELECT channel, sample, round(value - median(value) OVER (PARTITION BY CAST(channel // 16 AS INTEGER), sample), 6) AS value FROM samples")
def median_reference_chunks(spark, d):
    t = _traces(spark, d).withColumn("shank", F.floor(F.col("channel") / 16))
    return signals.long_traces(signals.median_reference_chunks(t, ["shank"], "channel"), ["channel"])


NORMS = f"{SAMPLES}, norms AS (SELECT channel, sample // 20 AS chunk, count(*) AS n, sqrt(sum(value * value)) AS norm FROM samples GROUP BY ALL)"


@query(f"WITH {NORMS} SELECT channel, chunk, n, round(norm, 6) AS norm FROM norms")
def chunk_norms(spark, d):
    return signals.chunk_norms(samples(spark, d), ["channel"], "sample", "value", 20)


@query(f"WITH {NORMS}, m AS (SELECT channel, avg(norm) + 2 * stddev_pop(norm) AS t FROM norms GROUP BY channel) SELECT n.chunk, n.chunk * 20 AS start, count(*) AS n_channels FROM norms n JOIN m USING (channel) WHERE n.norm > m.t GROUP BY n.chunk")
def artifact_chunks(spark, d):
    norms = signals.chunk_norms(samples(spark, d), ["channel"], "sample", "value", 20)
    return signals.artifact_chunks(norms, ["channel"], 20, k=2.0)


def _bad(spark, d):
    return signals.artifact_chunks(signals.chunk_norms(samples(spark, d), ["channel"], "sample", "value", 4), ["channel"], 4, k=4.0)


def _lagrange(points: str) -> str:
    return " + ".join(f"y{p} * " + " * ".join(f"(sample - x{q}) / (x{p} - x{q})" for q in points if q != p) for p in points)


REMOVED = f"""{SAMPLES}, norms AS (SELECT channel, sample // 4 AS chunk, sqrt(sum(value * value)) AS norm FROM samples GROUP BY ALL), m AS (SELECT channel, avg(norm) + 4 * stddev_pop(norm) AS t FROM norms GROUP BY channel),
bad AS (SELECT DISTINCT chunk FROM norms JOIN m USING (channel) WHERE norm > t), good AS (SELECT channel, sample, value, lag(sample) OVER w AS ps, lag(value) OVER w AS pv, lead(sample) OVER w AS ns, lead(value) OVER w AS nv FROM samples WHERE sample // 4 NOT IN (SELECT chunk FROM bad) WINDOW w AS (PARTITION BY channel ORDER BY sample)),
lost AS (SELECT * FROM samples WHERE sample // 4 IN (SELECT chunk FROM bad)), l AS (SELECT lost.*, g.ps AS xa, g.pv AS ya, g.sample AS xb, g.value AS yb FROM lost ASOF LEFT JOIN good g ON lost.channel = g.channel AND lost.sample > g.sample),
p AS (SELECT l.*, g.sample AS xc, g.value AS yc, g.ns AS xd, g.nv AS yd FROM l ASOF LEFT JOIN good g ON l.channel = g.channel AND l.sample < g.sample)"""


@query(f"WITH {REMOVED} SELECT channel, sample, round(value, 6) AS value, false AS replaced FROM good UNION ALL SELECT channel, sample, round(CASE WHEN xa IS NOT NULL AND xd IS NOT NULL THEN {_lagrange('abcd')} WHEN xb IS NOT NULL AND xc IS NOT NULL THEN {_lagrange('bc')} ELSE coalesce(yb, yc) END, 6), true FROM p")
def artifact_removal(spark, d):
    """Bad chunks filled by cubics through the good samples about them."""
    return signals.without_artifacts(samples(spark, d), _bad(spark, d), ["channel"], "sample", "value", 4)


@query()
def artifact_report(spark, d):
    raw = samples(spark, d)
    cleaned = signals.without_artifacts(raw, _bad(spark, d), ["channel"], "sample", "value", 4)
    return signals.artifact_report(raw, cleaned, ["channel"], "sample", "value", 100)


@query(f"""WITH {SAMPLES}, p AS (SELECT CAST(channel // 16 AS INTEGER) AS shank, channel, avg(value * value) AS power FROM samples GROUP BY ALL)
SELECT shank, channel, CAST(channel % 16 AS INTEGER) AS depth, round(power, 6) AS power, round(power / max(power) OVER (PARTITION BY shank), 6) AS share, row_number() OVER (PARTITION BY shank ORDER BY power DESC, channel % 16) = 1 AS is_peak FROM p""")
def power_by_depth(spark, d):
    s = samples(spark, d).withColumn("shank", F.floor(F.col("channel") / 16).cast("int"))
    channels = s.select("shank", "channel").distinct().withColumn("depth", (F.col("channel") % 16).cast("int"))
    return signals.power_by_depth(s, channels, ["shank"], "channel", "value", "depth")


@query(f"WITH {SAMPLES} SELECT channel, sample, round(sum(value) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4.0, 6) AS smooth FROM samples")
def moving_average(spark, d):
    return windows.moving_average(samples(spark, d), ["channel"], ["sample"], "value", 4).select("channel", "sample", "smooth")


def _taps(weights, first: int) -> str:
    return " + ".join(f"({w!r}) * lead(value, {first + k}) OVER w" if first + k >= 0 else f"({w!r}) * lag(value, {-(first + k)}) OVER w" for k, w in enumerate(weights.tolist()))


def _savgol_sql(width: int, degree: int) -> str:
    half = width // 2
    cases = "".join(f" WHEN i = {k} THEN {_taps(windows.savgol_weights(width, degree, 0, k), -k)} WHEN i = n - {k + 1} THEN {_taps(windows.savgol_weights(width, degree, 0, width - 1 - k), -(width - 1 - k))}" for k in range(half))
    return f"CASE WHEN n < {width} THEN value{cases} ELSE {_taps(windows.savgol_weights(width, degree), -half)} END"


@query(f"WITH {SAMPLES}, s AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY sample) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n FROM samples) SELECT channel, sample, round({_savgol_sql(11, 3)}, 6) AS smooth FROM s WINDOW w AS (PARTITION BY channel ORDER BY sample)")
def savgol(spark, d):
    return windows.savgol(samples(spark, d), ["channel"], ["sample"], "value", 11, 3).select("channel", "sample", "smooth")


@query(f"""WITH {SAMPLES}, s AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY sample) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n FROM samples),
a AS (SELECT s.channel, s.sample, s.i, CASE WHEN s.i + k < 0 THEN -(s.i + k) - 1 WHEN s.i + k >= s.n THEN 2 * s.n - 1 - s.i - k ELSE s.i + k END AS at FROM s, range(-2, 3) r(k))
SELECT a.channel, a.sample, round(median(s.value), 6) AS smooth FROM a JOIN s ON s.channel = a.channel AND s.i = a.at GROUP BY a.channel, a.sample""")
def median_filter(spark, d):
    return windows.median_filter(samples(spark, d), ["channel"], ["sample"], "value").select("channel", "sample", "smooth")


@query(f"WITH {SAMPLES} SELECT channel, sample, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-10), 6) AS z FROM samples WINDOW w AS (PARTITION BY channel, sample // 100)")
def zscore_window(spark, d):
    s = samples(spark, d).withColumn("win", F.floor(F.col("sample") / 100))
    return windows.z_score(s, ["channel", "win"], "value").select("channel", "sample", "z")


@query(f"WITH {SAMPLES} SELECT channel, CAST((row_number_ - 1) // 7 AS INTEGER) AS block, round(avg(value), 6) + 0.0 AS mean FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY sample) AS row_number_ FROM samples) GROUP BY ALL")
def block_average(spark, d):
    return windows.block_average(samples(spark, d), ["channel"], ["sample"], "value", 7)


@query(f"WITH {SAMPLES}, s AS (SELECT channel, stddev_pop(value) AS sd FROM samples GROUP BY channel), m AS (SELECT median(sd) AS m FROM s) SELECT s.channel, CAST(row_number() OVER (ORDER BY s.channel % 16, s.channel) - 1 AS INTEGER) AS depth_rank, round(-(row_number() OVER (ORDER BY s.channel % 16, s.channel) - 1) * 15 * m.m, 6) AS \"offset\" FROM s, m")
def depth_offsets(spark, d):
    s = samples(spark, d)
    channels = windows.depth_rank(s.select("channel").distinct().withColumn("y", F.col("channel") % 16), [], "y", "channel")
    return windows.depth_offsets(s, channels, "channel", "value").select("channel", "depth_rank", "offset")


@query(f"WITH {SAMPLES}, m AS (SELECT channel, median(value) AS m FROM samples GROUP BY channel), a AS (SELECT s.channel, any_value(m.m) AS middle, median(abs(s.value - m.m)) AS mad FROM samples s JOIN m USING (channel) GROUP BY s.channel) SELECT channel, round(middle, 6) AS middle, round(mad, 6) AS mad, round(middle - mad * 4.2, 6) AS low, round(middle + mad * 4.2, 6) AS high FROM a")
def display_limits(spark, d):
    return windows.display_limits(samples(spark, d), ["channel"], "value")


@query(f"WITH {SAMPLES} SELECT channel, CAST((sample - 5) // 8 AS INTEGER) AS fbin, round(avg(sample), 6) AS freq, round(avg(value), 6) AS value FROM samples WHERE sample >= 5 AND sample < 5 + 8 * 20 GROUP BY ALL")
def frequency_bins(spark, d):
    return windows.frequency_bins(samples(spark, d), ["channel"], "sample", "value", 5.0, 8.0, 20)


@query(f"WITH {SAMPLES}, e AS (SELECT DISTINCT channel, sample AS at FROM samples WHERE abs(value) > 0.4) SELECT e.channel, e.at, CAST(count(*) AS INTEGER) AS n, round(sum(s.value), 6) AS total FROM e JOIN samples s ON s.channel = e.channel AND s.sample BETWEEN e.at - 3 AND e.at + 3 GROUP BY ALL")
def snippets(spark, d):
    s = samples(spark, d)
    found = s.filter("abs(value) > 0.4").select("channel", F.col("sample").alias("at"))
    out = intervals.snippets(found, s, ["channel"], "at", "sample", "value", 3, 3, 16)
    return out.select("channel", "at", F.size("snippet").alias("n"), F.aggregate("snippet", F.lit(0.0), lambda t, x: t + x).alias("total"))


@query("""WITH t AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value AS x, CAST(event_id % 100 AS DOUBLE) AS y FROM events), w AS (SELECT user_id, t, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy, t - lag(t) OVER o AS dt FROM t WINDOW o AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT user_id, t, sqrt(dx * dx + dy * dy) / CASE WHEN dt = 0 THEN 1e-8 ELSE dt END AS raw FROM w WHERE dt IS NOT NULL) SELECT user_id, round(t, 6) AS t, round(raw, 6) AS raw, round(CASE WHEN raw > 0.01 THEN 0 ELSE raw END, 6) AS v FROM r""")
def velocity(spark, d):
    return motion.velocity(_track(spark, d), ["user_id"], "t", "x", "y", most=0.01, resmooth=False)


def _track(spark, d):
    ev = events(spark, d)
    return ev.select("user_id", (F.col("us") / 1e6).alias("t"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))


@query()
def velocity_smoothed(spark, d):
    """Speeds of tracks smoothed by each method (see the tests)."""
    out = None
    for method in ("savgol", "median", "gaussian"):
        one = motion.velocity(_track(spark, d), ["user_id"], "t", "x", "y", method).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def velocity_by_derivative(spark, d):
    return motion.velocity_by_derivative(_track(spark, d), ["user_id"], "t", "x", "y")


def _line(spark, d):
    """The dimensions of all vectors as one long recording of each label: 64 samples of a vector are a chunk."""
    e = table(spark, d, "embeddings")
    rows = row_index(e.select("label", "vec_id", "embedding"), ["label"], ["vec_id"], "chunk")
    return rows.select(F.col("label").alias("channel"), F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * 64).cast("long").alias("start"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


FRAMES = """e AS (SELECT label AS channel, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk, embedding FROM embeddings), line AS (SELECT channel, chunk * 64 + j AS place, CAST(embedding[j + 1] AS DOUBLE) AS v FROM e, range(64) t(j)),
f AS (SELECT channel, CAST(g AS BIGINT) AS seg, place - g * 16 AS k, v FROM (SELECT *, unnest(range(greatest(0, (place - 48) // 16), place // 16 + 1)) AS g FROM line) WHERE place - g * 16 BETWEEN 0 AND 63),
whole AS (SELECT channel, seg, avg(v) AS m FROM f GROUP BY ALL HAVING count(*) = 64), w AS (SELECT k, CASE WHEN k < 8 THEN 0.5 * (1 - cos(2 * pi() * k / 16)) WHEN k > 56 THEN 0.5 * (1 - cos(2 * pi() * (64 - k) / 16)) ELSE 1.0 END AS w FROM range(64) t(k)),
x AS (SELECT f.channel, f.seg, f.k, (f.v - whole.m) * w.w AS x FROM f JOIN whole USING (channel, seg) JOIN w ON w.k = f.k)"""


@query(f"WITH {FRAMES}, d AS (SELECT channel, seg, CAST(q AS INTEGER) AS freq, sum(x * cos(2 * pi() * q * k / 128)) AS re, sum(x * sin(2 * pi() * q * k / 128)) AS im FROM x, range(65) t(q) GROUP BY ALL) SELECT channel, seg, round((seg * 16 + 32) / 500, 6) AS t, freq, round((re * re + im * im) / (500 * (SELECT sum(w * w) FROM w)) * CASE WHEN freq IN (0, 64) THEN 1 ELSE 2 END, 6) AS psd FROM d")
def spectrogram(spark, d):
    """Power densities of overlapping frames that may cross chunks and blocks."""
    out = signals.spectrogram(_line(spark, d), ["channel"], 500.0, nperseg=64, overlap=48, nfft=128, kind="double")
    return out.select("channel", "seg", "t", F.posexplode("psd").alias("freq", "psd"))


@query()
def bandpass(spark, d):
    return signals.long_traces(signals.bandpass(_line(spark, d), ["channel"], 20.0, 100.0, 500.0), ["channel"])


@query()
def resampled(spark, d):
    return signals.long_traces(signals.resampled(_line(spark, d), ["channel"], 4, taps=8), ["channel"])


@query()
def band_powers(spark, d):
    return signals.band_powers(_line(spark, d), ["channel"], 500.0, 50)


@query()
def first_component(spark, d):
    s = signals.spectrogram(_line(spark, d), ["channel"], 500.0, nperseg=64, overlap=0, nfft=64)
    return signals.first_component(s, ["channel"], "seg", "psd")


def _spectra(spark, d):
    seg = table(spark, d, "embeddings").select(F.col("label").alias("channel"), F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    seg = row_index(seg, ["channel"], ["vec_id"], "seg").drop("vec_id")
    return coh.segment_spectra(seg, ["channel"], 64.0, 1.0, 8.0)


_PI2 = "6.283185307179586"
COH = f"""raw AS (SELECT label AS channel, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seg, embedding FROM embeddings),
x AS (SELECT channel, seg, CAST(n AS INTEGER) AS n, CAST(embedding[n + 1] AS DOUBLE) AS v FROM raw, range(64) r(n)),
c AS (SELECT channel, seg, n, (v - avg(v) OVER (PARTITION BY channel, seg)) * (0.5 - 0.5 * cos({_PI2} * n / 64)) AS v FROM x),
z AS (SELECT channel, seg, CAST(k AS INTEGER) AS k, sum(v * cos({_PI2} * k * n / 64)) AS re, -sum(v * sin({_PI2} * k * n / 64)) AS im FROM c, range(1, 9) q(k) GROUP BY ALL),
s AS (SELECT a.channel AS ca, b.channel AS cb, a.k, sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im, sum(a.re * a.re + a.im * a.im) AS pa, sum(b.re * b.re + b.im * b.im) AS pb
FROM z a JOIN z b ON a.seg = b.seg AND a.k = b.k WHERE a.channel < 5 AND b.channel >= 5 GROUP BY ALL),
coh AS (SELECT ca, cb, k, CAST(k AS DOUBLE) AS freq, (re * re + im * im) / (pa * pb) AS coh, atan2(im, re) AS phase FROM s)"""


def _coherence(spark, d):
    z = _spectra(spark, d)
    a = z.filter("channel < 5").withColumnRenamed("channel", "ca")
    b = z.filter("channel >= 5").withColumnRenamed("channel", "cb")
    return coh.coherence(a, b, [], "ca", "cb")


@query(f"WITH {COH} SELECT ca, cb, k, freq, round(coh, 6) AS coh, round(phase, 6) AS phase FROM coh")
def coherence(spark, d):
    return _coherence(spark, d)


@query(f"WITH {COH} SELECT ca, cb, k, round(coh, 6) AS coh, CAST(ca % 4 AS DOUBLE) AS a_x, CAST(ca // 4 AS DOUBLE) * 20 AS a_y, CAST(cb % 4 AS DOUBLE) AS b_x, CAST(cb // 4 AS DOUBLE) * 20 AS b_y, round(sqrt((ca % 4 - cb % 4) ** 2 + (ca // 4 * 20 - cb // 4 * 20) ** 2), 6) AS distance FROM coh")
def coherence_places(spark, d):
    """Coherences with the places of both channels: four columns, rows 20 apart."""
    channels = samples(spark, d).select("channel").distinct().select("channel", (F.col("channel") % 4).cast("double").alias("x"), (F.floor(F.col("channel") / 4) * 20).cast("double").alias("y"))
    return coh.with_places(_coherence(spark, d), channels, "ca", "cb").select("ca", "cb", "k", "coh", "a_x", "a_y", "b_x", "b_y", "distance")


@query(f"WITH {COH}, per AS (SELECT ca AS session, k, freq, count(*) AS n, avg(coh) AS mean, stddev_pop(coh) AS sd FROM coh GROUP BY ALL) SELECT session, k, freq, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS sem FROM per")
def coherence_by_session(spark, d):
    return coh.session_means(_coherence(spark, d).withColumnRenamed("ca", "session"), "session", ["cb"])


@query(f"""WITH {COH} SELECT ca, cb, k, round(sum(coh) OVER (PARTITION BY ca, cb ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0, 6) AS smooth FROM coh""")
def coherence_smoothed(spark, d):
    return coh.smoothed(_coherence(spark, d), ["ca", "cb"], "freq", "coh", "moving_average", width=3).select("ca", "cb", "k", "smooth")


@query(f"WITH {SAMPLES} SELECT channel, sample, round(CASE WHEN value > 0.2 THEN 0 ELSE value END, 6) AS value FROM samples")
def outliers_to_zero(spark, d):
    from trialspark.operators.selection import clamp

    return clamp(samples(spark, d), "value", 0.2)


@query(f"WITH {STEP}, h AS (SELECT CAST(d // 3600000000 AS INTEGER) AS bin FROM s WHERE d IS NOT NULL AND d < 86400000000), g AS (SELECT CAST(r.bin AS INTEGER) AS bin FROM range(24) r(bin)) SELECT g.bin, count(h.bin) AS n FROM g LEFT JOIN h USING (bin) GROUP BY g.bin")
def interval_histogram(spark, d):
    from pyspark.sql import Window

    step = events(spark, d).withColumn("d", F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us"))).filter("d < 86400000000")
    return rates.histogram(step, [], "d", 0, 3_600_000_000, 24)
