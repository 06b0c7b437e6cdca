"""Multichannel signals: chunks, re-referencing, filters, spectra, artifacts.

Traces are rows of chunks: (rec_id, channel, chunk, start, samples). A kernel that looks around a sample works on even blocks,
which are cut by the samples' places and come with a halo: however the chunks were cut, a task never needs a whole recording,
and single samples are not shuffled for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_traces(samples: DataFrame, keys: list[str], sample: str, value: str, length: int) -> DataFrame:
    """(keys, chunk, start, samples): a long table as arrays of `length` samples; the last may be shorter."""
    out = samples.withColumn("chunk", F.floor(F.col(sample) / length).cast("bigint"))
    got = out.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(value).cast("double").alias("v")))).alias("_s"))
    return got.select(*keys, "chunk", F.col("_s")[0]["s"].alias("start"), F.transform("_s", lambda x: x["v"]).alias("samples"))


def long_traces(traces: DataFrame, keys: list[str], sample: str = "sample", value: str = "value") -> DataFrame:
    """The inverse of chunk_traces()."""
    return traces.select(*keys, "start", F.posexplode("samples").alias("_k", value)).select(*keys, (F.col("start") + F.col("_k")).alias(sample), value)


def crop(samples: DataFrame, sample: str, fs: float, start: float, end: float) -> DataFrame:
    """Samples from start up to end seconds."""
    return samples.filter((F.col(sample) >= round(start * fs)) & (F.col(sample) < round(end * fs)))


def median_reference(samples: DataFrame, keys: list[str], sample: str, value: str, name: str = "value") -> DataFrame:
    """Each sample less the median over the channels of its group (keys) at that sample."""
    m = F.median(value).over(Window.partitionBy(*keys, sample))
    return samples.withColumn(name, F.col(value) - m)


def median_reference_chunks(traces: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """median_reference() on chunk rows: a task takes the channels of one chunk as a matrix, never single samples."""
    schema = traces.schema

    def subtract(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["samples"].to_list())
        return pdf.assign(samples=list(x - np.median(x, axis=0)))

    return traces.groupBy(*keys, "chunk").applyInPandas(subtract, schema)


def butterworth(low: float | None, high: float | None, fs: float, order: int = 4) -> np.ndarray:
    """Second-order sections (rows b0 b1 b2 1 a1 a2) of a Butterworth band-, low- or high-pass, by the bilinear transform."""
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low is not None and high is not None:
        w0, bw = np.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
        half = poles * bw / 2
        root = np.sqrt(half**2 - w0**2 + 0j)
        p, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), bw**order
    elif high is not None:
        p, zeros, gain = poles * warp(high), np.zeros(0), warp(high) ** order
    else:
        p, zeros, gain = warp(low) / poles, np.zeros(order), 1.0
    zp = (2 * fs + p) / (2 * fs - p)
    zz = (2 * fs + zeros) / (2 * fs - zeros)
    k0 = gain * np.real(np.prod(2 * fs - zeros) / np.prod(2 * fs - p))
    zz = np.concatenate([zz, -np.ones(len(zp) - len(zz))])
    upper = zp[np.imag(zp) > 1e-12]
    real = np.sort(np.real(zp[np.abs(np.imag(zp)) <= 1e-12]))
    pairs = [(q, np.conj(q)) for q in upper[np.argsort(np.abs(upper))]] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    zz = np.sort(np.real(zz))
    zeros_of = [(zz[i], zz[-1 - i]) for i in range(len(zz) // 2)] + ([(zz[len(zz) // 2],)] if len(zz) % 2 else [])
    out = []
    for n, pair in enumerate(pairs):
        a = np.real(np.poly(pair))
        b = np.real(np.poly(zeros_of[n])) if n < len(zeros_of) else np.array([1.0])
        out.append(np.concatenate([np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))]))
    sos = np.array(out)
    sos[0, :3] *= k0
    return sos


def _run_sos(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sections one after another, from the steady state of the first sample; a row for each signal of equal length."""
    for b0, b1, b2, _, a1, a2 in sos:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = (b2 - a2 * gain) * x[:, 0]
        z1 = (b1 - a1 * gain) * x[:, 0] + z2
        y = np.empty_like(x)
        for n in range(x.shape[1]):
            v = x[:, n]
            out = b0 * v + z1
            z1 = b1 * v - a1 * out + z2
            z2 = b2 * v - a2 * out
            y[:, n] = out
        x = y
    return x


def zero_phase(sos: np.ndarray, x: np.ndarray, pad: int) -> np.ndarray:
    """Forward and backward filter of signals (rows), with `pad` samples of odd reflection at both ends."""
    pad = min(pad, x.shape[1] - 1)
    if pad > 0:
        x = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    y = _run_sos(sos, _run_sos(sos, x)[:, ::-1])[:, ::-1]
    return y[:, pad : y.shape[1] - pad] if pad > 0 else y


#: Samples of a block at least.
BLOCK = 4096
#: Samples that a kernel is given at once at most, but for a block that is longer: what its working arrays hold.
TOGETHER = 1 << 21


def even_blocks(traces: DataFrame, keys: list[str], size: int, before: int = 0, after: int = 0) -> DataFrame:
    """(keys, chunk, start, samples, before, n): blocks of `size` samples by their place, whatever the chunks they came in.

    Each chunk is cut where it lies, and sends a block its own samples and a neighbour only the halo that it asks for: up to
    `before` samples on the left and `after` on the right, which samples holds as well. before says how many there are on the
    left, n how many are the block's own, start the place of the first of them. A block holds size + before + after samples at
    most, and nothing is asked of the data while the plan is made. Samples are taken as neighbours even where places are missing
    between; blocks without samples of their own don't exist.
    """
    low, high = F.col("start"), F.col("start") + F.size("samples")
    rows = traces.filter(F.size("samples") > 0).select(*keys, low.alias("_low"), high.alias("_high"), F.col("samples").cast("array<double>").alias("samples"))
    reach = F.sequence(F.floor((F.col("_low") - after) / size), F.floor((F.col("_high") - 1 + before) / size))
    rows = rows.withColumn("chunk", F.explode(reach)).withColumns({"_a": F.greatest("_low", F.col("chunk") * size - before), "_b": F.least("_high", (F.col("chunk") + 1) * size + after)})
    piece = F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"), F.slice("samples", (F.col("_a") - F.col("_low") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")).alias("x"))
    got = rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(piece)).alias("_parts"))
    edge, end = F.col("chunk") * size, (F.col("chunk") + 1) * size
    count = lambda of: F.aggregate("_parts", F.lit(0).cast("long"), lambda t, p: t + F.greatest(F.lit(0).cast("long"), of(p)))
    own = count(lambda p: F.least(p["b"], end) - F.greatest(p["a"], edge))
    left = count(lambda p: F.least(p["b"], edge) - p["a"])
    first = F.array_min(F.transform(F.filter("_parts", lambda p: p["b"] > edge), lambda p: F.greatest(p["a"], edge)))
    return got.select(*keys, "chunk", first.alias("start"), F.flatten(F.col("_parts.x")).alias("samples"), left.cast("int").alias("before"), own.cast("int").alias("n")).filter("n > 0")


def response_length(sos: np.ndarray, share: float = 1e-3) -> int:
    """Samples until what a filter of these sections remembers of a sample has fallen to this share."""
    radius = max(abs(r) for row in sos for r in np.roots([1.0, row[4], row[5]]))
    return int(np.ceil(np.log(share) / np.log(radius))) if radius > 0 else 1


def _on_blocks(traces: DataFrame, keys: list[str], size: int, halo: int, kernel, name: str = "samples") -> DataFrame:
    """(keys, chunk, start, n, name): each block by kernel(signals, before, own): arrays of one layout are run as one matrix,
    of TOGETHER samples at most, however many blocks a batch brings."""

    @F.pandas_udf("array<double>")
    def run(samples: pd.Series, before: pd.Series, own: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(own), dtype=object)
        shapes: dict[tuple, list[int]] = {}
        for k, (x, b, n) in enumerate(zip(samples, before, own, strict=True)):
            shapes.setdefault((len(x), b, n), []).append(k)
        for (size, b, n), every in shapes.items():
            some = max(1, TOGETHER // size)
            for first in range(0, len(every), some):
                rows = every[first : first + some]
                for k, y in zip(rows, kernel(np.stack([samples[k] for k in rows]), b, n), strict=True):
                    out[k] = y.copy()  # a slice would keep the kernel's whole array
        return out

    blocks = even_blocks(traces, keys, size, halo, halo)
    return blocks.select(*keys, "chunk", "start", "n", run("samples", "before", "n").alias(name))


def bandpass(traces: DataFrame, keys: list[str], low: float | None, high: float | None, fs: float, order: int = 4, halo: int | None = None) -> DataFrame:
    """(keys, chunk, start, samples): zero-phase Butterworth filter by even blocks, with a halo that outlasts its response; a shorter one is refused."""
    sos = butterworth(low, high, fs, order)
    least = response_length(sos)
    if halo is not None and halo < least:
        raise ValueError(f"a halo of {halo} samples is under the filter's response of {least}")
    halo = halo or least
    return _on_blocks(traces, keys, max(BLOCK, halo), halo, lambda x, nb, n: zero_phase(sos, x, min(3 * (2 * len(sos) + 1), x.shape[1] - 1))[:, nb : nb + n]).drop("n")


def resampled(traces: DataFrame, keys: list[str], ratio: int, taps: int = 16) -> DataFrame:
    """(keys, chunk, start, samples): every ratio-th sample after a windowed-sinc low-pass at the new half rate; start counts new samples.

    The filter has taps * ratio samples to each side. Kept are the samples whose places are multiples of ratio, by even blocks.
    """
    half = taps * ratio
    k = np.arange(-half, half + 1)
    h = np.sinc(k / ratio) * np.hamming(2 * half + 1)
    h /= h.sum()

    def kernel(x: np.ndarray, nb: int, n: int) -> np.ndarray:
        left, right = half - nb, half - (x.shape[1] - nb - n)
        x = np.pad(x, ((0, 0), (max(0, left), max(0, right))), mode="edge")
        at = nb + max(0, left)
        return np.stack([np.convolve(row, h, mode="same")[at : at + n] for row in x])

    smooth = _on_blocks(traces, keys, ratio * -(-max(BLOCK, half) // ratio), half, kernel)
    smooth = smooth.withColumn("_skip", F.pmod(-F.col("start"), F.lit(ratio)).cast("int"))
    kept = smooth.withColumn("samples", F.filter("samples", lambda x, i: (i >= F.col("_skip")) & ((i - F.col("_skip")) % ratio == 0)))
    return kept.filter(F.size("samples") > 0).withColumn("start", ((F.col("start") + F.col("_skip")) / ratio).cast("bigint")).select(*keys, "chunk", "start", "samples")


def tukey(n: int, share: float = 0.25) -> np.ndarray:
    edge, w = share * n / 2, np.ones(n)
    k = np.arange(n)
    w = np.where(k < edge, 0.5 * (1 - np.cos(2 * np.pi * k / (share * n))), w)
    return np.where(k > n - edge, 0.5 * (1 - np.cos(2 * np.pi * (n - k) / (share * n))), w)


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def psd(x: np.ndarray, fs: float, window: np.ndarray, nfft: int) -> np.ndarray:
    """One-sided power spectral density of rows, each less its mean."""
    x = (x - x.mean(axis=1, keepdims=True)) * window
    p = np.abs(np.fft.rfft(x, nfft)) ** 2 / (fs * (window**2).sum())
    p[:, 1 : p.shape[1] - (nfft % 2 == 0)] *= 2
    return p


def segments(traces: DataFrame, keys: list[str], nperseg: int, step: int) -> DataFrame:
    """(keys, seg, x): runs of nperseg samples that begin at each multiple of `step`, cut from even blocks and what follows them.

    Runs past the end, or over a gap in the places, are left out.
    """
    size = step * -(-max(BLOCK, nperseg) // step)
    wide = even_blocks(traces, keys, size, 0, nperseg - 1)
    skip = F.pmod(-F.col("start"), F.lit(step)).cast("int")
    last = F.least(F.col("n") - 1, F.size("samples") - nperseg)
    cut = wide.filter(skip <= last).select(*keys, "start", "samples", F.explode(F.sequence(skip, last, F.lit(step))).alias("_s"))
    return cut.select(*keys, ((F.col("start") + F.col("_s")) / step).cast("bigint").alias("seg"), F.slice("samples", F.col("_s") + 1, F.lit(nperseg)).alias("x"))


def spectrogram(traces: DataFrame, keys: list[str], fs: float, nperseg: int = 1024, overlap: int = 768, nfft: int = 2048, kind: str = "float") -> DataFrame:
    """(keys, seg, t, psd): Tukey window (0.25), mean removed, one-sided density; t is a segment's middle in seconds."""
    step, window = nperseg - overlap, tukey(nperseg)

    @F.pandas_udf(f"array<{kind}>")
    def density(x: pd.Series) -> pd.Series:
        return pd.Series(list(psd(np.stack(x.to_list()), fs, window, nfft).astype(np.float32 if kind == "float" else np.float64))) if len(x) else pd.Series([], dtype=object)

    cut = segments(traces, keys, nperseg, step)
    return cut.select(*keys, "seg", ((F.col("seg") * step + nperseg / 2) / fs).alias("t"), density("x").alias("psd"))


BANDS = {"delta": (0.5, 4.0), "sigma": (9.0, 25.0), "gamma": (40.0, 100.0), "_narrow": (5.0, 10.0), "_wide": (2.0, 15.0)}


def band_powers(traces: DataFrame, keys: list[str], fs: float, smooth: int, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """(keys, sample, delta, sigma, gamma, theta_ratio): 0.5-4, 9-25, 40-100 Hz, and 5-10 by 2-15 Hz.

    A band's power is its band-passed samples squared, by a moving average of `smooth` samples, 0 beyond the ends. All bands
    are made from one block and its halo, which outlasts the slowest filter and the average; samples are parted at the end.
    """
    filters = {name: butterworth(low, high, fs) for name, (low, high) in bands.items()}
    halo = max(map(response_length, filters.values())) + smooth

    def powers(x: np.ndarray, nb: int, n: int) -> np.ndarray:
        out = []
        for sos in filters.values():
            q = zero_phase(sos, x, min(3 * (2 * len(sos) + 1), x.shape[1] - 1)) ** 2
            sums = np.pad(np.cumsum(q, axis=1), ((0, 0), (1, 0)))
            at = np.arange(nb, nb + n)
            out.append((sums[:, np.minimum(at + (smooth + 1) // 2, x.shape[1])] - sums[:, np.maximum(at - smooth // 2, 0)]) / smooth)
        return np.stack(out, axis=1).reshape(len(x), -1)

    wide = _on_blocks(traces, keys, max(BLOCK, halo), halo, powers, "_p").select(*keys, "start", F.col("n").alias("_n"), "_p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_k"))
    named = {name: F.col("_p")[F.col("_k") + i * F.col("_n")] for i, name in enumerate(bands)}
    out = wide.select(*keys, (F.col("start") + F.col("_k")).alias("sample"), *[c.alias(name) for name, c in named.items()])
    return out.withColumn("theta_ratio", F.col("_narrow") / (F.col("_wide") + 1e-10)).drop("_narrow", "_wide") if {"_narrow", "_wide"} <= set(bands) else out


def first_component(spectra: DataFrame, keys: list[str], at: str, values: str, log: bool = True) -> DataFrame:
    """(keys, at, score): the first principal component of a channel's spectra over time.

    Each frequency's log10(S + 1e-10) is standardised over time (+1e-12). The products of frequency pairs are summed by
    tasks over batches of rows and added up; only a matrix of frequencies goes to the eigenvalue step, not the recording.
    The sign makes the largest loading positive.
    """
    x = F.transform(values, lambda v: F.log10(v.cast("double") + 1e-10)) if log else F.transform(values, lambda v: v.cast("double"))
    rows = spectra.select(*keys, at, x.alias("_x"))

    def moments(batches):
        for pdf in batches:
            for key, own in pdf.groupby(keys, sort=False, dropna=False):
                m = np.stack(own["_x"].to_list())
                key = key if isinstance(key, tuple) else (key,)
                yield pd.DataFrame([[*key, len(m), m.sum(axis=0), (m.T @ m).ravel()]], columns=[*keys, "n", "s", "g"])

    key_schema = ", ".join(f"`{k}` {spectra.schema[k].dataType.simpleString()}" for k in keys)
    partial = rows.mapInPandas(moments, f"{key_schema}, n long, s array<double>, g array<double>")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, g = pdf["n"].sum(), np.sum(pdf["s"].to_list(), axis=0), np.sum(pdf["g"].to_list(), axis=0)
        p = len(s)
        mean = s / n
        cov = g.reshape(p, p) / n - np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(cov), 0, None)) + 1e-12
        _, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        v = vectors[:, -1]
        v = v * np.sign(v[np.abs(v).argmax()])
        w = v / sd
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], w, float(mean @ w)]], columns=[*keys, "w", "c"])

    axes = partial.groupBy(*keys).applyInPandas(solve, f"{key_schema}, w array<double>, c double")
    dot = F.aggregate(F.zip_with("_x", "w", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    return rows.join(axes, keys).select(*keys, at, (dot - F.col("c")).alias("score"))


def chunk_norms(samples: DataFrame, channel: list[str], sample: str, value: str, size: int, partial: bool = True) -> DataFrame:
    """(channel, chunk, n, norm): square root of the sum of squares of each `size` samples; partial keeps a short last one."""
    v = F.col(value).cast("double")
    out = samples.groupBy(*channel, F.floor(F.col(sample) / size).cast("bigint").alias("chunk")).agg(F.count("*").alias("n"), F.sqrt(F.sum(v * v)).alias("norm"))
    return out if partial else out.filter(F.col("n") == size)


def artifact_chunks(norms: DataFrame, channel: list[str], size: int, k: float = 6.0, recording: tuple[str, ...] = ()) -> DataFrame:
    """(recording, chunk, start, n_channels): chunks whose norm is over mean + k population deviations in any channel.

    recording: the columns that tell recordings apart; a chunk is bad in its own recording alone.
    """
    w = Window.partitionBy(*recording, *channel)
    bad = norms.filter("norm IS NOT NULL").withColumn("_t", F.avg("norm").over(w) + k * F.stddev_pop("norm").over(w)).filter("norm > _t")
    return bad.groupBy(*recording, "chunk").agg((F.col("chunk") * size).alias("start"), F.count("*").alias("n_channels"))


def without_artifacts(samples: DataFrame, bad: DataFrame, keys: list[str], sample: str, value: str, size: int, name: str = "value", recording: tuple[str, ...] = ()) -> DataFrame:
    """Samples of bad chunks replaced by the cubic through two good samples on either side; at an end, by the nearest good one.

    keys tell the lines of samples apart, recording (some of them) the recordings that the bad chunks belong to. Samples are
    gathered by chunk; good chunks tell their first two and last two samples, which are carried over chunks, a row each, to the
    bad ones, and those are filled where they lie.
    """
    on = [*recording, "chunk"]
    point = F.struct(F.col(sample).cast("double").alias("x"), F.col(value).cast("double").alias("y"), F.col(sample).alias("s"))
    chunks = samples.groupBy(*keys, F.floor(F.col(sample) / size).cast("bigint").alias("chunk")).agg(F.array_sort(F.collect_list(point)).alias("_x"))
    chunks = chunks.join(bad.select(*on, F.lit(True).alias("_bad")).distinct(), on, "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    order = Window.partitionBy(*keys).orderBy("chunk")
    back = Window.partitionBy(*keys).orderBy(F.col("chunk").desc())
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    good = lambda c: F.when(~F.col("_bad"), c)
    # a chunk of one sample takes the second of its two from the good chunk beyond
    chunks = chunks.withColumns({"_f": good(F.element_at("_x", 1)), "_e": good(F.element_at("_x", -1))})
    chunks = chunks.withColumns({"_pe": F.last("_e", ignorenulls=True).over(earlier(order)), "_nf": F.last("_f", ignorenulls=True).over(earlier(back))})
    many = F.size("_x") > 1
    two_before = good(F.struct(F.when(many, F.get("_x", F.size("_x") - 2)).otherwise(F.col("_pe")).alias("a"), F.element_at("_x", -1).alias("b")))
    two_after = good(F.struct(F.element_at("_x", 1).alias("a"), F.when(many, F.get("_x", F.lit(1))).otherwise(F.col("_nf")).alias("b")))
    chunks = chunks.withColumns({"_l": two_before, "_r": two_after})
    chunks = chunks.withColumns({"_l": F.last("_l", ignorenulls=True).over(earlier(order)), "_r": F.last("_r", ignorenulls=True).over(earlier(back))})
    rows = chunks.select(*keys, "_bad", "_l", "_r", F.explode("_x").alias("_v"))
    points, x = ["_l.a", "_l.b", "_r.a", "_r.b"], F.col("_v.x")

    def lagrange(names: list[str]) -> Column:
        total = F.lit(0.0)
        for p in names:
            term = F.col(f"{p}.y")
            for q in names:
                if p != q:
                    term = term * (x - F.col(f"{q}.x")) / (F.col(f"{p}.x") - F.col(f"{q}.x"))
            total = total + term
        return total

    filled = F.when(~F.col("_bad"), F.col("_v.y")).when(F.col("_l.a").isNotNull() & F.col("_r.b").isNotNull(), lagrange(points))
    filled = filled.when(F.col("_l.b").isNotNull() & F.col("_r.a").isNotNull(), lagrange(points[1:3])).otherwise(F.coalesce(F.col("_l.b.y"), F.col("_r.a.y")))
    return rows.select(*keys, F.col("_v.s").alias(sample), filled.alias(name), F.col("_bad").alias("replaced"))


def artifact_report(raw: DataFrame, cleaned: DataFrame, keys: list[str], sample: str, value: str, window: int) -> DataFrame:
    """(keys, win, rms_before, rms_after, reduction): root mean squares by windows of samples, and the loss in per cent."""
    rms = lambda df, name: df.groupBy(*keys, F.floor(F.col(sample) / window).alias("win")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias(name))
    both = rms(raw, "rms_before").join(rms(cleaned, "rms_after"), [*keys, "win"])
    return both.withColumn("reduction", F.when(F.col("rms_before") > 0, 100 * (1 - F.col("rms_after") / F.col("rms_before"))).otherwise(0.0))


def artifact_counts(bad: DataFrame, recording: list[str], size: int, window: int) -> DataFrame:
    """(recording, win, n): bad chunks by windows of samples; windows without any have no row."""
    return bad.groupBy(*recording, F.floor(F.col("chunk") * size / window).cast("bigint").alias("win")).agg(F.count("*").alias("n"))


def artifact_summary(report: DataFrame, bad: DataFrame, lengths: DataFrame, recording: list[str], size: int, fs: float) -> DataFrame:
    """(recording, n_bad, share_of_time, per_minute, reduction_mean, reduction_median, reduction_least, reduction_most).

    lengths: (recording, samples). share_of_time is in per cent. A recording without bad chunks has zeros.
    """
    n = bad.groupBy(*recording).agg(F.count_distinct("chunk").alias("_n"))
    r = report.groupBy(*recording).agg(F.avg("reduction").alias("reduction_mean"), F.median("reduction").alias("reduction_median"), F.min("reduction").alias("reduction_least"), F.max("reduction").alias("reduction_most"))
    joined = (lengths.join(n, recording, "left").join(r, recording, "left") if recording else lengths.crossJoin(n).crossJoin(r)).withColumn("n_bad", F.coalesce("_n", F.lit(0)))
    seconds = F.col("samples") / F.lit(fs)
    share, rate = 100 * F.least(F.lit(1.0), F.col("n_bad") * size / F.col("samples")), F.col("n_bad") / (seconds / 60)
    return joined.select(*recording, "n_bad", share.alias("share_of_time"), rate.alias("per_minute"), "reduction_mean", "reduction_median", "reduction_least", "reduction_most")


def preprocessed(traces: DataFrame, keys: list[str], fs: float, steps: list[tuple]) -> tuple[DataFrame, float]:
    """traces after the steps in their order, and their rate: ("reference", group, channel), ("band", low, high), ("resample", ratio).

    group: the columns that tell apart what is referenced together; keys those of a single line.
    """
    for step, *told in steps:
        if step == "reference":
            traces = median_reference_chunks(traces, told[0], told[1])
        elif step == "band":
            traces = bandpass(traces, keys, *told, fs)
        elif step == "resample":
            traces, fs = resampled(traces, keys, told[0]), fs / told[0]
        else:
            raise ValueError(f"no step {step}")
    return traces, fs


def power_by_depth(samples: DataFrame, channels: DataFrame, shank: list[str], channel: str, value: str, depth: str) -> DataFrame:
    """(shank, channel, depth, power, share, is_peak): mean square of each channel, by the largest of its shank."""
    p = samples.groupBy(*shank, channel).agg(F.avg(F.col(value).cast("double") * F.col(value).cast("double")).alias("power"))
    w = Window.partitionBy(*shank)
    out = p.join(channels, [*shank, channel]).withColumn("share", F.col("power") / F.max("power").over(w))
    first = F.row_number().over(w.orderBy(F.col("power").desc(), depth))
    return out.withColumn("is_peak", first == 1).select(*shank, channel, depth, "power", "share", "is_peak")
