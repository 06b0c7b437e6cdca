"""Readers of text and binary logs, session names and catalogues, and the stores that results go to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.functions.scalars import date_range, normal_key, number_list, percent, signed_decimals

DIN_SCHEMA = "rec_id string, part int, channel int, seq long, t long, state int"
TRIAL_SCHEMA = "trial_index int, pair_id string, left_ori double, right_ori double, stim_on_s double, stim_off_s double, contrast double, spatial_freq double"


def parse_din(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, states) of a log of packed records behind a text header.

    The header stands between <Start settings> and <End settings>; its line `fields:` names the record's members as
    <name type>, a type with an optional count before it (2*uint16). Records must have time and state.
    """
    start, end = content.find(b"<Start settings>"), content.find(b"<End settings>")
    if start < 0 or end < 0:
        raise ValueError("no settings header")
    header = content[start:end].decode("utf-8", "replace")
    line = next((x for x in header.splitlines() if x.lower().startswith("fields:")), None)
    if line is None:
        raise ValueError("the header names no fields")
    kinds = []
    for member in line.partition(":")[2].replace("<", "").split(">"):
        if not member.strip():
            continue
        name, kind = member.split()
        count, _, kind = kind.rpartition("*")
        kinds.append((name, np.dtype(kind).newbyteorder("<"), (int(count),)) if count else (name, np.dtype(kind).newbyteorder("<")))
    record = np.dtype(kinds)
    body = content[content.index(b"\n", end) + 1 :]
    rows = np.frombuffer(body[: len(body) // record.itemsize * record.itemsize], dtype=record)
    return rows["time"].astype(np.int64), rows["state"].astype(np.int32)


def _din_files(reader, path: str, channel: int) -> DataFrame:
    return reader.format("binaryFile").option("pathGlobFilter", f"*Din{channel}.dat").option("recursiveFileLookup", "true").load(path)


def _folders(path: Column) -> tuple[Column, Column]:
    """The recording that a log belongs to, and the folder that it lies in, by its path."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _parsed(keep: list[str], channel: int, malformed: str):
    """Rows with content -> the columns to keep, and a row for each record of the log; or, for `malformed` errors, for each log that doesn't parse."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                own = {k: r[k] for k in keep}
                try:
                    t, state = parse_din(r["content"])
                except (ValueError, TypeError) as e:
                    if malformed == "fail":
                        raise
                    if malformed == "errors":
                        yield pd.DataFrame({**own, "error": [str(e)]})
                    continue
                if malformed != "errors":
                    yield pd.DataFrame({**own, "channel": channel, "seq": np.arange(len(t)), "t": t, "state": state})

    return explode


def read_din(spark: SparkSession, path: str, channel: int, malformed: str = "fail") -> DataFrame:
    """Transition logs of a channel (files *Din<channel>.dat) under path, in parts by their folders' names.

    Files are read by Spark, wherever they lie, and parsed a file at a time in the tasks. malformed says what becomes of a log
    without a header or fields: "fail", or "drop" (din_errors() lists those).
    """
    files = _din_files(spark.read, path, channel)
    rec, folder = _folders(F.col("path"))
    listed = files.select(rec.alias("rec_id"), folder.alias("folder"), "path").withColumn("part", F.dense_rank().over(Window.partitionBy("rec_id").orderBy("folder")))
    parts = files.select("path", "content").join(listed.select("path", "rec_id", "part"), "path").select("rec_id", "part", "content")
    return parts.mapInPandas(_parsed(["rec_id", "part"], channel, malformed), DIN_SCHEMA)


def din_errors(spark: SparkSession, path: str, channel: int) -> DataFrame:
    """(path, error) of the logs that read_din() can't parse."""
    return _din_files(spark.read, path, channel).select("path", "content").mapInPandas(_parsed(["path"], channel, "errors"), "path string, error string")


def stream_din(spark: SparkSession, path: str, channel: int) -> DataFrame:
    """(rec_id, folder, channel, seq, t, state) of logs as they arrive under path; those that don't parse are left out.

    A folder's part in its recording isn't known while folders may still come, so the folder's name stands for it.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    rec, folder = _folders(F.col("path"))
    files = _din_files(spark.readStream.schema(schema), path, channel).select(rec.alias("rec_id"), folder.alias("folder"), "content")
    return files.mapInPandas(_parsed(["rec_id", "folder"], channel, "drop"), "rec_id string, folder string, channel int, seq long, t long, state int")


def read_trial_csv(spark: SparkSession, path: str) -> DataFrame:
    """Trial parameters; columns that a file lacks are null."""
    raw = spark.read.option("header", True).csv(path)
    fields = [x.split() for x in TRIAL_SCHEMA.split(", ")]
    return raw.select(*[(F.col(n).try_cast(k) if n in raw.columns else F.lit(None).cast(k)).alias(n) for n, k in fields])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, line_no, line): text files whole and by line."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("content"))
    return files.select("path", "content", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))


def read_grid_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, trials) of grid logs: `# key: value` lines, then tab-separated rows of nine fields or more.

    header: (path, meta map, numbers map of arrays, sequence); the sequence is the comma-separated line after the heading
    `Original Trial Sequence`. Rows of fewer fields, or whose first is no number, are no trials.
    """
    lines = _lines(spark, path)
    told = lines.select("path", "line_no", F.regexp_extract("line", r"^#\s*([^:]+):\s*(.*)$", 1).alias("k"), F.regexp_extract("line", r"^#\s*([^:]+):\s*(.*)$", 2).alias("v")).filter("k <> ''")
    meta = told.groupBy("path", normal_key(F.col("k")).alias("k")).agg(F.min_by("v", "line_no").alias("v")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("meta"))
    ordered = F.regexp_extract("content", r"(?i)Original Trial Sequence[^\n]*\n[#\s]*([-\d,\s]+)", 1)
    sequence = F.transform(F.filter(F.split(F.regexp_replace(ordered, r"\s", ""), ","), lambda x: x != ""), lambda x: x.try_cast("int"))
    files = lines.filter("line_no = 0").select("path", sequence.alias("sequence"))
    header = files.join(meta, "path", "left").withColumn("numbers", F.transform_values("meta", lambda _, v: signed_decimals(v)))
    f = F.split("line", "\t")
    names = [("trial_index", "int"), ("stimulus_index", "int"), ("trial_start", "timestamp"), ("stimulus_duration", "double"), ("iti_duration", "double"), ("azimuth", "double"), ("altitude", "double"), ("az_index", "int"), ("alt_index", "int")]
    rows = lines.filter(~F.col("line").startswith("#")).withColumn("f", f).filter((F.size("f") >= 9) & F.trim(F.col("f")[0]).rlike(r"^\d+$"))
    trials = rows.select("path", *[(F.try_to_timestamp(F.trim(F.col("f")[k])) if kind == "timestamp" else F.trim(F.col("f")[k]).try_cast(kind)).alias(n) for k, (n, kind) in enumerate(names)])
    return header, trials


def read_grating_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, trials) of grating logs: `Key: value` lines, a tab table between `TRIAL DATA:` and `SUMMARY:`, a summary.

    header: (path, meta, ranges, summary): ranges are the values like [a, b]; of the summary's values, per cent are numbers.
    Rows with another number of fields than the table's heading are left out; fields are a map by the heading's names.
    """
    lines = _lines(spark, path)
    at = lines.groupBy("path").agg(F.min(F.when(F.col("line").startswith("TRIAL DATA"), F.col("line_no"))).alias("a"), F.min(F.when(F.col("line").startswith("SUMMARY"), F.col("line_no"))).alias("b"))
    placed = lines.join(at, "path").withColumn("zone", F.when(F.col("line_no") < F.coalesce("a", F.lit(1 << 30)), "head").when(F.col("line_no") > F.coalesce("b", F.lit(1 << 30)), "summary").when((F.col("line_no") > F.col("a")) & (F.col("line_no") != F.coalesce("b", F.lit(-1))), "table"))
    pair = placed.select("path", "zone", "line_no", normal_key(F.regexp_extract("line", r"^([^:\t]+):\s*(.+)$", 1)).alias("k"), F.trim(F.regexp_extract("line", r"^([^:\t]+):\s*(.+)$", 2)).alias("v")).filter("k <> '' AND v <> '' AND zone <> 'table'")
    own = pair.groupBy("path", "zone", "k").agg(F.min_by("v", "line_no").alias("v"))
    as_map = lambda z, name: own.filter(F.col("zone") == z).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name))
    header = at.select("path").join(as_map("head", "meta"), "path", "left").join(as_map("summary", "_summary"), "path", "left")
    ranged = F.map_filter("meta", lambda _, v: v.startswith("["))
    header = header.select("path", "meta", F.transform_values(ranged, lambda _, v: number_list(v)).alias("ranges"), F.transform_values("_summary", lambda _, v: F.coalesce(percent(v), v.try_cast("double"))).alias("summary"))
    table = placed.filter("zone = 'table' AND line <> ''").withColumn("f", F.split("line", "\t"))
    first = table.groupBy("path").agg(F.min_by("f", "line_no").alias("names"), F.min("line_no").alias("head_no"))
    rows = table.join(first, "path").filter((F.col("line_no") > F.col("head_no")) & (F.size("f") == F.size("names")))
    trials = rows.select("path", (F.col("line_no") - F.col("head_no")).alias("row_no"), F.map_from_arrays(F.transform("names", normal_key), F.transform("f", lambda x: F.trim(x))).alias("fields"))
    return header, trials


def typed(trials: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns (name -> type) of a fields map; null where a value does not fit."""
    return trials.select("path", "row_no", *[F.element_at("fields", F.lit(n)).try_cast(k).alias(n) for n, k in columns.items()])


def read_number_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, value): a number a line, idx from 0 in a file's order."""
    rows = _lines(spark, path).withColumn("value", F.trim("line").try_cast("double")).filter("value IS NOT NULL")
    return rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1).alias("idx"), "value")


def discover_sessions(spark: SparkSession, names: DataFrame, first: str, last: str, animals: list[str]) -> DataFrame:
    """(animal, date, session, name) of names (column name) like animal_yymmdd_session in the range; bad names are left out."""
    days = spark.range(1).select(F.explode(date_range(F.lit(first), F.lit(last))).alias("date"))
    wanted = days.withColumn("animal", F.explode(F.array(*[F.lit(a) for a in animals])))
    return parse_sessions(names).filter("animal IS NOT NULL").join(wanted, ["animal", "date"]).select("animal", "date", "session", "name")


def parse_sessions(names: DataFrame, name: str = "name") -> DataFrame:
    """names with animal, date (six digits) and session of animal_yymmdd_session; nulls where a name is malformed."""
    part = lambda k: F.nullif(F.regexp_extract(name, r"^([A-Za-z0-9]+)_(\d{6})(?:_(.+))?$", k), F.lit(""))
    return names.withColumns({"animal": part(1), "date": part(2), "session": part(3)})


def unit_catalogue(sources: list[tuple[int, DataFrame]], keys: list[str]) -> DataFrame:
    """Units of all sources, a key's row from the source of the least rank, with unit_index from 0 within the session."""
    out = None
    for rank, df in sources:
        one = df.withColumn("_rank", F.lit(rank))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    best = out.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))).filter("_r = 1").drop("_r", "_rank")
    return best.withColumn("unit_index", F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys)) - 1)


def write_trials(df: DataFrame, path: str, by: str = "session_id") -> None:
    """Nested trial records, a folder for each session; sessions that are written again are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_segments(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("rec_id", "segment").parquet(path)


def unprocessed(sessions: DataFrame, done: DataFrame, key: list[str], overwrite: bool = False) -> DataFrame:
    """Sessions that the table of finished ones does not name; all with overwrite."""
    return sessions if overwrite else sessions.join(done.select(*key).distinct(), key, "left_anti")


def run_summary(manifest: DataFrame, status: str = "status") -> DataFrame:
    return manifest.groupBy(status).agg(F.count("*").alias("n"))


def write_metrics_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_result(df: DataFrame, path: str, **parameters) -> None:
    """A result table with its run's parameters as columns."""
    df.withColumns({k: F.lit(v) for k, v in parameters.items()}).write.mode("overwrite").parquet(path)


def experiment_summary(trials: DataFrame, keys: list[str], stimulus: str, time: str) -> DataFrame:
    """(keys, trials, stimuli, duration): duration is from the first to the last start."""
    return trials.groupBy(*keys).agg(F.count("*").alias("trials"), F.count_distinct(stimulus).alias("stimuli"), (F.max(time) - F.min(time)).alias("duration"))


def session_report(trials: DataFrame, keys: list[str], stimulus: str, time: str, value: str) -> DataFrame:
    """One row on a whole table: recordings, trials, stimuli, duration, trials a recording (mean, least, most), values (n, mean, sd)."""
    v = F.col(value)
    whole = trials.agg(F.count_distinct(F.struct(*keys)).alias("recordings"), F.count("*").alias("trials"), F.count_distinct(stimulus).alias("stimuli"), (F.max(time) - F.min(time)).alias("duration"), F.count(v).alias("n_values"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    own = trials.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_trials"), F.min("n").alias("least_trials"), F.max("n").alias("most_trials"))
    return whole.crossJoin(own)
