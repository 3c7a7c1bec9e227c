"""Readers: text logs, CSV traces, metadata files and Parquet, all with fixed schemas.

Lines are parsed with SQL expressions only; a line that does not parse is left
out and counted by ``rejected``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

CANDUMP = r"^\((\d+\.\d+)\)\s+(\S+)\s+([0-9A-Fa-f]+)#([0-9A-Fa-f]{0,16})\s*$"
KEYED = r"^Timestamp:\s*(\d+\.\d+)\s+ID:\s*([0-9A-Fa-f]+)\s+(\d{3})\s+DLC:\s*(\d)((?:\s+[0-9A-Fa-f]{2})*)\s*$"


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))


def _micros(text: Column) -> Column:
    """Seconds as text to exact microseconds."""
    return (text.cast("decimal(20,6)") * 1_000_000).cast("bigint")


def _payload(hexed: Column) -> list[Column]:
    return [b.alias(f"data{i}") for i, b in enumerate(S.payload_bytes(F.rpad(hexed, 16, "0")))]


def read_candump(spark: SparkSession, paths: str | list[str], odd: str = "left", also: Iterable[str] = ()) -> DataFrame:
    """``(ts) iface ID#HEX`` logs; the policy for odd digit counts differs by dataset.

    Each policy of ``also`` gives a column of its name, with the payload as that policy reads it.
    """
    rows = _lines(spark, paths).where(F.col("line").rlike(CANDUMP))
    part = lambda k: F.regexp_extract("line", CANDUMP, k)
    out = rows.select(_micros(part(1)).alias("ts_us"), part(2).alias("iface"), S.parse_can_id(part(3)).alias("can_id"), F.upper(S.odd_nibble(part(4), odd)).alias("data_hex"), stem(F.col("path")).alias("source_file"), *(F.upper(S.odd_nibble(part(4), p)).alias(p) for p in also))
    return out.select("*", S.sanitize_dlc(F.length("data_hex") / 2).alias("dlc"), *_payload(F.substring("data_hex", 1, 16)))


def rejected(spark: SparkSession, paths: str | list[str], pattern: str = CANDUMP) -> DataFrame:
    """Lines that do not parse, counted by file."""
    return _lines(spark, paths).where(~F.col("line").rlike(pattern)).groupBy(stem(F.col("path")).alias("source_file")).agg(F.count("*").alias("n"))


def read_keyed_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``Timestamp: t ID: hex flags DLC: n bytes`` logs; remote requests have no bytes."""
    rows = _lines(spark, paths).where(F.col("line").rlike(KEYED))
    part = lambda k: F.regexp_extract("line", KEYED, k)
    data = F.upper(F.regexp_replace(part(5), r"\s+", ""))
    out = rows.select(_micros(part(1)).alias("ts_us"), S.parse_can_id(part(2)).alias("can_id"), part(3).alias("flags"), part(4).cast("tinyint").alias("dlc"), data.alias("data_hex"), S.rtr_frame_type(part(3)).alias("frame_type"), stem(F.col("path")).alias("source_file"))
    return out.select("*", *_payload(F.col("data_hex")))


def read_frames_csv(spark: SparkSession, paths: str | list[str], sep: str = ",", base: int = 16) -> DataFrame:
    """Headerless ``ts,id,dlc,b0..b7,flag``; short rows keep their flag as the last field that is there."""
    names = ["ts", "id", "dlc", *(f"b{i}" for i in range(8)), "flag"]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(paths, sep=sep, mode="PERMISSIVE").select("*", F.col("_metadata.file_path").alias("path"))
    flag = F.coalesce(*(F.when(F.upper(F.trim(n)).isin("R", "T"), F.upper(F.trim(n))) for n in reversed(names[3:])))
    byte = lambda n: F.when(F.trim(n).rlike("^[0-9A-Fa-f]{1,2}$"), F.conv(F.trim(n), base, 10).cast("smallint"))
    data = [S.pad_payload(byte(f"b{i}")).alias(f"data{i}") for i in range(8)]
    return rows.select(_micros(F.col("ts")).alias("ts_us"), S.parse_can_id(F.col("id")).alias("can_id"), S.sanitize_dlc(F.expr("try_cast(dlc AS int)")).alias("dlc"), *data, F.when(flag == "T", 1).otherwise(0).alias("label"), stem(F.col("path")).alias("source_file"))


#: canonical name -> accepted header names, lower-cased
TRACE_ALIASES = {
    "ts": ("timestamp", "time", "ts"),
    "can_id": ("can_id", "id", "canid", "arbitration_id"),
    "dlc": ("dlc", "length"),
    "payload": ("payload_hex", "payload", "data"),
    "label": ("anomaly", "label", "attack"),
}


def read_trace_csv(spark: SparkSession, paths: str | list[str], sep: str = ",") -> DataFrame:
    """CSV traces with headers in any case, found by an alias list."""
    raw = spark.read.csv(paths, sep=sep, header=True, inferSchema=False)
    have = {c.strip().lower(): c for c in raw.columns}
    pick = {k: next((F.col(f"`{have[a]}`") for a in names if a in have), F.lit(None).cast("string")) for k, names in TRACE_ALIASES.items()}
    missing = [k for k in ("ts", "can_id") if not set(TRACE_ALIASES[k]) & set(have)]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    data = F.rpad(F.coalesce(F.upper(pick["payload"]), F.lit("")), 16, "0")
    dlc = F.expr("try_cast(dlc_text AS int)")
    out = raw.select(_micros(pick["ts"]).alias("ts_us"), S.parse_can_id_trace(pick["can_id"]).alias("can_id"), pick["dlc"].alias("dlc_text"), data.alias("data_hex"), S.map_label_token(pick["label"]).alias("label"), stem(F.col("_metadata.file_path")).alias("source_file"))
    return out.withColumn("dlc", S.dlc_bits_to_bytes(dlc)).drop("dlc_text")


def read_signal_csv(spark: SparkSession, paths: str | list[str], signals: int = 4) -> DataFrame:
    """``Label,Time,ID,Signal1..`` with or without a header line; short rows end in nulls."""
    names = ["label", "time", "id", *(f"s{k}" for k in range(signals))]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(paths, mode="PERMISSIVE").select("*", F.col("_metadata.file_path").alias("path"))
    rows = rows.where(F.lower(F.trim("label")) != "label")
    return rows.select(F.expr("try_cast(time AS double)").alias("time_ms"), S.time_ms_to_s(F.expr("try_cast(time AS double)")).alias("ts_s"), S.parse_signal_id(F.col("id")).alias("can_id"), S.map_label_token(F.col("label")).alias("label"), F.array(*(F.expr(f"try_cast(s{k} AS double)") for k in range(signals))).alias("signals"), stem(F.col("path")).alias("source_file"))


def read_signal_csv_wide(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Headers ``Label,Time,ID,Signal_k_of_ID``: the signals become one array in the order of k."""
    import re

    raw = spark.read.csv(paths, header=True, inferSchema=False)
    order = sorted((int(m[1]), c) for c in raw.columns if (m := re.fullmatch(r"Signal_?(\d+)_of_ID", c.strip())))
    col = {c.strip().lower(): c for c in raw.columns}
    core = lambda n: F.col(f"`{col[n]}`") if n in col else F.lit(None).cast("string")
    return raw.select(core("time").cast("double").alias("ts_s"), core("id").cast("bigint").alias("can_id"), S.map_label_token(core("label")).alias("label"), F.array(*(F.col(f"`{c}`").cast("double") for _, c in order)).alias("signals"), stem(F.col("_metadata.file_path")).alias("source_file"))


#: Lines of one Arrow batch of an archive.
ZIP_BATCH = 10_000


def read_zip_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of the first CSV file in each zip archive, in their order.

    Spark lists the archives (their content is not read); each task opens its archives on the file system that
    their path names, seeks to the member and streams it in batches, so no archive is ever held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import itertools
        import zipfile

        from pyarrow import fs

        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            # Spark's paths are not escaped
            local = path.startswith("file:")
            system, at = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(quote(path, safe=":/@?&="))
            with system.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
                name = next((n for n in sorted(z.namelist()) if n.lower().endswith(".csv")), None)
                if name is None:
                    continue
                with z.open(name) as member:
                    lines = (line.rstrip("\r\n") for line in io.TextIOWrapper(member, "utf-8"))
                    for first in itertools.count(0, ZIP_BATCH):
                        block = list(itertools.islice(lines, ZIP_BATCH))
                        if not block:
                            break
                        numbers = pa.array(range(first, first + len(block)), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(block)), numbers, pa.array(block, pa.string())], names=["path", "line_no", "line"])

    listed = spark.read.format("binaryFile").load(paths).select("path")
    dealt = listed.repartition(spark.sparkContext.defaultParallelism)  # archives, not bytes, are dealt
    return dealt.mapInArrow(run, "path string, line_no long, line string").select(stem(F.col("path")).alias("source_file"), "line_no", "line")


CAPTURE = "map<string, struct<elapsed_sec: double, on_dyno: boolean, injected_aid: string, injection_data: string, injection_interval: array<double>>>"


def read_capture_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A directory's JSON object keyed by capture name: one row per capture."""
    doc = spark.read.text(paths, wholetext=True).select(F.from_json("value", CAPTURE).alias("m"))
    return doc.select(F.explode("m").alias("capture", "c")).select("capture", "c.elapsed_sec", "c.on_dyno", S.parse_can_id(F.col("c.injected_aid")).alias("injected_id"), F.col("c.injection_data").alias("pattern"), F.try_element_at("c.injection_interval", F.lit(1)).alias("start_s"), F.try_element_at("c.injection_interval", F.lit(2)).alias("end_s"))


def match_captures(files: DataFrame, captures: DataFrame) -> DataFrame:
    """source_file -> capture: the exact name first, then without ``_masquerade``, then in any case."""
    from pyspark.sql import Window

    base = F.regexp_replace("source_file", "_masquerade$", "")
    names = files.withColumn("_k", F.explode(F.array_distinct(F.array(F.lower("source_file"), F.lower(base)))))
    found = names.join(captures.withColumn("_k", F.lower("capture")), "_k", "left").drop("_k")
    rank = F.when(F.col("capture") == F.col("source_file"), 0).when(F.col("capture") == base, 1).when(F.col("capture").isNotNull(), 2).otherwise(3)
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("source_file").orderBy(rank, "capture"))).where("_r = 1").drop("_r")


MARKERS = "label string, markers array<struct<description: string, time: double, packet_ID: string>>"


def read_attack_markers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per-log marker files to intervals: the k-th start of an id pairs with its k-th end; missing bounds are open, swapped ones are put right."""
    from pyspark.sql import Window

    doc = spark.read.schema(MARKERS).json(paths, multiLine=True).select(stem(F.col("_metadata.file_path")).alias("source_file"), F.explode("markers").alias("m"))
    m = doc.select("source_file", S.parse_can_id(F.col("m.packet_ID")).alias("can_id"), F.col("m.time").alias("at"), F.when(F.lower("m.description").contains("start"), "s").otherwise("e").alias("kind"))
    m = m.withColumn("k", F.row_number().over(Window.partitionBy("source_file", "can_id", "kind").orderBy("at")))
    pair = m.groupBy("source_file", "can_id", "k").agg(F.max(F.when(F.col("kind") == "s", F.col("at"))).alias("a"), F.max(F.when(F.col("kind") == "e", F.col("at"))).alias("b"))
    a, b = F.coalesce("a", F.lit(float("-inf"))), F.coalesce("b", F.lit(float("inf")))
    return pair.select("source_file", "can_id", F.least(a, b).alias("start_s"), F.greatest(a, b).alias("end_s"))


def read_parquet_glob(spark: SparkSession, globs: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Frames of one or many globs, each file once, with the file's stem as source_file."""
    globs = list(dict.fromkeys([globs] if isinstance(globs, str) else globs))
    df = spark.read.parquet(*globs)
    kept = df.select(*(columns or df.columns), F.col("_metadata.file_path").alias("_path"))
    return kept.withColumn("source_file", stem(F.col("_path"))).drop("_path")


def concat_time_offset(df: DataFrame, gap_us: int = 1_000_000) -> DataFrame:
    """Files in the order of their names, each one shifted to begin after the end of those before it plus a gap."""
    from pyspark.sql import Window

    ends = df.groupBy("source_file").agg(F.max("ts_us").alias("end"))  # one row a file
    before = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("source_file", F.coalesce(F.sum(F.col("end") + gap_us).over(before), F.lit(0)).alias("offset"))
    return df.join(offsets, "source_file").withColumn("ts_us", F.col("ts_us") + F.col("offset")).drop("offset")


def read_signal_mask(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``id,index,start,stop`` bit ranges; a range outside 0 <= start < stop <= 64 is an error."""
    m = spark.read.schema("id string, index int, start int, stop int").csv(paths, header=True)
    bad = (F.col("start") < 0) | (F.col("start") >= F.col("stop")) | (F.col("stop") > 64)
    return m.select(S.parse_can_id(F.col("id")).alias("can_id"), "index", F.when(bad, F.raise_error(F.lit("bad bit range")).cast("int")).otherwise(F.col("start")).alias("start"), "stop")


def read_scaler_bounds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows ``<file>_max`` / ``<file>_min`` with a column per signal: the widest bounds of each signal."""
    raw = spark.read.csv(paths, header=True, inferSchema=False)
    name = raw.columns[0]
    long = raw.withColumnRenamed(name, "row").unpivot(["row"], raw.columns[1:], "signal", "value").withColumn("value", F.col("value").cast("double"))
    return long.groupBy("signal").agg(F.min(F.when(F.col("row").endswith("_min"), F.col("value"))).alias("low"), F.max(F.when(F.col("row").endswith("_max"), F.col("value"))).alias("high"))


def source_inventory(df: DataFrame, top: int = 5) -> DataFrame:
    """Per file: rows, ids, attack rows and their times, and the most frequent attack ids."""
    base = df.groupBy("source_file").agg(F.count("*").alias("n_rows"), F.count_distinct("can_id").alias("n_ids"), F.sum("label").alias("n_attack"), F.min(F.when(F.col("label") == 1, F.col("ts_us"))).alias("first_attack"), F.max(F.when(F.col("label") == 1, F.col("ts_us"))).alias("last_attack"))
    return base.join(topk_attack_ids(df, top).groupBy("source_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "can_id"))), lambda x: x.can_id).alias("top_ids")), "source_file", "left")


def topk_attack_ids(df: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    counts = df.where("label = 1").groupBy("source_file", "can_id").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("n"), "can_id"))).where(F.col("rank") <= k)
