"""Queries of readers and sinks: bridge rows are written as text by Spark, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bridge
from ..registry import Registry
from ..scratch import scratch
from ..sources import readers as I
from ..sources import sinks as O

R = Registry()
WITH = "WITH " + bridge.DUCK + " "
TS = "CAST(ts_us AS DECIMAL(20,6)) / 1000000"


def f(spark, sf):
    return bridge.frames(spark, sf)


def seconds(c="ts_us"):
    return (F.col(c).cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)").cast("string")


def text(df, line, spark, what, per_file=False):
    path = scratch(spark, what)
    rows = df.select(line.alias("value"), *(["source_file"] if per_file else []))
    (rows.repartition("source_file").write.partitionBy("source_file") if per_file else rows.write).text(path)
    return path


def hexid(width=1):
    """The id in base 16 with at least ``width`` digits; a longer one stays whole."""
    h = F.lower(F.conv(F.col("can_id").cast("string"), 10, 16))
    return F.when(F.length(h) < width, F.lpad(h, width, "0")).otherwise(h)


BYTES = ", ".join(f"CAST(coalesce(try_cast('0x' || nullif(substr(data_hex, {2 * i + 1}, 2), '') AS INT), 0) AS INT) AS data{i}" for i in range(8))


def ints(*names):
    return [F.col(n).cast("int").alias(n) for n in names]


def candump(spark, sf):
    line = F.concat(F.lit("("), seconds(), F.lit(") can0 "), F.upper(hexid()), F.lit("#"), F.col("data_hex"))
    rows = f(spark, sf)
    return text(rows.select("*").withColumn("line", line).select("source_file", F.explode(F.array("line", F.when(F.col("idx_src") % 50 == 0, F.lit("# broken line")))).alias("line")).where("line IS NOT NULL"), F.col("line"), spark, "candump")


@R.add("scan_candump", WITH + f"SELECT ts_us, can_id, dlc, data_hex, {BYTES} FROM f")
def _(spark, sf):
    return I.read_candump(spark, candump(spark, sf)).select("ts_us", "can_id", *ints("dlc"), "data_hex", *ints(*(f"data{i}" for i in range(8))))


@R.add("scan_candump_rejected", WITH + "SELECT count(*) AS n FROM f WHERE idx_src % 50 = 0")
def _(spark, sf):
    return I.rejected(spark, candump(spark, sf)).agg(F.sum("n").alias("n"))


ODD = {"left": "'0' || h", "right": "h || '0'", "own": "h[:-2] || '0' || h[-1:]"}


@R.add("scan_candump_oddnibble", WITH + ", o AS (SELECT ts_us, CASE WHEN length(data_hex) > 2 THEN data_hex[:-2] ELSE '7' END AS h FROM f) SELECT ts_us, " + ", ".join(f"{e} AS {n}" for n, e in ODD.items()) + " FROM o")
def _(spark, sf):
    h = F.expr("CASE WHEN length(data_hex) > 2 THEN substring(data_hex, 1, length(data_hex) - 1) ELSE '7' END")
    path = text(f(spark, sf), F.concat(F.lit("("), seconds(), F.lit(") can0 1#"), h), spark, "odd")
    return I.read_candump(spark, path, also=ODD).select("ts_us", *ODD)  # one reading: times may repeat


def keyed(spark, sf, flags):
    spaced = F.regexp_replace("data_hex", "(..)", " $1")
    line = F.concat(F.lit("Timestamp:          "), seconds(), F.lit("        ID: "), hexid(4), F.lit("    "), flags, F.lit("    DLC: "), F.col("dlc").cast("string"), F.lit("   "), F.lower(spaced))
    return text(f(spark, sf), line, spark, "keyed")


@R.add("scan_keyed_log", WITH + f"SELECT ts_us, can_id, dlc, CASE WHEN dlc = 0 THEN 'remote_req' ELSE 'data' END AS frame_type, data_hex, {BYTES} FROM f")
def _(spark, sf):
    path = keyed(spark, sf, F.when(F.col("dlc") == 0, "100").otherwise("000"))
    return I.read_keyed_log(spark, path).select("ts_us", "can_id", *ints("dlc"), "frame_type", "data_hex", *ints(*(f"data{i}" for i in range(8))))


@R.add("scan_keyed_log_normal", WITH + f"SELECT ts_us, can_id, 0 AS label, {BYTES} FROM f")
def _(spark, sf):
    return I.read_keyed_log(spark, keyed(spark, sf, F.lit("000"))).select("ts_us", "can_id", F.when(F.col("flags") == "000", 0).otherwise(1).alias("label"), *ints(*(f"data{i}" for i in range(8))))


@R.add("scan_frames_csv", WITH + f"SELECT ts_us, can_id, dlc, label, {BYTES} FROM f")
def _(spark, sf):
    byte = [F.when(F.col("dlc") > i, F.substring("data_hex", 2 * i + 1, 2)) for i in range(8)]
    line = F.concat_ws(",", seconds(), hexid(4), F.col("dlc").cast("string"), *byte, F.when(F.col("label") == 1, "T").otherwise("R"))
    return I.read_frames_csv(spark, text(f(spark, sf), line, spark, "frames")).select("ts_us", "can_id", *ints("dlc", "label", *(f"data{i}" for i in range(8))))


@R.add("scan_trace_csv", WITH + "SELECT ts_us, can_id, dlc, rpad(data_hex, 16, '0') AS data_hex, label FROM f")
def _(spark, sf):
    path = scratch(spark, "trace")
    f(spark, sf).select(seconds().alias("TimeStamp"), F.concat(hexid(), F.when(F.col("idx_src") % 2 == 0, ".0").otherwise("")).alias("ID"), F.when(F.col("dlc") > 1, F.col("dlc") * 8).otherwise(F.col("dlc")).alias("DLC"), F.col("data_hex").alias("Payload_Hex"), F.when(F.col("label") == 1, "True").otherwise("false").alias("ANOMALY")).write.csv(path, header=True)
    return I.read_trace_csv(spark, path).select("ts_us", "can_id", *ints("dlc"), "data_hex", *ints("label"))


def signal_lines(spark, sf, header):
    line = F.concat_ws(",", F.col("label").cast("string"), F.col("idx_src").cast("string"), F.concat(F.lit("id"), F.col("can_id").cast("string")), F.col("signal1").cast("string"), F.when(F.col("dlc") > 3, F.col("dlc").cast("string")))
    rows = f(spark, sf).select(line.alias("line"), "source_file")
    return text(rows.unionByName(rows.limit(1).select(F.lit("Label,Time,ID,Signal1_of_ID,Signal2_of_ID").alias("line"), "source_file")) if header else rows, F.col("line"), spark, "signal")


@R.add("scan_signal_csv", WITH + "SELECT can_id, label, round(idx_src / 1000.0, 7)::DOUBLE AS ts_s, signal1 AS s1, CASE WHEN dlc > 3 THEN dlc::DOUBLE END AS s2 FROM f")
def _(spark, sf):
    return I.read_signal_csv(spark, signal_lines(spark, sf, True), 2).select("can_id", *ints("label"), "ts_s", F.col("signals")[0].alias("s1"), F.col("signals")[1].alias("s2"))


@R.add("ragged_row_pad", WITH + "SELECT idx_src::DOUBLE AS time_ms, CASE WHEN dlc > 3 THEN 2 ELSE 1 END AS present FROM f")
def _(spark, sf):
    return I.read_signal_csv(spark, signal_lines(spark, sf, False), 4).select("time_ms", F.size(F.filter("signals", lambda x: x.isNotNull())).alias("present"))


@R.add("scan_signal_csv_wide", WITH + "SELECT can_id, label, idx_src::DOUBLE AS ts_s, signal1 AS s1, dlc::DOUBLE AS s2 FROM f")
def _(spark, sf):
    path = scratch(spark, "wide")
    f(spark, sf).select(F.col("label").alias("Label"), F.col("dlc").alias("Signal_2_of_ID"), F.col("can_id").alias("ID"), F.col("idx_src").alias("Time"), F.col("signal1").alias("Signal_1_of_ID")).write.csv(path, header=True)
    return I.read_signal_csv_wide(spark, path).select("can_id", *ints("label"), "ts_s", F.col("signals")[0].alias("s1"), F.col("signals")[1].alias("s2"))


@R.add("scan_capture_metadata", WITH + ", d AS (SELECT source_file, min(can_id) AS injected_id, min(dlc)::DOUBLE AS start_s, max(dlc)::DOUBLE AS end_s FROM f GROUP BY 1) SELECT source_file, injected_id, start_s, end_s FROM d")
def _(spark, sf):
    d = f(spark, sf).groupBy("source_file").agg(F.min("can_id").alias("can_id"), F.min("dlc").cast("double").alias("a"), F.max("dlc").cast("double").alias("b"))
    path = scratch(spark, "captures")
    entry = F.struct(F.lit(1.0).alias("elapsed_sec"), F.lit(True).alias("on_dyno"), F.concat(F.lit("0x"), hexid()).alias("injected_aid"), F.lit("XX").alias("injection_data"), F.array("a", "b").alias("injection_interval"))
    d.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("Day_"), F.col("source_file")), entry)))).alias("value")).write.text(path)
    files = d.select(F.concat(F.lit("day_"), F.col("source_file"), F.lit("_masquerade")).alias("source_file"))
    found = I.match_captures(files, I.read_capture_metadata(spark, path))
    return found.select(F.regexp_extract("source_file", "day_(.*)_masquerade", 1).alias("source_file"), "injected_id", "start_s", "end_s")


@R.add("scan_attack_markers", WITH + "SELECT can_id, min(dlc)::DOUBLE AS start_s, CASE WHEN can_id % 3 = 0 THEN 'inf'::DOUBLE ELSE max(dlc) + 1.0 END AS end_s FROM f GROUP BY can_id")
def _(spark, sf):
    d = f(spark, sf).groupBy("can_id").agg(F.min("dlc").cast("double").alias("a"), (F.max("dlc") + 1.0).alias("b"))
    m = lambda what, at: F.struct(F.lit(what).alias("description"), F.col(at).alias("time"), hexid().alias("packet_ID"))
    marks = d.select(F.explode(F.array(m("Start of the attack", "a"), F.when(F.col("can_id") % 3 != 0, m("End of the attack", "b")))).alias("m")).where("m IS NOT NULL")
    path = scratch(spark, "markers")
    marks.agg(F.to_json(F.struct(F.lit("attack").alias("label"), F.collect_list("m").alias("markers"))).alias("value")).write.text(path)
    return I.read_attack_markers(spark, path).select("can_id", "start_s", "end_s")


@R.add("scan_parquet_glob", "SELECT (SELECT count(*) FROM nation) AS nation, (SELECT count(*) FROM region) AS region")
def _(spark, sf):
    n = I.read_parquet_glob(spark, [f"{sf}/natio*.parquet", f"{sf}/natio*.parquet"], ["n_name"]).withColumnRenamed("n_name", "name")
    r = I.read_parquet_glob(spark, f"{sf}/region.parquet", ["r_name"]).withColumnRenamed("r_name", "name")
    both = n.withColumn("t", F.lit("nation")).unionByName(r.withColumn("t", F.lit("region")))
    return both.agg(F.count_if(F.col("t") == "nation").alias("nation"), F.count_if(F.col("t") == "region").alias("region"))


@R.add("concat_time_offset", WITH + ", r AS (SELECT idx_src, source_file, ts_us - min(ts_us) OVER (PARTITION BY source_file) AS t FROM f), e AS (SELECT source_file, sum(max(t) + 1000000) OVER (ORDER BY source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM r GROUP BY 1) SELECT idx_src, CAST(t + coalesce(o, 0) AS BIGINT) AS ts_us FROM r JOIN e USING (source_file)")
def _(spark, sf):
    from ..operators.clean import rebase_time

    return I.concat_time_offset(rebase_time(f(spark, sf))).select("idx_src", "ts_us")


@R.add("scan_signal_mask", WITH + "SELECT can_id, dlc AS index, dlc * 4 AS start, dlc * 4 + 8 AS stop FROM f GROUP BY ALL")
def _(spark, sf):
    path = scratch(spark, "mask")
    f(spark, sf).select(F.concat(F.lit("0x"), hexid()).alias("id"), F.col("dlc").alias("index"), (F.col("dlc") * 4).alias("start"), (F.col("dlc") * 4 + 8).alias("stop")).distinct().write.csv(path, header=True)
    return I.read_signal_mask(spark, path)


@R.add("scan_scaler_bounds", WITH + "SELECT 'signal1' AS signal, min(signal1) AS low, max(signal1) AS high FROM f UNION ALL SELECT 'dlc', min(dlc), max(dlc) FROM f")
def _(spark, sf):
    path = scratch(spark, "bounds")
    g = f(spark, sf).groupBy("source_file")
    low = g.agg(F.min("signal1").alias("signal1"), F.min("dlc").alias("dlc")).withColumn("source_file", F.concat("source_file", F.lit("_min")))
    high = g.agg(F.max("signal1").alias("signal1"), F.max("dlc").alias("dlc")).withColumn("source_file", F.concat("source_file", F.lit("_max")))
    low.unionByName(high).write.csv(path, header=True)
    return I.read_scaler_bounds(spark, path)


TOP = "SELECT source_file, can_id, n, rank FROM (SELECT source_file, can_id, count(*) AS n, CAST(row_number() OVER (PARTITION BY source_file ORDER BY count(*) DESC, can_id) AS INT) AS rank FROM f WHERE label = 1 GROUP BY 1, 2) WHERE rank <= 5"


@R.add("topk_attack_ids", WITH + TOP)
def _(spark, sf):
    return I.topk_attack_ids(f(spark, sf), 5)


@R.add("source_inventory", WITH + f", t AS (SELECT source_file, string_agg(can_id, ',' ORDER BY rank) AS top_ids FROM ({TOP}) GROUP BY 1) SELECT source_file, count(*) AS n_rows, count(DISTINCT can_id) AS n_ids, CAST(sum(label) AS BIGINT) AS n_attack, min(ts_us) FILTER (label = 1) AS first_attack, max(ts_us) FILTER (label = 1) AS last_attack, any_value(top_ids) AS top_ids FROM f LEFT JOIN t USING (source_file) GROUP BY 1")
def _(spark, sf):
    return I.source_inventory(f(spark, sf)).withColumn("top_ids", F.array_join("top_ids", ","))


@R.add("sink_canonical", WITH + "SELECT source_file, count(*) AS n, CAST(sum(can_id) AS BIGINT) AS ids FROM f GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "canonical")
    O.write_canonical(f(spark, sf).withColumn("dataset", F.lit("events")), path)
    O.write_canonical(f(spark, sf).limit(0).withColumn("dataset", F.lit("events")), path)  # the first output stays
    back = spark.read.schema("idx_src bigint, can_id bigint, dataset string, source_file string").parquet(path)
    return back.groupBy("source_file").agg(F.count("*").alias("n"), F.sum("can_id").alias("ids"))


def wide_metrics(spark, sf):
    return f(spark, sf).groupBy("source_file").agg(F.count("*").alias("n"), F.sum("label").alias("attacks"))


LONG = "SELECT source_file, 'n' AS metric, count(*)::DOUBLE AS value FROM f GROUP BY 1 UNION ALL SELECT source_file, 'attacks', sum(label)::DOUBLE FROM f GROUP BY 1"


@R.add("sink_metrics", WITH + LONG)
def _(spark, sf):
    path = scratch(spark, "metrics")
    O.write_metrics(O.metrics_long(wide_metrics(spark, sf), ["source_file"], ["n", "attacks"]), path)
    return spark.read.schema("source_file string, metric string, value double").json(f"{path}/json")


@R.add("metrics_json", WITH + "SELECT source_file, '{\"source_file\":\"' || source_file || '\",\"metrics\":{\"attacks\":' || CAST(sum(label)::DOUBLE AS VARCHAR) || ',\"n\":' || CAST(count(*)::DOUBLE AS VARCHAR) || '}}' AS document FROM f GROUP BY 1")
def _(spark, sf):
    return O.metrics_json(O.metrics_long(wide_metrics(spark, sf), ["source_file"], ["n", "attacks"]), ["source_file"])


#: Rows of a file that go to one archive.
ZIP_ROWS = 1_000_000


@R.add("scan_zip_csv", WITH + "SELECT source_file, idx_src, can_id, label FROM f")
def _(spark, sf):
    """Bridge rows zipped by executors, an archive for each file and block of rows, and read again."""
    path = scratch(spark, "zips")

    def zipped(key, rows):
        import io
        import zipfile

        from pyarrow import fs

        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("trace.csv", "\n".join(rows["line"].to_pylist()))
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder)
        with system.open_output_stream(f"{folder}/{key[0].as_py()}_{key[1].as_py()}.zip") as out:
            out.write(held.getvalue())
        return rows.slice(0, 1).select(["line"])

    rows = f(spark, sf).select("source_file", F.floor(F.col("idx_src") / ZIP_ROWS).alias("block"), F.concat_ws(",", "idx_src", "can_id", "label").alias("line"))
    rows.groupBy("source_file", "block").applyInArrow(zipped, "line string").count()
    lines = I.read_zip_lines(spark, f"{path}/*.zip")
    parts = F.split("line", ",")
    return lines.select(F.regexp_replace("source_file", "_[0-9]+$", "").alias("source_file"), parts[0].cast("bigint").alias("idx_src"), parts[1].cast("bigint").alias("can_id"), parts[2].cast("int").alias("label"))
