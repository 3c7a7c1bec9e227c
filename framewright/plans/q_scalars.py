"""Queries of the scalar functions, over ids and payloads of the bridge frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bridge
from ..functions import scalars as S
from ..registry import Registry

R = Registry()
WITH = "WITH " + bridge.DUCK + " "
HEX16 = "rpad(data_hex, 16, '0')"


def simple(name: str, spark_columns, duck: str) -> None:
    """A projection of frames: idx_src and some columns."""

    def query(spark, sf_dir):
        return bridge.frames(spark, sf_dir).select("idx_src", *spark_columns())

    R.add(name, WITH + f"SELECT idx_src, {duck} FROM f")(query)


hexed = lambda: F.lower(F.conv(F.col("can_id").cast("string"), 10, 16))
simple("parse_can_id", lambda: [S.parse_can_id(F.concat(F.lit(" 0x"), F.upper(hexed()))).alias("can_id"), S.parse_can_id(F.lit("zz")).alias("bad")], "can_id, CAST(NULL AS BIGINT) AS bad")
simple("parse_can_id_trace", lambda: [S.parse_can_id_trace(F.concat(hexed(), F.when(F.col("idx_src") % 2 == 0, F.lit(".0")).otherwise(F.lit("")))).alias("can_id")], "can_id")
simple("parse_signal_id", lambda: [S.parse_signal_id(F.when(F.col("idx_src") % 2 == 0, F.concat(F.lit("id"), F.col("can_id"))).otherwise(F.concat(F.lit("0x"), hexed()))).alias("can_id")], "can_id")
simple("sanitize_dlc", lambda: [S.sanitize_dlc(F.when(F.col("dlc") == 3, None).otherwise(F.col("dlc") * 3 - 5)).cast("int").alias("dlc")], "CAST(CASE WHEN dlc = 3 THEN 0 ELSE least(greatest(dlc * 3 - 5, 0), 8) END AS INT) AS dlc")
simple("dlc_bits_to_bytes", lambda: [S.dlc_bits_to_bytes(F.col("dlc") * 8).cast("int").alias("dlc")], "CAST(least(CASE WHEN dlc * 8 >= 16 THEN dlc ELSE dlc * 8 END, 8) AS INT) AS dlc")
_BYTE = "CAST(coalesce(try_cast('0x' || nullif(substr(data_hex, {0}, 2), '') AS INT), 0) AS INT)"
simple("payload_bytes", lambda: [b.cast("int").alias(f"data{i}") for i, b in enumerate(S.payload_bytes(F.col("data_hex")))], ", ".join(_BYTE.format(2 * i + 1) + f" AS data{i}" for i in range(8)))
simple("zero_beyond_dlc", lambda: [S.zero_beyond_dlc(b, i, F.col("dlc") - 2).cast("int").alias(f"data{i}") for i, b in enumerate(S.payload_bytes(F.col("data_hex")))], ", ".join(f"CASE WHEN dlc - 2 > {i} THEN {_BYTE.format(2 * i + 1)} ELSE 0 END AS data{i}" for i in range(8)))
simple("pad_payload", lambda: [S.pad_payload(F.col("can_id") * 3 - 50).cast("int").alias("data0"), S.pad_payload(None).cast("int").alias("data1")], "CAST(least(greatest(can_id * 3 - 50, 0), 255) AS INT) AS data0, 0 AS data1")
simple("payload_bits", lambda: [F.array_join(S.payload_bits(S.payload_bytes(F.col("data_hex"))), "").alias("msb"), F.array_join(S.payload_bits(S.payload_bytes(F.col("data_hex"))[:1], False), "").alias("lsb")],
       "right(CAST(CAST(CAST('0x' || " + HEX16 + " AS UBIGINT) AS BIT) AS VARCHAR), 64) AS msb, reverse(right(CAST(CAST(CAST('0x' || substr(" + HEX16 + ", 1, 2) AS UTINYINT) AS BIT) AS VARCHAR), 8)) AS lsb")
simple("extract_signal_bits", lambda: [S.extract_signal_bits(F.rpad("data_hex", 16, "0"), F.lit(a), F.lit(b)).alias(f"s{a}_{b}") for a, b in ((0, 8), (4, 20), (12, 13), (32, 64), (0, 64))],
       ", ".join(f"CAST((CAST('0x' || {HEX16} AS UBIGINT) >> {64 - b}) & ((1::HUGEINT << {b - a}) - 1)::UBIGINT AS DECIMAL(20,0)) AS s{a}_{b}" for a, b in ((0, 8), (4, 20), (12, 13), (32, 64), (0, 64))))
simple("scaled_signal", lambda: [S.scaled_signal(F.rpad("data_hex", 16, "0"), F.lit(8), F.lit(24)).alias("x")], f"CAST((CAST('0x' || {HEX16} AS UBIGINT) >> 40) & 65535 AS DOUBLE) / 65536 AS x")
simple("match_payload_pattern", lambda: [S.match_payload_pattern(F.rpad("data_hex", 16, "0"), F.lit(p)).alias(f"p{n}") for n, p in enumerate(("XXXXXXXXXXXX0000", "CXXXFX", "C4"))],
       f"substr({HEX16}, 13, 4) = '0000' AS p0, true AS p1, substr({HEX16}, 1, 2) = 'C4' AS p2")
simple("map_label_token", lambda: [S.map_label_token(F.when(F.col("scenario") == "error", " True").when(F.col("scenario") == "view", "Normal").when(F.col("scenario") == "click", "R").otherwise(F.col("scenario")), p).alias(p) for p in ("attack", "benign", "null")],
       "CASE WHEN scenario = 'error' THEN 1 WHEN scenario IN ('view', 'click') THEN 0 ELSE 1 END AS attack, CASE WHEN scenario = 'error' THEN 1 ELSE 0 END AS benign, CASE WHEN scenario = 'error' THEN 1 WHEN scenario IN ('view', 'click') THEN 0 END AS \"null\"")
_RULES = [("masquerade", "masquerade"), ("correlated", "correlated"), ("fuzz", "fuzzing"), ("dos", "dos")]
_NAME = lambda: F.concat("scenario", F.element_at(F.array(*map(F.lit, ("_masquerade_correlated", "_Fuzzing", "_dos_fuzz", ""))), (F.col("idx_src") % 4 + 1).cast("int")))
simple("attack_type_from_name", lambda: [S.attack_type_from_name(_NAME(), _RULES).alias("kind"), S.attack_types_joined(_NAME(), _RULES).alias("kinds")],
       "CASE idx_src % 4 WHEN 0 THEN 'masquerade' WHEN 1 THEN 'fuzzing' WHEN 2 THEN 'fuzzing' END AS kind, CASE idx_src % 4 WHEN 0 THEN 'masquerade-correlated' WHEN 1 THEN 'fuzzing' WHEN 2 THEN 'fuzzing-dos' END AS kinds")
_PATH = lambda: F.concat(F.lit("/data/car"), F.col("can_id"), F.when(F.col("label") == 1, "/test_").otherwise("/Train-"), F.col("scenario"), F.lit(".log"))
simple("vehicle_split_from_path", lambda: [S.vehicle_from_path(_PATH()).alias("vehicle"), S.split_from_path(_PATH()).alias("split")], "'car' || can_id AS vehicle, CASE WHEN label = 1 THEN 'test' ELSE 'train' END AS split")
simple("normalize_attack_type", lambda: [S.normalize_attack_type(F.col("label"), F.when(F.col("idx_src") % 3 == 0, " ").when(F.col("idx_src") % 3 == 1, F.col("scenario"))).alias("kind")],
       "CASE WHEN label = 0 THEN 'benign' WHEN idx_src % 3 = 1 THEN scenario ELSE 'attack_unknown' END AS kind")
simple("frame_symbol", lambda: [S.frame_symbol(F.col("can_id") * 30, F.when(F.col("label") == 1, "Extended")).getField(x).alias(x) for x in ("ext", "id")], "can_id * 30 > 2047 OR label = 1 AS ext, can_id * 30 AS id")
simple("rtr_frame_type", lambda: [S.rtr_frame_type(F.when(F.col("dlc") == 0, "100").otherwise("000")).alias("frame_type")], "CASE WHEN dlc = 0 THEN 'remote_req' ELSE 'data' END AS frame_type")
simple("feature_name_parse", lambda: [S.feature_name_parse(F.when(F.col("label") == 1, F.concat(F.lit("Sig_"), F.col("dlc"), F.lit("_of_ID_"), F.col("can_id"))).otherwise(F.concat(hexed(), F.lit("_"), F.col("dlc")))).getField(x).alias(x) for x in ("can_id", "signal")], "can_id, dlc AS signal")
simple("prediction_name_parse", lambda: [S.prediction_name_parse(F.concat(F.lit("prediction_run_"), F.col("scenario"), F.lit("_50_"), F.col("dlc"), F.lit("_95_99.5_"), F.col("can_id"))).getField(x).alias(x) for x in ("file", "time_step", "period", "loss_factor", "time_factor", "pct")],
       "'run_' || scenario AS file, 50 AS time_step, dlc AS period, 95.0::DOUBLE AS loss_factor, 99.5::DOUBLE AS time_factor, CAST(can_id AS DOUBLE) AS pct")
simple("trace_role_from_path", lambda: [S.trace_role_from_path(F.concat(F.element_at(F.array(*map(F.lit, ("/d/_tmp/", "/d/benign/", "/d/x/", "/d/x/inj-"))), (F.col("idx_src") % 4 + 1).cast("int")), F.col("scenario"), F.when(F.col("idx_src") % 4 == 3, "-inj-messages.log").otherwise(".log"))).alias("role")],
       "CASE idx_src % 4 WHEN 1 THEN 'benign' WHEN 2 THEN 'attack' END AS role")
simple("trace_group_from_name", lambda: [S.trace_group_from_name(F.element_at(F.array(*map(F.lit, ("Single_top_x", "a__n_7_b", "ordered1", "DoS_1", "single-mid", "q"))), (F.col("idx_src") % 6 + 1).cast("int"))).alias("grp")],
       "CASE idx_src % 6 WHEN 0 THEN 'single_top' WHEN 1 THEN 'arbitrary_7' WHEN 2 THEN 'ordered' WHEN 3 THEN 'dos_lowest' WHEN 4 THEN 'single_mid' ELSE 'other' END AS grp")
simple("time_ms_to_s", lambda: [S.time_ms_to_s(F.col("idx_src") * 37).alias("t")], "round(idx_src * 37 / 1000.0, 7)::DOUBLE AS t")
_A, _B = (lambda: F.array(F.col("signal1"), F.col("dlc").cast("double"))), (lambda: F.array(F.col("dlc").cast("double"), F.col("signal1") / 2))
simple("residual_mse", lambda: [F.round(S.residual_mse(_A(), _B()), 8).alias("mse")], "round(((signal1 - dlc) ** 2 + (dlc - signal1 / 2) ** 2) / 2, 8) AS mse")
simple("residual_abs", lambda: [F.round(S.residual_abs(_A(), _B()), 6).alias("mae")], "round((abs(signal1 - dlc) + abs(dlc - signal1 / 2)) / 2, 6) AS mae")
simple("expected_signal_map", lambda: [S.expected_signals(F.col("can_id"), {1: 4, 2: 2, 5: 1}).alias("n")], "CASE can_id WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 5 THEN 1 END AS n")


@R.add("minmax_scale", WITH + "SELECT idx_src, round((signal1 - min(signal1) OVER (PARTITION BY can_id)) / greatest(max(signal1) OVER (PARTITION BY can_id) - min(signal1) OVER (PARTITION BY can_id), 1e-12), 9) AS x FROM f")
def minmax(spark, sf_dir):
    f = bridge.frames(spark, sf_dir)
    bounds = f.groupBy("can_id").agg(F.min("signal1").alias("low"), F.max("signal1").alias("high"))
    return f.join(bounds, "can_id").select("idx_src", F.round(S.minmax_scale(F.col("signal1"), F.col("low"), F.col("high")), 9).alias("x"))


@R.add("zscore_scale", WITH + "SELECT idx_src, round((signal1 - avg(signal1) OVER (PARTITION BY can_id)) / greatest(stddev_pop(signal1) OVER (PARTITION BY can_id), 1e-8), 6) AS x FROM f")
def zscore(spark, sf_dir):
    f = bridge.frames(spark, sf_dir)
    stats = f.groupBy("can_id").agg(F.avg("signal1").alias("m"), F.stddev_pop("signal1").alias("s"))
    return f.join(stats, "can_id").select("idx_src", F.round(S.zscore_scale(F.col("signal1"), F.col("m"), F.col("s")), 6).alias("x"))


@R.add("dataset_tag", WITH + "SELECT dlc, CASE WHEN count(DISTINCT scenario) = 1 THEN min(scenario) ELSE 'mixed_' || array_to_string(list_sort(list(DISTINCT scenario))[1:3], '+') || CASE WHEN count(DISTINCT scenario) > 3 THEN '+etc' ELSE '' END END AS tag FROM f GROUP BY dlc")
def tag(spark, sf_dir):
    f = bridge.frames(spark, sf_dir).groupBy("dlc").agg(F.collect_set("scenario").alias("d"), F.collect_set("source_file").alias("k"))
    return f.select("dlc", S.dataset_tag(F.col("d"), F.col("k")).alias("tag"))
