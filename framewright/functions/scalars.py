"""Column functions for ids, payloads, labels, names and scores; all stay in generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def _no_text() -> Column:
    return F.lit(None).cast("string")


def _hex(c: Column) -> Column:
    """Base-16 text to BIGINT, null where it is not hexadecimal."""
    return F.when(c.rlike("^[0-9a-f]{1,15}$"), F.conv(c, 16, 10).cast("bigint"))


def parse_can_id(text: Column) -> Column:
    """An arbitration id, always base 16, with or without 0x."""
    return _hex(F.regexp_replace(F.lower(F.trim(text)), "^0x", ""))


def parse_can_id_trace(text: Column) -> Column:
    """As above for trace files, whose ids may have become decimals (``290.0``)."""
    return _hex(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\.0+$", ""), "^0x", ""))


def parse_signal_id(text: Column) -> Column:
    """``id5`` is 5; other ids are base 16; what is neither gets a 64-bit hash."""
    t = F.lower(F.trim(text))
    return F.coalesce(F.when(t.rlike("^id[0-9]{1,18}$"), F.substring(t, 3, 20).cast("bigint")), _hex(F.regexp_replace(t, "^0x", "")), F.xxhash64(t))


def sanitize_dlc(value: Column) -> Column:
    """Null is 0; values are held in 0..8."""
    return F.least(F.greatest(F.coalesce(value.cast("int"), F.lit(0)), F.lit(0)), F.lit(8)).cast("tinyint")


def dlc_bits_to_bytes(value: Column) -> Column:
    """Lengths of 16 and more are bits."""
    return sanitize_dlc(F.when(value >= 16, F.floor(value / 8)).otherwise(value))


def payload_bytes(hexed: Column) -> list[Column]:
    """Eight byte values of a hex payload; missing or bad pairs are 0."""

    def one(i: int) -> Column:
        pair = F.lower(F.substring(hexed, 2 * i + 1, 2))
        return F.coalesce(F.when(pair.rlike("^[0-9a-f]{2}$"), F.conv(pair, 16, 10).cast("smallint")), F.lit(0).cast("smallint"))

    return [one(i) for i in range(8)]


def odd_nibble(hexed: Column, policy: str) -> Column:
    """An odd number of hex digits: pad on the left, on the right, or keep the last digit as a byte of its own."""
    n = F.length(hexed)
    fixed = {"left": F.concat(F.lit("0"), hexed), "right": F.concat(hexed, F.lit("0")), "own": F.concat(F.substring(hexed, F.lit(1), n - 1), F.lit("0"), F.substring(hexed, n, F.lit(1)))}[policy]
    return F.when(n % 2 == 1, fixed).otherwise(hexed)


def zero_beyond_dlc(byte: Column, index: int, dlc: Column) -> Column:
    return F.when(dlc > index, byte).otherwise(F.lit(0)).cast("smallint")


def pad_payload(byte: Column | None) -> Column:
    """A missing byte column is 0; values are held in 0..255."""
    value = F.lit(0) if byte is None else F.coalesce(byte.cast("int"), F.lit(0))
    return F.least(F.greatest(value, F.lit(0)), F.lit(255)).cast("smallint")


def payload_bits(data: list[Column], msb_first: bool = True) -> Column:
    """All bits of the bytes as one array."""
    bits = [F.shiftright(b.cast("int"), (7 - k) if msb_first else k).bitwiseAND(1).cast("tinyint") for b in data for k in range(8)]
    return F.array(*bits)


def extract_signal_bits(hex16: Column, start: Column, stop: Column) -> Column:
    """Bits [start, stop) of a big-endian 64-bit payload as an unsigned number."""
    binary = F.lpad(F.conv(hex16, 16, 2), 64, "0")
    return F.conv(F.substring(binary, start + 1, stop - start), 2, 10).cast("decimal(20,0)")


def scaled_signal(hex16: Column, start: Column, stop: Column) -> Column:
    return extract_signal_bits(hex16, start, stop).cast("double") / F.pow(F.lit(2.0), (stop - start).cast("double"))


def match_payload_pattern(hex16: Column, pattern: Column) -> Column:
    """Sixteen hex digits against a pattern; a byte with an X in it matches anything, short patterns are padded with X."""
    p, h = F.rpad(F.upper(pattern), 16, "X"), F.upper(hex16)
    tests = [F.substring(p, 2 * i + 1, 2).contains("X") | (F.substring(p, 2 * i + 1, 2) == F.substring(h, 2 * i + 1, 2)) for i in range(8)]
    return reduce(lambda a, b: a & b, tests)


#: Words that mark an attack or a benign message in label columns.
ATTACK_WORDS = ("1", "t", "true", "yes", "y", "attack", "anomaly")
BENIGN_WORDS = ("0", "r", "f", "false", "no", "n", "normal", "benign", "")


def map_label_token(token: Column, policy: str = "attack") -> Column:
    """Label of a token; an unknown one is an attack, benign, null or an error by the policy."""
    t = F.lower(F.trim(F.coalesce(token, F.lit(""))))
    unknown = {"attack": F.lit(1), "benign": F.lit(0), "null": F.lit(None).cast("int"), "error": F.raise_error(F.concat(F.lit("unknown label: "), t)).cast("int")}[policy]
    return F.when(t.isin(*ATTACK_WORDS), 1).when(t.isin(*BENIGN_WORDS), 0).otherwise(unknown).cast("int")


def attack_type_from_name(name: Column, rules: list[tuple[str, str]]) -> Column:
    """First rule whose fragment is in the lower-cased name."""
    low = F.lower(name)
    out = F.when(F.lit(False), _no_text())
    for fragment, kind in rules:
        out = out.when(low.contains(fragment), F.lit(kind))
    return out


def attack_types_joined(name: Column, rules: list[tuple[str, str]]) -> Column:
    """All kinds whose fragment is in the name, each once, joined with a dash."""
    low = F.lower(name)
    kinds = F.array_distinct(F.filter(F.array(*(F.when(low.contains(f), F.lit(k)) for f, k in rules)), lambda x: x.isNotNull()))
    return F.when(F.size(kinds) > 0, F.array_join(kinds, "-"))


def vehicle_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def split_from_path(path: Column) -> Column:
    stem = F.lower(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))
    return F.when(stem.contains("train"), "train").when(stem.contains("test"), "test").otherwise(_no_text())


def normalize_attack_type(label: Column, kind: Column) -> Column:
    blank = kind.isNull() | (F.trim(kind) == "")
    return F.when(label == 0, "benign").when(blank, "attack_unknown").otherwise(F.trim(kind))


def frame_symbol(can_id: Column, frame_type: Column | None = None) -> Column:
    """(extended?, id)."""
    extended = can_id > 0x7FF
    if frame_type is not None:
        extended = extended | F.coalesce(F.lower(frame_type).startswith("ext"), F.lit(False))
    return F.struct(extended.alias("ext"), can_id.alias("id"))


def rtr_frame_type(flags: Column) -> Column:
    return F.when(flags.startswith("1"), "remote_req").otherwise("data")


def feature_name_parse(name: Column) -> Column:
    """(id, index) of ``Sig_2_of_ID_1255`` or ``110_3`` (hex id)."""
    wide = name.rlike("^Sig_[0-9]+_of_ID_[0-9]+$")
    return F.struct(
        F.when(wide, F.regexp_extract(name, r"_ID_([0-9]+)$", 1).cast("bigint")).otherwise(_hex(F.lower(F.regexp_extract(name, r"^([0-9A-Fa-f]+)_[0-9]+$", 1)))).alias("can_id"),
        F.when(wide, F.regexp_extract(name, r"^Sig_([0-9]+)_", 1)).otherwise(F.regexp_extract(name, r"_([0-9]+)$", 1)).cast("int").alias("signal"),
    )


def prediction_name_parse(stem: Column) -> Column:
    """Run parameters of ``prediction_<file>_<step>_<period>_<loss>_<time>_<pct>``, read from the right."""
    p = F.split(stem, "_")
    n = F.size(p)
    at = lambda k: F.element_at(p, -k)
    return F.struct(F.array_join(F.slice(p, F.lit(2), n - 6), "_").alias("file"), at(5).cast("int").alias("time_step"), at(4).cast("int").alias("period"), at(3).cast("double").alias("loss_factor"), at(2).cast("double").alias("time_factor"), at(1).cast("double").alias("pct"))


def minmax_scale(x: Column, low: Column, high: Column, floor: float = 1e-12) -> Column:
    return (x - low) / F.greatest(high - low, F.lit(floor))


def zscore_scale(x: Column, mean: Column, std: Column, floor: float = 1e-8) -> Column:
    return (x - mean) / F.greatest(std, F.lit(floor))


def trace_role_from_path(path: Column) -> Column:
    """benign, attack or null for files that take no part."""
    low, stem = F.lower(path), F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    skip = low.rlike("/_[^/]*/") | low.contains("generated") | stem.contains("-inj-messages")
    return F.when(skip, _no_text()).when(stem.contains("benign") | stem.contains("normal") | low.rlike("/(benign|normal|train)/"), "benign").otherwise("attack")


def trace_group_from_name(name: Column) -> Column:
    low = F.lower(name)
    length = F.regexp_extract(low, r"__n_([0-9]+)_", 1)
    return (
        F.when(low.contains("dos"), "dos_lowest")
        .when(length.rlike("^([2-9]|10)$"), F.concat(F.lit("arbitrary_"), length))
        .when(low.contains("ordered"), "ordered")
        .when(low.rlike("single.*top"), "single_top").when(low.rlike("single.*mid"), "single_mid").when(low.rlike("single.*low"), "single_low").when(low.rlike("single.*not"), "single_not")
        .otherwise("other")
    )


def time_ms_to_s(ms: Column) -> Column:
    return F.round(ms / 1000.0, 7)


def residual_mse(actual: Column, predicted: Column) -> Column:
    """Mean squared difference of two arrays."""
    return F.aggregate(F.zip_with(actual, predicted, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(actual)


def residual_abs(actual: Column, predicted: Column) -> Column:
    return F.aggregate(F.zip_with(actual, predicted, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(actual)


def dataset_tag(datasets: Column, kinds: Column) -> Column:
    """Name for a set of datasets and attack types: one, one with its only attack, or a mix of at most three."""
    d, k = F.array_sort(datasets), F.array_sort(kinds)
    many = F.concat(F.lit("mixed_"), F.array_join(F.slice(d, 1, 3), "+"), F.when(F.size(d) > 3, F.lit("+etc")).otherwise(F.lit("")))
    one = F.concat(F.element_at(d, 1), F.when(F.size(k) == 1, F.concat(F.lit("_"), F.element_at(k, 1))).otherwise(F.lit("")))
    return F.when(F.size(d) == 1, one).otherwise(many)


def expected_signals(can_id: Column, expected: dict[int, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x).cast("bigint" if n % 2 == 0 else "int") for n, x in enumerate(v for kv in expected.items() for v in kv))), can_id)
