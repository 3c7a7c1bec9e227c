"""Fixed schemas of the stored tables."""

from __future__ import annotations

BYTES = [f"data{i}" for i in range(8)]

FRAMES = (
    "ts_s DOUBLE, ts_us BIGINT, can_id BIGINT, dlc TINYINT, "
    + ", ".join(f"{b} SMALLINT" for b in BYTES)
    + ", data_hex STRING, label TINYINT, attack_type STRING, dataset STRING, frame_type STRING, vehicle STRING, split STRING, idx_src BIGINT, inter_arrival DOUBLE, source_file STRING"
)
SIGNALS = "ts_s DOUBLE, ts_us BIGINT, can_id BIGINT, label TINYINT, attack_type STRING, dataset STRING, split STRING, idx_src BIGINT, inter_arrival DOUBLE, signals ARRAY<DOUBLE>, source_file STRING"
INTERVALS = "source_file STRING, can_id BIGINT, start_us BIGINT, end_us BIGINT"
