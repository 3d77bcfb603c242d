"""Table shapes."""

SAMPLES = "node string, cluster string, ts_ms bigint, metric string, labels map<string,string>, value double"
NODES = "node string, host string, port int, cluster string"
HISTORY = "node string, ts_ms bigint, e2e_ms double, decode_ms double, cache_hits double, reqs double"
BACKENDS = "backends array<struct<up: boolean, external_ip: string>>"
SECTION = "struct<total_active: bigint, total_configs_active: bigint, config_freq: map<string,bigint>>"
CAPACITY = f"active_calls bigint, max_calls bigint, vi_max_calls bigint, exotel_max_calls bigint, vacant_slots bigint, `TOTAL DISTRIBUTION` {SECTION}, `VI` {SECTION}, `EXOTEL` {SECTION}, `ACTIVE DISTRIBUTION` {SECTION}"
SECTIONS = ("TOTAL DISTRIBUTION", "VI", "EXOTEL", "ACTIVE DISTRIBUTION")
