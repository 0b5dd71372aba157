"""Row layouts."""

RAW = "source_name string, payload string, message_type string, received_at timestamp, seq bigint"

SOURCES = "name string, format string, idle_timeout_ms bigint"

# The identity of a tick is a digest of the other content columns, so rows with one id agree on all of them.
CONTENT = ["id", "symbol", "price", "volume", "event_time", "event_ticks", "source"]
ARRIVAL = ["received_at", "seq"]
TICK = CONTENT + ARRIVAL

MARKET_TICKS = (
    "id string, source string, symbol string, price decimal(28,10), volume decimal(28,10), "
    "event_time timestamp, received_at timestamp, persisted_at timestamp"
)
# Folder levels of the stored table.
TABLE_PARTITIONS = "event_date date, source string, load_id string"

DEAD_LETTER = (
    "tick struct<id:string,symbol:string,price:decimal(38,18),volume:decimal(38,18),timestamp:timestamp,"
    "source:string,received_at:timestamp>, "
    "failed_at timestamp, error_type string, error_message string"
)

ANCHORS = "id string, anchor_at timestamp"
