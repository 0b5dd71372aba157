"""Wire names, texts, limits and defaults that results depend on."""

# Wire formats
ALPHA = "alpha-v1"
BETA = "beta-v1"
GAMMA = "gamma-v1"
GAMMA_TIME_PATTERN = "yyyyMMdd HH:mm:ss.SSS"

# Message guard
MAX_MESSAGE_BYTES = 64 * 1024
TEXT_MESSAGE = "text"
OVERSIZE_ERROR = "Message exceeds 65536 bytes"
NON_TEXT_ERROR = "Non-text message"
UNKNOWN_SOURCE_ERROR = "Source is not configured"

# Tick validation, in the order the rules apply
SYMBOL_EMPTY = "Ticker must not be empty"
SOURCE_EMPTY = "Source must not be empty"
PRICE_NOT_POSITIVE = "Price must be positive"
VOLUME_NEGATIVE = "Volume must not be negative"
TIME_UNSET = "Timestamp must be specified"

# Identity
FIELD_SEPARATOR = "\u001f"
TICKS_PER_MICRO = 10
TICKS_AT_UNIX_EPOCH = 621355968000000000
FIRST_MICRO = -62135596800000000  # 0001-01-01T00:00:00Z
LAST_MICRO = 253402300799999999  # 9999-12-31T23:59:59.999999Z

# In-flight and stored number types
FLIGHT_DECIMAL = "decimal(38,18)"
STORED_DECIMAL = "decimal(28,10)"

# Stored text limits
SOURCE_CHARS = 64
SYMBOL_CHARS = 32

# Defaults
DEDUP_WINDOW_MS = 120_000
BATCH_SIZE = 500
FLUSH_INTERVAL_MS = 250
MAX_RETRIES = 4
RETRY_INITIAL_MS = 250
RETRY_MAX_MS = 2_000
IDLE_TIMEOUT_MS = 5_000
STABILITY_MS = 30_000
STREAK_CAP = 31
HEARTBEAT_MS = 10_000
REPLAY_COUNT = 5

# Health states
HEALTHY = "healthy"
DEGRADED = "degraded"
