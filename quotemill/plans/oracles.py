"""The same results in SQL, computed from the tables without messages, parsing or Spark."""

from __future__ import annotations

from ..config import Options

WINDOW = 120_000_000
IDLE = 1_800_000_000
STABLE = 7_200_000_000
DELAY = 600_000_000


def _feed(extended: bool) -> str:
    """Common tables: e events, m messages with their error, v valid ticks with ids."""
    guards = (
        """WHEN event_id % 997 = 0 THEN 'oversize'
           WHEN event_id % 101 = 0 THEN 'binary'"""
        if extended
        else ""
    )
    stored = (
        """WHEN event_id % 499 = 0 THEN 'long symbol'
           WHEN event_id % 503 = 0 THEN 'tiny price'
           WHEN event_id % 509 = 0 THEN 'huge volume'"""
        if extended
        else ""
    )
    return f"""
e AS (
  SELECT event_id, epoch_us(ts) AS ts_us,
         CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source,
         CASE user_id % 3 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' ELSE 'Gamma' END AS label,
         CASE event_type WHEN 'click' THEN 'EURUSD' WHEN 'view' THEN 'GBPUSD' WHEN 'signup' THEN 'USDJPY'
                         WHEN 'purchase' THEN 'XAUUSD' WHEN 'error' THEN 'BTCUSD' END AS name,
         CAST(value AS DECIMAL(18,2)) AS quote,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events
),
d AS (
  SELECT *, CASE {guards}
           WHEN event_id % 97 = 0 THEN 'malformed'
           WHEN event_id % 89 = 0 THEN 'zero price'
           WHEN event_id % 83 = 0 THEN 'negative volume'
           WHEN event_id % 79 = 0 THEN 'blank symbol'
           WHEN quote <= 0 THEN 'zero price'
           {stored}
           ELSE 'none' END AS defect
  FROM e
),
c AS (
  SELECT d.*, delay FROM d, (VALUES (0), (1), (120)) AS copies(delay)
  WHERE delay = 0
     OR (defect IN ('none', 'long symbol', 'tiny price', 'huge volume')
         AND ((delay = 1 AND event_id % 100 = 0) OR (delay = 120 AND event_id % 250 = 0)))
),
m AS (
  SELECT event_id * 10 + CASE delay WHEN 120 THEN 2 ELSE delay END AS seq,
         source, label, defect,
         ts_us + 1000000 + delay * 1000000 AS received_us,
         ts_us - ts_us % 1000 AS event_us,
         (ts_us - ts_us % 1000) * 10 + 621355968000000000 AS event_ticks,
         CASE defect WHEN 'long symbol' THEN repeat(name, 6) ELSE name END AS symbol,
         CASE defect WHEN 'tiny price' THEN 0.00000000001::DOUBLE ELSE CAST(quote AS DOUBLE) END AS price,
         CASE defect WHEN 'tiny price' THEN '1E-11'
                     ELSE rtrim(rtrim(CAST(quote AS VARCHAR), '0'), '.') END AS price_text,
         CASE defect WHEN 'huge volume' THEN 1234567890123456789::DOUBLE
                     ELSE CAST((k + 1) * 1000 AS DOUBLE) END AS volume,
         CASE defect WHEN 'huge volume' THEN '1234567890123456789'
                     ELSE CAST((k + 1) * 1000 AS VARCHAR) END AS volume_text,
         CASE WHEN defect = 'oversize' THEN 'Message exceeds 65536 bytes'
              WHEN defect = 'binary' THEN 'Non-text message'
              WHEN defect = 'malformed' THEN label || ' JSON is invalid'
              WHEN defect = 'blank symbol' THEN label || ' payload misses ' ||
                   CASE source WHEN 'alpha' THEN 'symbol or price' WHEN 'beta' THEN 's or q'
                               ELSE 'instrument.ticker or time' END
              WHEN defect = 'zero price' THEN label || ' tick is invalid: Price must be positive'
              WHEN defect = 'negative volume' THEN label || ' tick is invalid: Volume must not be negative'
              WHEN defect = 'tiny price' AND source = 'alpha' THEN 'Alpha price ''1E-11'' is invalid'
         END AS error
  FROM c
),
h AS (
  SELECT *, sha256(source || chr(31) || symbol || chr(31) || price_text || chr(31) || volume_text || chr(31)
                   || CAST(event_ticks AS VARCHAR)) AS x
  FROM m WHERE error IS NULL
),
v AS (
  SELECT * EXCLUDE (x),
         substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) || '-' ||
         substr(x, 11, 2) || substr(x, 9, 2) || '-' || substr(x, 15, 2) || substr(x, 13, 2) || '-' ||
         substr(x, 17, 4) || '-' || substr(x, 21, 12) AS id
  FROM h
)"""


_ACCEPTED = f"""
a AS (
  SELECT id, seq, received_us FROM (
    SELECT id, seq, received_us, row_number() OVER (PARTITION BY id ORDER BY received_us, seq) AS rn FROM v
  ) WHERE rn = 1
  UNION ALL
  SELECT id, seq, received_us FROM (
    SELECT v.id, v.seq, v.received_us,
           row_number() OVER (PARTITION BY v.id ORDER BY v.received_us, v.seq) AS rn
    FROM a JOIN v ON v.id = a.id AND v.received_us >= a.received_us + {WINDOW}
  ) WHERE rn = 1
),
t AS (SELECT v.* FROM v JOIN a USING (id, seq, received_us))"""

_ROUTED = """
b AS (
  SELECT *, seq // 500 AS batch_no,
         CASE WHEN defect = 'long symbol' THEN 'value too long for type character varying(32)'
              WHEN defect = 'huge volume' THEN 'numeric field overflow'
              WHEN defect = 'tiny price' THEN 'new row violates check constraint "market_ticks_price_check"'
         END AS violation
  FROM t
),
f AS (
  SELECT source, batch_no, arg_min(violation, CAST(received_us AS HUGEINT) * 1000000000000 + seq) AS failure
  FROM b WHERE violation IS NOT NULL GROUP BY ALL
),
r AS (SELECT b.*, f.failure FROM b LEFT JOIN f USING (source, batch_no)),
w AS (
  SELECT *, CASE WHEN failure IS NOT NULL THEN 'dead_lettered'
                 WHEN row_number() OVER (PARTITION BY id, failure IS NULL ORDER BY received_us, seq) = 1 THEN 'written'
                 ELSE 'conflict' END AS outcome
  FROM r
)"""


def _with(select: str, extended: bool = False, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([_feed(extended), *more]) + "\n" + select


_VIEW = "id, source, symbol, price, volume, event_us, received_us"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_us, seq) = 1"

_GAPS = f"""
p AS (
  SELECT source, received_us, seq,
         lag(received_us) OVER (PARTITION BY source ORDER BY received_us, seq) AS previous
  FROM m
),
n AS (
  SELECT *, sum(CASE WHEN previous IS NULL OR received_us - previous >= {IDLE} THEN 1 ELSE 0 END)
            OVER (PARTITION BY source ORDER BY received_us, seq ROWS UNBOUNDED PRECEDING) AS session_no
  FROM p
),
s AS (
  SELECT source, CAST(session_no AS BIGINT) AS session_no, min(received_us) AS first_at, max(received_us) AS last_at,
         count(*) AS messages
  FROM n GROUP BY ALL
),
z AS (
  SELECT *, lead(session_no) OVER (PARTITION BY source ORDER BY session_no) IS NOT NULL AS ended,
         last_at - first_at + CASE WHEN lead(session_no) OVER (PARTITION BY source ORDER BY session_no) IS NOT NULL
                                   THEN {IDLE} ELSE 0 END AS duration
  FROM s
)"""

_TOTALS = """
counts AS (
  SELECT source,
         count(*) FILTER (defect <> 'oversize') AS raw,
         count(*) FILTER (defect <> 'oversize' AND error IS NOT NULL) AS invalid,
         count(*) FILTER (error IS NULL) AS valid,
         count(*) FILTER (defect = 'oversize') AS oversize
  FROM m GROUP BY source
),
ends AS (
  SELECT source, count(*) AS accepted, count(*) FILTER (outcome = 'written') AS written,
         count(*) FILTER (outcome = 'conflict') AS conflict,
         count(*) FILTER (outcome = 'dead_lettered') AS dead_lettered
  FROM w GROUP BY source
),
o AS (SELECT *, valid - accepted AS duplicate FROM counts JOIN ends USING (source))"""

_LINES = """
l AS (
  SELECT CASE l_suppkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source,
         CASE l_partkey % 5 WHEN 0 THEN 'EURUSD' WHEN 1 THEN 'GBPUSD' WHEN 2 THEN 'USDJPY' WHEN 3 THEN 'XAUUSD'
                            ELSE 'BTCUSD' END AS symbol,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS quote,
         CAST(l_quantity AS BIGINT) * 1000 AS lots,
         epoch_us(l_shipdate) + l_orderkey * 1000 AS event_us
  FROM lineitem
),
x AS (
  SELECT *, sha256(source || chr(31) || symbol || chr(31) || rtrim(rtrim(CAST(quote AS VARCHAR), '0'), '.')
                   || chr(31) || CAST(lots AS VARCHAR) || chr(31)
                   || CAST(event_us * 10 + 621355968000000000 AS VARCHAR)) AS h
  FROM l
),
y AS (
  SELECT * EXCLUDE (h),
         substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' ||
         substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' ||
         substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id
  FROM x
)"""


def _normalized(source: str) -> str:
    return _with(
        f"SELECT seq, source, symbol, price, volume, event_us, received_us FROM v WHERE source = '{source}'"
    )


_HEARTBEAT = """
SELECT (beat + 1) * 10000000 AS at,
       CAST(sum(raw) OVER o AS BIGINT) AS raw, CAST(sum(accepted) OVER o AS BIGINT) AS accepted,
       CAST(sum(raw - invalid - accepted) OVER o AS BIGINT) AS duplicate, CAST(sum(invalid) OVER o AS BIGINT) AS invalid
FROM q WINDOW o AS (ORDER BY beat ROWS UNBOUNDED PRECEDING)"""

ORACLES: dict[str, str] = {
    "tick_counts_by_source": _with(
        "SELECT source, symbol, count(*) AS ticks FROM t GROUP BY ALL", False, _ACCEPTED
    ),
    "tick_normalize_alpha": _normalized("alpha"),
    "tick_normalize_beta": _normalized("beta"),
    "tick_normalize_gamma": _normalized("gamma"),
    "tick_identity": _with("SELECT seq, id, event_ticks FROM v"),
    "decimal_text": """
WITH e AS (
  SELECT event_id, event_id % 10 AS style, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS p FROM events
)
SELECT event_id,
       CASE style WHEN 0 THEN p WHEN 1 THEN ' ' || p || chr(9) WHEN 2 THEN p || '-' WHEN 3 THEN '+' || p
                  WHEN 4 THEN '1,0' || p WHEN 5 THEN p || 'e1' WHEN 6 THEN '- ' || p WHEN 7 THEN ''
                  WHEN 8 THEN p || ' - ' ELSE '.' || CAST(event_id % 1000 AS VARCHAR) END AS number_text,
       CASE style WHEN 0 THEN CAST(p AS DOUBLE) WHEN 1 THEN CAST(p AS DOUBLE) WHEN 2 THEN 0 - CAST(p AS DOUBLE)
                  WHEN 3 THEN CAST(p AS DOUBLE) WHEN 4 THEN CAST('10' || p AS DOUBLE)
                  WHEN 8 THEN 0 - CAST(p AS DOUBLE)
                  WHEN 9 THEN CAST('0.' || CAST(event_id % 1000 AS VARCHAR) AS DOUBLE) END AS parsed
FROM e""",
    "decimal_canonical": """
WITH n AS (
  SELECT event_id, CAST(abs(CAST(value AS DECIMAL(18,2))) * 100 AS BIGINT) AS units, 2 + event_id % 8 AS shift
  FROM events
),
s AS (
  SELECT *, CAST(units AS VARCHAR) AS digits, rtrim(CAST(units AS VARCHAR), '0') AS short,
         lpad(CAST(units AS VARCHAR), CAST(greatest(shift + 1, length(CAST(units AS VARCHAR))) AS INTEGER), '0') AS wide
  FROM n
)
SELECT event_id,
       CASE WHEN units = 0 THEN '0'
            WHEN length(digits) - 1 - shift < -4 THEN
              short[1] || CASE WHEN length(short) > 1 THEN '.' || short[2:] ELSE '' END || 'E-' ||
              lpad(CAST(shift + 1 - length(digits) AS VARCHAR), 2, '0')
            ELSE rtrim(rtrim(wide[1:length(wide) - shift] || '.' || wide[length(wide) - shift + 1:], '0'), '.')
       END AS number_text
FROM s""",
    "json_strictness": """
SELECT event_id AS seq,
       CASE WHEN event_id % 16 IN (0, 13, 14, 15) THEN 'valid' ELSE 'invalid' END AS status,
       CASE WHEN event_id % 16 IN (0, 13, 14, 15) THEN 'none'
            WHEN event_id % 16 = 8 THEN 'Beta payload misses s or q'
            ELSE 'Beta JSON is invalid' END AS error
FROM events""",
    "message_guard": _with(
        """SELECT source AS source_name,
       CASE WHEN defect = 'oversize' THEN 'oversize' WHEN error IS NOT NULL THEN 'invalid' ELSE 'valid' END AS status,
       CASE WHEN defect IN ('oversize', 'binary') THEN error ELSE 'read' END AS guard, count(*) AS messages
FROM m GROUP BY ALL""",
        True,
    ),
    "tick_rejects_by_reason": _with(
        """SELECT source AS source_name, error, count(*) AS messages FROM m
WHERE error IS NOT NULL AND defect <> 'oversize' GROUP BY ALL""",
        True,
    ),
    "reject_sink": _with(
        """SELECT seq, source AS source_name, received_us, error FROM m
WHERE error IS NOT NULL AND defect <> 'oversize'""",
        True,
    ),
    "source_lookup": _with(
        """SELECT label AS source_name, source || '-v1' AS format, CAST(5000 AS BIGINT) AS idle_timeout_ms,
       count(*) AS messages FROM m GROUP BY ALL"""
    ),
    "dedup_window": _with(
        """SELECT v.seq, v.id, v.received_us, a.id IS NULL AS is_duplicate
FROM v LEFT JOIN a ON a.id = v.id AND a.seq = v.seq AND a.received_us = v.received_us""",
        False,
        _ACCEPTED,
    ),
    "dedup_live_keys": _with(
        f"""SELECT as_of_us, count(DISTINCT id) AS live_keys
FROM (SELECT max(received_us) AS as_of_us FROM m) LEFT JOIN a ON received_us <= as_of_us
 AND received_us > as_of_us - {WINDOW} GROUP BY ALL""",
        False,
        _ACCEPTED,
    ),
    "dedup_in_batch": _with(f"SELECT id, seq, received_us FROM v {_FIRST}"),
    "idempotent_load": _with(f"SELECT {_VIEW}, 'first' AS load_id FROM t {_FIRST}", False, _ACCEPTED),
    "estimated_keys": _with(
        "SELECT source, received_us // 86400000000 AS day, count(DISTINCT id) AS keys, true AS near FROM t GROUP BY ALL", False, _ACCEPTED
    ),
    "lost_messages": """
WITH c AS (
  SELECT CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source, event_id // 3 AS n
  FROM events WHERE event_id % 61 > 2 AND event_id % 1000 >= 40
),
p AS (SELECT source, n, lag(n) OVER (PARTITION BY source ORDER BY n) AS previous FROM c)
SELECT source, previous + 1 AS first_missing, n - 1 AS last_missing, n - previous - 1 AS missing FROM p WHERE n - previous > 1""",
    "payload_ids": """
SELECT source_name, count(*) AS ticks,
       count(*) FILTER (source_name = 'alpha' OR (epoch_us(ts) * 10 + event_id % 10) % 10000 = 0) AS same
FROM events, (VALUES ('alpha'), ('beta'), ('gamma')) f(source_name) WHERE value > 0 GROUP BY source_name""",
    "compacted_table": _with(f"SELECT {_VIEW}, CAST(1 AS BIGINT) AS loads FROM t {_FIRST}", False, _ACCEPTED),
    "load_conflicts": _with(
        """SELECT source, count(*) AS attempted,
       CASE WHEN source = 'gamma' THEN count(DISTINCT id) ELSE 0 END AS written,
       count(*) - CASE WHEN source = 'gamma' THEN count(DISTINCT id) ELSE 0 END AS conflicts,
       CASE WHEN source = 'gamma' THEN 0 ELSE count(DISTINCT id) END AS stored_ids
FROM t GROUP BY source""",
        False,
        _ACCEPTED,
    ),
    "resilient_write": _with(
        f"""SELECT source, if(source = 'alpha', ids, 0) AS written, if(source = 'alpha', ticks - ids, 0) AS conflicts,
       if(source = 'beta', ticks, 0) AS dead_lettered, if(source = 'gamma', ticks, 0) AS dropped,
       CAST(CASE source WHEN 'alpha' THEN 2 WHEN 'beta' THEN 1 ELSE {Options().max_retries + 1} END AS BIGINT)
         AS attempt_failures,
       if(source = 'alpha', ids, 0) AS stored, if(source = 'beta', ticks, 0) AS buried
FROM (SELECT source, count(*) AS ticks, count(DISTINCT id) AS ids FROM t GROUP BY source)""",
        False,
        _ACCEPTED,
    ),
    "constraint_violations": _with(
        """SELECT source, CASE defect WHEN 'long symbol' THEN 'value too long for type character varying(32)'
       WHEN 'huge volume' THEN 'numeric field overflow'
       ELSE 'new row violates check constraint "market_ticks_price_check"' END AS violation, count(*) AS ticks
FROM v WHERE defect <> 'none' GROUP BY ALL""",
        True,
    ),
    "dead_letter_batches": _with(
        """SELECT source, batch_no, failure, count(*) AS ticks, count(violation) AS bad_ticks
FROM r WHERE failure IS NOT NULL GROUP BY ALL""",
        True,
        _ACCEPTED,
        _ROUTED,
    ),
    "dead_letter_records": _with(
        f"""SELECT {_VIEW}, 'ConstraintViolation' AS error_type, failure AS error_message
FROM r WHERE failure IS NOT NULL""",
        True,
        _ACCEPTED,
        _ROUTED,
    ),
    "outcomes_by_source": _with(
        """SELECT source, outcome, n FROM (
  UNPIVOT (SELECT source, raw, invalid, duplicate, accepted, written, conflict, dead_lettered, oversize FROM o)
  ON COLUMNS(* EXCLUDE (source)) INTO NAME outcome VALUE n
) WHERE n > 0""",
        True,
        _ACCEPTED,
        _ROUTED,
        _TOTALS,
    ),
    "outcome_counters": _with(
        """SELECT CAST(sum(raw) AS BIGINT) AS raw_ticks_received, CAST(sum(accepted) AS BIGINT) AS ticks_accepted,
       CAST(sum(duplicate) AS BIGINT) AS duplicate_ticks, CAST(sum(invalid) AS BIGINT) AS invalid_ticks,
       CAST(sum(written) AS BIGINT) AS ticks_written, CAST(sum(conflict) AS BIGINT) AS database_conflicts,
       CAST((SELECT count(DISTINCT (source, batch_no)) FROM r WHERE failure IS NOT NULL) AS BIGINT)
         AS database_write_attempt_failures,
       CAST(sum(dead_lettered) AS BIGINT) AS ticks_dead_lettered,
       CAST(sum(accepted) - sum(written) - sum(conflict) - sum(dead_lettered) AS BIGINT) AS ticks_dropped,
       CAST((SELECT count(*) - count(DISTINCT source) FROM s) AS BIGINT) AS reconnects_scheduled
FROM o""",
        True,
        _ACCEPTED,
        _ROUTED,
        _TOTALS,
        _GAPS,
    ),
    "reconciliation": _with(
        """SELECT source, raw, accepted, raw - accepted - duplicate - invalid AS received_gap,
       accepted - written - conflict - dead_lettered AS accepted_gap,
       raw = accepted + duplicate + invalid AND accepted = written + conflict + dead_lettered AS balanced FROM o""",
        True,
        _ACCEPTED,
        _ROUTED,
        _TOTALS,
    ),
    "heartbeat_10s": _with(
        _HEARTBEAT,
        True,
        _ACCEPTED,
        """
q AS (
  SELECT m.received_us // 10000000 AS beat, count(*) AS raw, count(m.error) AS invalid, count(t.id) AS accepted
  FROM m LEFT JOIN t ON t.seq = m.seq WHERE m.defect <> 'oversize' GROUP BY ALL
)""",
    ),
    "heartbeat_line": _with(
        f"""SELECT ends AS at, CAST(sum(raw) OVER o AS BIGINT) AS raw, CAST(sum(accepted) OVER o AS BIGINT) AS accepted,
       CAST(sum(raw - invalid - accepted) OVER o AS BIGINT) AS duplicate, CAST(sum(invalid) OVER o AS BIGINT) AS invalid,
       CAST(sum(written) OVER o AS BIGINT) AS written, CAST(sum(conflict) OVER o AS BIGINT) AS conflicts,
       CAST(sum(dead_lettered) OVER o AS BIGINT) AS dead_lettered, CAST(0 AS BIGINT) AS dropped,
       (SELECT count(*) FROM tries WHERE tries.received_us < ends) AS attempt_failures,
       (SELECT count(*) FROM s WHERE session_no > 1 AND first_at < ends) AS reconnects,
       (SELECT count(*) FROM a WHERE received_us < ends AND received_us + {WINDOW} > ends) AS live_keys,
       (SELECT string_agg(name || CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.source = name AND first_at < ends AND ends < last_at + {IDLE})
                                       THEN '=up' ELSE '=down' END, ',' ORDER BY name)
        FROM (VALUES ('alpha'), ('beta'), ('delta'), ('gamma')) names(name)) AS sources
FROM beats WINDOW o AS (ORDER BY ends ROWS UNBOUNDED PRECEDING)""",
        True,
        _ACCEPTED,
        _ROUTED,
        _GAPS,
        """
tries AS (SELECT source, batch_no, max(received_us) AS received_us FROM r WHERE failure IS NOT NULL GROUP BY ALL),
beats AS (
  SELECT (m.received_us // 10000000 + 1) * 10000000 AS ends, count(*) AS raw, count(m.error) AS invalid, count(w.id) AS accepted,
         count(*) FILTER (w.outcome = 'written') AS written, count(*) FILTER (w.outcome = 'conflict') AS conflict,
         count(*) FILTER (w.outcome = 'dead_lettered') AS dead_lettered
  FROM m LEFT JOIN w ON w.seq = m.seq WHERE m.defect <> 'oversize' GROUP BY ALL
)""",
    ),
    "stored_audit": _with(
        """SELECT m.source, m.received_us // 3600000000 AS hour, count(*) AS received, count(m.error) AS rejected,
       count(*) - count(m.error) - count(w.id) AS duplicate, count(w.id) AS accepted,
       count(*) FILTER (w.outcome = 'written') AS stored, count(*) FILTER (w.outcome = 'dead_lettered') AS buried,
       count(*) FILTER (w.outcome = 'conflict') AS conflict, CAST(0 AS BIGINT) AS received_gap, true AS received_same,
       CAST(0 AS BIGINT) AS accepted_gap, true AS accepted_same
FROM m LEFT JOIN w ON w.seq = m.seq WHERE m.defect <> 'oversize' GROUP BY ALL""",
        True,
        _ACCEPTED,
        _ROUTED,
    ),
    "idle_gaps": _with(
        f"""SELECT source, previous AS stalled_after, received_us AS resumed_at, received_us - previous AS gap
FROM p WHERE received_us - previous >= {IDLE}""",
        False,
        _GAPS,
    ),
    "source_sessions": _with(
        "SELECT source, session_no, first_at, last_at, messages, ended, duration FROM z", False, _GAPS
    ),
    "flap_streaks": _with(
        f"""SELECT source, session_no, duration, stable,
       CAST(least(row_number() OVER (PARTITION BY source, island ORDER BY session_no), 31) AS INTEGER) AS streak
FROM (
  SELECT source, session_no, duration, duration >= {STABLE} AS stable,
         sum(CASE WHEN duration >= {STABLE} THEN 1 ELSE 0 END)
           OVER (PARTITION BY source ORDER BY session_no ROWS UNBOUNDED PRECEDING) AS island
  FROM z WHERE ended
)""",
        False,
        _GAPS,
    ),
    "reconnects": _with("SELECT source, count(*) - 1 AS reconnects FROM s GROUP BY source", False, _GAPS),
    "source_health": _with(
        f"""SELECT names.source, last_at, coalesce(as_of - last_at < {IDLE}, false) AS connected,
       false AS all_sources_connected, 'degraded' AS status
FROM (VALUES ('alpha'), ('beta'), ('gamma'), ('delta')) AS names(source)
CROSS JOIN (SELECT max(received_us) AS as_of FROM m)
LEFT JOIN (SELECT source, max(received_us) AS last_at FROM m GROUP BY source) AS seen ON seen.source = names.source"""
    ),
    "source_states": _with(
        f"""SELECT string_agg(source || '=' || CASE WHEN as_of - last_at >= {IDLE} THEN 'down' ELSE 'up' END,
                  ',' ORDER BY source) AS sources
FROM (SELECT source, max(received_us) AS last_at FROM m GROUP BY source), (SELECT max(received_us) AS as_of FROM m)"""
    ),
    "instrument_history": _with(
        f"SELECT {_VIEW} FROM (SELECT * FROM t {_FIRST}) WHERE source = 'alpha' AND symbol = 'EURUSD' ORDER BY event_us DESC, id",
        False,
        _ACCEPTED,
    ),
    "latest_ticks": _with(f"SELECT {_VIEW} FROM (SELECT * FROM t {_FIRST}) ORDER BY event_us DESC, id LIMIT 100", False, _ACCEPTED),
    "latest_per_instrument": _with(
        f"""SELECT {_VIEW} FROM (SELECT * FROM t {_FIRST})
QUALIFY row_number() OVER (PARTITION BY source, symbol ORDER BY event_us DESC, id DESC) = 1""",
        False,
        _ACCEPTED,
    ),
    "replay_slice": _with(
        """SELECT source AS source_name, CAST(row_number() OVER (PARTITION BY source ORDER BY received_us, seq) AS INTEGER) AS position,
       seq, received_us
FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY received_us DESC, seq DESC) <= 5)"""
    ),
    "payload_roundtrip": _with(
        """SELECT source_name, count(*) AS ticks, count(*) AS same
FROM v, (VALUES ('alpha'), ('beta'), ('gamma')) AS formats(source_name) GROUP BY source_name"""
    ),
    "stream_ticks": _with(f"SELECT {_VIEW} FROM w WHERE outcome = 'written'", True, _ACCEPTED, _ROUTED),
    "stream_new_checkpoint": _with(f"SELECT {_VIEW} FROM w WHERE outcome = 'written'", True, _ACCEPTED, _ROUTED),
    "stream_outcomes": _with(
        """SELECT source, raw, invalid, oversize, accepted, duplicate, written, conflict AS conflicts, dead_lettered,
       accepted - written - conflict - dead_lettered AS dropped,
       (SELECT count(DISTINCT batch_no) FROM r WHERE r.source = o.source AND failure IS NOT NULL) AS attempt_failures
FROM o""",
        True,
        _ACCEPTED,
        _ROUTED,
        _TOTALS,
    ),
    "stream_dedup": _with("SELECT id, received_us AS anchor_us FROM a", False, _ACCEPTED),
    "stream_heartbeat": _with(
        """SELECT (received_us // 10000000 + 1) * 10000000 AS at, count(*) AS raw, count(error) AS invalid,
       count(*) - count(error) AS valid FROM m WHERE defect <> 'oversize' GROUP BY ALL""",
        True,
    ),
    "stream_oversize": _with(
        """SELECT source AS source_name, seq, received_us, CAST(1024 AS BIGINT) AS head FROM m WHERE defect = 'oversize'""", True
    ),
    "stream_two_checkpoints": _with(
        """SELECT (received_us // 10000000 + 1) * 10000000 AS at, count(*) AS raw, count(error) AS invalid,
       count(*) - count(error) AS valid FROM m WHERE defect <> 'oversize' GROUP BY ALL""",
        True,
    ),
    "stream_windows": _with(
        f"""SELECT source, kind, until AS at, count(*) AS messages FROM (
  SELECT source, until, CASE WHEN until <= passed THEN 'late'
                          WHEN until <= max(received_us) OVER (PARTITION BY source) - {DELAY} THEN 'closed' ELSE 'open' END AS kind
  FROM placed LEFT JOIN marks USING (source, part)
) GROUP BY ALL""",
        True,
        f"""
ends AS (SELECT min(received_us) AS lo, greatest((max(received_us) - min(received_us)) // 4, 1) AS step FROM m),
placed AS (
  SELECT source, received_us, (received_us // 3600000000 + 1) * 3600000000 AS until,
         least((received_us - lo) // step + CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END, 3) AS part
  FROM m, ends
),
marks AS (
  SELECT p.source, n.part, max(p.received_us) - {DELAY} AS passed
  FROM placed p JOIN (VALUES (1), (2), (3)) n(part) ON p.part < n.part GROUP BY ALL
)""",
    ),
    "stream_closed_sessions": _with(
        f"""SELECT source, first_at, last_at, messages,
       CASE WHEN last_at + {IDLE} <= max(last_at) OVER (PARTITION BY source) - {DELAY} THEN 'closed' ELSE 'open' END AS kind
FROM s""",
        False,
        _GAPS,
    ),
    "stream_stalls": _with(
        """SELECT source, connected, count(*) AS messages, NOT connected AS by_timer
FROM m, (VALUES (true), (false)) c(connected) GROUP BY ALL""",
        True,
    ),
    "stream_observed": _with(
        """SELECT source, count(*) FILTER (defect <> 'oversize') AS raw,
       count(*) FILTER (defect <> 'oversize' AND error IS NOT NULL) AS invalid,
       count(*) FILTER (defect = 'oversize') AS oversize, count(*) FILTER (error IS NULL) AS valid FROM m GROUP BY source""",
        True,
    ),
    "stream_sessions": _with(
        f"""SELECT source, first_at, last_at, messages FROM s
WHERE last_at + {IDLE} - 1 <= (SELECT (max(received_us) - 600000000) // 1000 * 1000 FROM m)""",
        False,
        _GAPS,
    ),
    "stream_all_sessions": _with(
        f"""SELECT source, first_at, last_at, messages,
       last_at + {IDLE} - 1 <= (SELECT (max(received_us) - 600000000) // 1000 * 1000 FROM m) AS ended FROM s""",
        False,
        _GAPS,
    ),
    "bulk_identity": "WITH " + _LINES + "\nSELECT id, count(*) AS lines FROM y GROUP BY id",
    "bulk_outcomes": "WITH " + _LINES + """
SELECT source, count(*) AS raw, CAST(0 AS BIGINT) AS invalid, count(*) - count(DISTINCT id) AS duplicate,
       count(DISTINCT id) AS accepted, count(DISTINCT id) AS written, CAST(0 AS BIGINT) AS conflict
FROM y GROUP BY source""",
    "bulk_latest_per_instrument": "WITH " + _LINES + """
SELECT source, symbol, id, CAST(quote AS DOUBLE) AS price, CAST(lots AS DOUBLE) AS volume, event_us FROM y
QUALIFY row_number() OVER (PARTITION BY source, symbol ORDER BY event_us DESC, id DESC) = 1""",
    "bulk_heartbeat": "WITH " + _LINES + """,
g AS (SELECT id, event_us, count(*) AS copies FROM y GROUP BY ALL),
q AS (
  SELECT (event_us + 1000000) // 10000000 AS beat, CAST(sum(copies) AS BIGINT) AS raw, 0 AS invalid,
         count(*) AS accepted
  FROM g GROUP BY ALL
)""" + _HEARTBEAT,
}
