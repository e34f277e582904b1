"""The queries again as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..operators.metrics import PUBLISH_BUCKETS
from .queries import BOUNDS, DAY_MS, HOUR_MS, INDEX_BYTES, SEGMENT_BYTES

H = "('0x' || substr(md5({}), 1, 15))::BIGINT"
KEY = H.format("user_id::VARCHAR")

E = "e AS (SELECT event_id, ts, epoch_us(ts) // 1000 AS ms, user_id, event_type, value, props FROM events)"
R = f"r AS (SELECT *, ({KEY} % 4)::INTEGER AS partition FROM e)"
LOG = 'log AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS "offset", coalesce(strlen(props), 0) AS size FROM r)'
PARTS = "parts AS (SELECT unnest(range(4))::INTEGER AS partition)"
HWM = 'hwm AS (SELECT partition, count("offset")::BIGINT AS records, coalesce(max("offset") + 1, 0)::BIGINT AS next_offset FROM parts LEFT JOIN log USING (partition) GROUP BY partition)'
GRP = "grps AS (SELECT partition, grp, coalesce(floor(next_offset * share), 0)::BIGINT AS committed, next_offset FROM hwm, (VALUES ('fast', 0.9::DOUBLE), ('slow', 0.5::DOUBLE), ('idle', NULL::DOUBLE)) g(grp, share))"
SENT = "sent AS (SELECT user_id AS stream, s AS sequence, s * 20 + floor(value)::BIGINT AS arrival_ms, props AS payload, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s FROM e))"
ARR = "arr AS (SELECT * FROM sent WHERE event_type <> 'error')"
START = "began AS (SELECT a.stream, a.sequence AS base, l.last, a.arrival_ms + 60 - a.sequence * 20 AS base_ms FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY arrival_ms, sequence) AS rn FROM arr) a JOIN (SELECT stream, max(sequence) AS last FROM arr GROUP BY stream) l USING (stream) WHERE rn = 1)"
KEYS = "k AS (SELECT 'key-' || o_orderkey AS k FROM orders)"


def ring(name: str, parts: str, keys: str = "k") -> str:
    """(k, p): each distinct key's ring partition."""
    return f"""{name}_pt AS (SELECT p, {H.format("p || '#vnode#' || v")} AS pt FROM (SELECT unnest({parts})::INTEGER AS p), (SELECT unnest(range(128)) AS v)),
{name} AS (SELECT k, p FROM (SELECT k, coalesce(min(pt) FILTER (pt >= h), min(pt)) AS pt FROM (SELECT DISTINCT k, {H.format("k")} AS h FROM {keys}), {name}_pt GROUP BY k, h) JOIN {name}_pt USING (pt))"""


def with_(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


def slots(on_time: str) -> tuple[str, ...]:
    return (
        E, SENT, ARR, START,
        f"ok AS (SELECT arr.stream, arr.sequence, arr.payload FROM arr JOIN began USING (stream) WHERE arr.sequence >= base AND {on_time})",
        "slot AS (SELECT stream, unnest(range(base, last + 1)) AS sequence FROM began)",
        "played AS (SELECT slot.stream, slot.sequence, CASE WHEN ok.stream IS NOT NULL THEN 'packet' ELSE 'concealed' END AS kind, last_value(ok.payload IGNORE NULLS) OVER (PARTITION BY slot.stream ORDER BY slot.sequence ROWS UNBOUNDED PRECEDING) AS payload FROM slot LEFT JOIN ok USING (stream, sequence))",
    )


ON_TIME = "arr.arrival_ms <= base_ms + arr.sequence * 20"
MOVED = "SELECT count(*) AS n_keys, count(*) FILTER (a.p <> b.p) AS n_moved, round(count(*) FILTER (a.p <> b.p) / count(*), 6) AS fraction FROM a JOIN b USING (k)"
FULL = f"1 + 16 + l.size > {SEGMENT_BYTES}"
SEG = f"""seg AS (SELECT partition, "offset", 0::BIGINT AS base, 0::BIGINT AS position, 16 + size AS used, true AS indexed, 0::BIGINT AS since FROM log WHERE "offset" = 0
UNION ALL SELECT l.partition, l."offset", CASE WHEN full_ THEN l."offset" ELSE s.base END, CASE WHEN full_ THEN 0 ELSE s.used END, CASE WHEN full_ THEN 0 ELSE s.used END + 16 + l.size,
  full_ OR s.since + 16 + l.size >= {INDEX_BYTES}, CASE WHEN full_ OR s.since + 16 + l.size >= {INDEX_BYTES} THEN 0 ELSE s.since + 16 + l.size END
  FROM (SELECT s.*, l.size AS next_size, s.used + 16 + l.size > {SEGMENT_BYTES} AS full_ FROM seg s JOIN log l ON l.partition = s.partition AND l."offset" = s."offset" + 1) s JOIN log l ON l.partition = s.partition AND l."offset" = s."offset" + 1)"""
NUM = "n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e)"


#: Publishes that wait for a commit with room, three a commit, for two hours. told: what each event settles.
WAITING = f"""wait AS (SELECT partition, 0::BIGINT AS rn, 0::BIGINT AS lag, []::STRUCT(id BIGINT, due BIGINT)[] AS queue, []::STRUCT(id BIGINT, ms BIGINT)[] AS told FROM parts
UNION ALL SELECT partition, rn, CASE WHEN commit THEN least(len(alive), 3) WHEN free THEN lag + 1 ELSE lag END,
  CASE WHEN commit THEN alive[4:] WHEN free THEN alive ELSE list_append(alive, {{'id': event_id, 'due': ms + {2 * HOUR_MS}}}) END,
  list_concat(list_transform(gone, lambda x: {{'id': x.id, 'ms': NULL::BIGINT}}), CASE WHEN commit THEN list_transform(alive[1:3], lambda x: {{'id': x.id, 'ms': ms}}) WHEN free THEN [{{'id': event_id, 'ms': ms}}] ELSE [] END)
  FROM (SELECT *, NOT commit AND lag < 3 AND len(alive) = 0 AS free FROM (SELECT wait.partition, n.rn, lag, n.event_id, n.ms, n.commit, list_filter(queue, lambda x: x.due > n.ms) AS alive, list_filter(queue, lambda x: x.due <= n.ms) AS gone
  FROM wait JOIN n ON n.partition = wait.partition AND n.rn = wait.rn + 1)))"""


def histogram(source: str, bounds: tuple = BOUNDS) -> str:
    bounds = ", ".join(f"({float(x)}::DOUBLE)" for x in bounds)
    return with_(E, f"s AS ({source})", f"bounds(bound) AS (VALUES {bounds}, (NULL::DOUBLE))", select="SELECT event_type, bound, count(*) FILTER (bound IS NULL OR value < bound) AS cumulative, count(*) AS count, round(sum(value), 4) AS sum FROM s, bounds GROUP BY event_type, bound")


COMMANDS = """c AS (SELECT event_id AS log_index, ms, CASE WHEN event_id % 97 = 5 THEN NULL ELSE CASE event_type WHEN 'signup' THEN 'register_broker' WHEN 'view' THEN 'heartbeat' WHEN 'purchase' THEN 'create_topic' WHEN 'click' THEN 'increment_counter' ELSE 'noop' END END AS kind,
  't' || (user_id % 20) AS topic, (user_id % 5)::INTEGER AS parts, 'b' || (user_id % 30) AS broker, 'host' || user_id AS address FROM e)"""
SPANS = "sp AS (SELECT conv_id AS trace_id, turn + 1 AS span_id, (turn + 1) // 2 AS parent, turn * 10 AS a, turn * 10 + coalesce(length(text), 0) % 50 AS b FROM conversations)"
REQ = "q AS MATERIALIZED (SELECT *, sequence * 100 AS ms, (floor(value) + 1)::BIGINT AS size FROM sent)"
SESSIONS = f"ses AS (SELECT user_id, min(ms) AS session_start, max(ms) AS session_end, count(*) AS n FROM (SELECT user_id, ms, sum(new) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < {6 * HOUR_MS} THEN 0 ELSE 1 END AS new FROM e)) GROUP BY user_id, s)"


def average(alpha: str, rest: str, x: str, name: str) -> str:
    return with_(E, select=f"SELECT user_id, round(list_reduce(list({x} ORDER BY ts, event_id), lambda a, x: {alpha}::DOUBLE * x + {rest}::DOUBLE * a), 6) AS {name} FROM e GROUP BY user_id")


RUNNING = (E, NUM, "a AS (SELECT user_id, event_id, rn, ms, value AS x FROM n WHERE rn = 1 UNION ALL SELECT n.user_id, n.event_id, n.rn, n.ms, 0.1::DOUBLE * n.value + 0.9::DOUBLE * a.x FROM a JOIN n ON n.user_id = a.user_id AND n.rn = a.rn + 1)")
#: Level after an evaluation, by the level before (0, 1, 2) with the rates 128, 512 and 2048 and the headroom 1.3.
def level(n: str) -> str:
    """n: (user_id, rn, event_id, kbps, loss), the evaluations of each user in order."""
    return f"""lad AS (SELECT user_id, 0 AS rn, 0 AS level, 0 AS good, NULL::BIGINT AS event_id FROM {n} WHERE rn = 1
UNION ALL SELECT user_id, rn + 1, CASE WHEN bad THEN greatest(level - 1, 0) WHEN up THEN level + 1 ELSE level END, CASE WHEN bad OR up THEN 0 ELSE good + 1 END, next_id
FROM (SELECT lad.*, n.event_id AS next_id, n.loss >= 0.05 OR (n.kbps > 0 AND n.kbps < [128, 512, 2048][level + 1] * 1.3::DOUBLE) AS bad,
  good + 1 >= 3 AND level < 2 AND n.kbps >= [128, 512, 2048][least(level + 2, 3)] * 1.3::DOUBLE AS up
  FROM lad JOIN {n} n ON n.user_id = lad.user_id AND n.rn = lad.rn + 1))"""


SAMPLES = "nl AS MATERIALIZED (SELECT *, floor(value * 20) AS kbps, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS loss FROM n)"
BUCKET = """bk AS (SELECT stream, sequence, ms, size <= 100 AS accepted, 100.0::DOUBLE - CASE WHEN size <= 100 THEN size ELSE 0 END AS tokens FROM q WHERE sequence = 0
UNION ALL SELECT stream, sequence, ms, size <= t, t - CASE WHEN size <= t THEN size ELSE 0 END
FROM (SELECT q.stream, q.sequence, q.ms, q.size, least(100.0::DOUBLE, bk.tokens + (q.ms - bk.ms)::DOUBLE / 1000.0::DOUBLE * 200.0::DOUBLE) AS t FROM bk JOIN q ON q.stream = bk.stream AND q.sequence = bk.sequence + 1))"""
QUEUE = "d AS MATERIALIZED (SELECT *, (sequence // 10) * 1000 AS at_ms, CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE 1 END AS priority, [1, 2, 4][((sequence // 10) % 3 + 1)::INTEGER] * 125.0::DOUBLE AS rate FROM q)"
#: At drains of d (stream, sequence, at_ms, priority, size, rate).
DRAIN = (
    "o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY at_ms, priority, sequence) AS rn FROM d)",
    """dr AS (SELECT stream, sequence, priority, rn, at_ms, rate, priority = 0 OR size <= rate * 0.5 AS sent, rate * 0.5 - CASE WHEN priority <> 0 AND size <= rate * 0.5 THEN size ELSE 0 END AS tokens FROM o WHERE rn = 1
UNION ALL SELECT stream, sequence, priority, rn, at_ms, rate, priority = 0 OR size <= t, t - CASE WHEN priority <> 0 AND size <= t THEN size ELSE 0 END
FROM (SELECT o.*, CASE WHEN o.at_ms = dr.at_ms THEN dr.tokens ELSE least(o.rate * 0.5, least(dr.rate * 0.5, dr.tokens + (o.at_ms - dr.at_ms)::DOUBLE / 1000.0::DOUBLE * dr.rate)) END AS t FROM dr JOIN o ON o.stream = dr.stream AND o.rn = dr.rn + 1))""",
)
REPORTS = (
    "dq AS MATERIALIZED (SELECT * REPLACE (size * 400 AS size), (sequence // 10) * 1000 AS at_ms, CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE 1 END AS priority FROM q)",
    "rep AS MATERIALIZED (SELECT stream AS user_id, at_ms AS event_id, row_number() OVER (PARTITION BY stream ORDER BY at_ms) AS rn, max(floor(value) * 20) AS kbps, CASE WHEN count(*) FILTER (event_type = 'error') >= 4 THEN 1.0 ELSE 0.0 END AS loss FROM dq GROUP BY stream, at_ms)",
    level("rep"),
    "d AS MATERIALIZED (SELECT dq.*, [128, 512, 2048][level + 1] AS level_kbps, [128, 512, 2048][level + 1] * 125.0::DOUBLE AS rate FROM dq JOIN lad ON lad.user_id = dq.stream AND lad.event_id = dq.at_ms)",
)
#: The CRC-32 table, and the check sum of a text's bytes.
CRC = "crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i))"
CRC_OF = "xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
#: Segments in order; of each partition's second one the last record is torn.
TORN = """sm AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY base) = 2 AS torn, base < max(base) OVER (PARTITION BY partition) AS sealed
  FROM (SELECT partition, base, count(*) AS n, max("offset") AS final_offset, sum(used - position) AS bytes, arg_max(used - position, "offset") AS final FROM seg GROUP BY partition, base))"""
LAST = "(SELECT event_type, {} AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM e) WHERE rn = 1)"
NL = "chr(10)"

ORACLES: dict[str, str] = {
    "route_round_robin": with_(E, select="SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) % 4)::INTEGER AS partition FROM e"),
    "route_key_modulo": with_(E, R, select="SELECT event_id, user_id, partition FROM r"),
    "route_ring": with_(E, "u AS (SELECT user_id::VARCHAR AS k FROM e)", ring("a", "range(4)", "u"), select="SELECT event_id, p AS partition FROM e JOIN a ON a.k = e.user_id::VARCHAR"),
    "ring_balance": with_(KEYS, ring("a", "range(4)"), select="SELECT p AS partition, count(*) AS n_keys, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM a GROUP BY p"),
    "ring_remap_add": with_(KEYS, ring("a", "range(4)"), ring("b", "range(5)"), select=MOVED),
    "ring_remap_remove": with_(KEYS, ring("a", "range(4)"), ring("b", "[0, 1, 3]"), select=MOVED + " WHERE a.p <> 2"),
    "modulo_remap": with_(KEYS, f"a AS (SELECT k, {H.format('k')} % 4 AS p FROM k)", f"b AS (SELECT k, {H.format('k')} % 5 AS p FROM k)", select=MOVED),
    "assign_offsets": with_(E, R, LOG, select='SELECT event_id, partition, "offset" FROM log'),
    "partition_hwm": with_(E, R, LOG, PARTS, HWM, select="SELECT * FROM hwm"),
    "point_read": with_(E, R, LOG, select='SELECT partition, "offset", event_id, props FROM log WHERE partition = 1 AND "offset" = 5'),
    "range_read": with_(E, R, LOG, select='SELECT partition, "offset", event_id, props FROM log WHERE partition = 2 AND "offset" BETWEEN 10 AND 29'),
    "poll_limit": with_(E, R, LOG, PARTS, HWM, GRP, select="""SELECT partition, "offset", event_id FROM (SELECT log.*, row_number() OVER (ORDER BY log.partition, "offset") AS rn FROM log JOIN grps ON grps.partition = log.partition AND grp = 'slow' WHERE log.partition % 2 = 0 AND "offset" >= committed) WHERE rn <= 100"""),
    "segment_roll": with_(E, R, LOG, SEG, recursive=True, select="""SELECT partition, "offset", base AS segment_base, printf('%020d.seg', base) AS segment_file FROM seg"""),
    "sparse_index": with_(E, R, LOG, SEG, recursive=True, select='SELECT partition, base AS segment_base, "offset", position FROM seg WHERE indexed'),
    "segment_metadata": with_(E, R, LOG, SEG, recursive=True, select="SELECT partition, base AS segment_base, count(*) AS records, sum(used - position)::BIGINT AS bytes, base < max(base) OVER (PARTITION BY partition) AS sealed FROM seg GROUP BY partition, base"),
    "valid_prefix": with_(E, R, LOG, select='SELECT partition, "offset", event_id FROM (SELECT *, max((value > 250)::INTEGER) OVER (PARTITION BY partition ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS bad FROM log) WHERE bad = 0'),
    "segment_files": with_(E, R, LOG, select="""SELECT 'events' AS topic, partition, "offset", size AS len, props AS payload FROM log"""),
    "crc_audit": with_(E, CRC, select=f"SELECT event_id, {CRC_OF.format('props')} AS crc FROM e, crc_table"),
    "segment_read_from": with_(E, R, LOG, CRC, select=f"""SELECT partition, "offset", {CRC_OF.format("coalesce(props, '')")} AS crc FROM log, crc_table WHERE partition = 2 AND "offset" >= 50"""),
    "segment_stream": with_(E, R, LOG, select="""SELECT 'events' AS topic, partition, "offset", size AS len FROM log"""),
    "log_recovery": with_(E, R, LOG, SEG, TORN, recursive=True, select="SELECT 'events' AS topic, partition, base AS segment_base, n - torn::BIGINT AS records, (bytes - CASE WHEN torn THEN final ELSE 0 END)::BIGINT AS bytes, sealed, base + n - torn::BIGINT AS next_offset, torn FROM sm"),
    "poll_to_gap": with_(E, R, LOG, SEG, TORN, recursive=True, select="""SELECT log.partition, log."offset" FROM log LEFT JOIN (SELECT partition, final_offset FROM sm WHERE torn) t USING (partition) WHERE final_offset IS NULL OR log."offset" < final_offset"""),
    "group_assignment": "SELECT grp, consumer_index, partition FROM (VALUES ('fast', 2, 0), ('fast', 2, 1), ('slow', 1, 0), ('wide', 3, 0), ('wide', 3, 1), ('wide', 3, 2)) m(grp, n, consumer_index), (SELECT unnest(range(4))::INTEGER AS partition) WHERE partition % n = consumer_index",
    "group_lag": with_(E, R, LOG, PARTS, HWM, GRP, select="SELECT partition, grp, committed, next_offset, greatest(next_offset - committed, 0) AS lag, next_offset - committed >= 500 AS over_limit FROM grps"),
    "min_committed": with_(E, R, LOG, PARTS, HWM, GRP, select="SELECT partition, next_offset, min(committed) AS min_committed, greatest(next_offset - min(committed), 0) AS lag FROM grps GROUP BY partition, next_offset"),
    "backpressure_flag": with_(E, R, LOG, PARTS, HWM, GRP, select="SELECT partition, next_offset, min(committed) AS min_committed, greatest(next_offset - min(committed), 0) AS lag, next_offset - min(committed) >= 1000 AS blocked FROM grps WHERE grp <> 'idle' GROUP BY partition, next_offset"),
    "admission": with_(E, R, select="SELECT event_id, partition, row_number() OVER (PARTITION BY partition, epoch ORDER BY ts, event_id) <= 5 AS accepted FROM (SELECT *, sum((event_type = 'signup')::INTEGER) OVER (PARTITION BY partition ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM r) WHERE event_type <> 'signup'"),
    "publish_timeout": with_(E, R, PARTS, "n AS MATERIALIZED (SELECT partition, event_id, ms, event_type = 'signup' AS commit, row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) AS rn FROM r)", WAITING, "done AS (SELECT unnest(told) AS t FROM wait)", recursive=True, select="SELECT event_id, partition, t.ms AS published_ms, CASE WHEN t.ms IS NULL THEN 'timeout' ELSE 'published' END AS outcome FROM n LEFT JOIN done ON t.id = event_id WHERE NOT commit"),
    "delivery_audit": with_(E, R, "got AS (SELECT event_id FROM r WHERE partition % 2 = 0 UNION ALL SELECT event_id FROM r WHERE partition % 2 = 1 AND event_id % 50 <> 7 UNION ALL SELECT event_id FROM r WHERE event_id % 100 = 3)", select="SELECT (SELECT count(*) FROM r) AS n_published, (SELECT count(*) FROM got) AS n_received, (SELECT count(*) FROM r WHERE event_id NOT IN (SELECT event_id FROM got)) AS n_missing, (SELECT count(*) FROM (SELECT event_id FROM got GROUP BY event_id HAVING count(*) > 1)) AS n_repeated, (SELECT count(*) FROM got WHERE event_id NOT IN (SELECT event_id FROM r)) AS n_unknown"),
    "playout_drain": with_(*slots("true"), select="SELECT * FROM played"),
    "playout_continuous": with_(*slots(ON_TIME), select="SELECT * FROM played"),
    "gap_report": with_(E, SENT, ARR, select="SELECT stream, sequence + 1 AS gap_start, n - 1 AS gap_end, n - sequence - 1 AS n_missing FROM (SELECT stream, sequence, lead(sequence) OVER (PARTITION BY stream ORDER BY sequence) AS n FROM arr) WHERE n > sequence + 1"),
    "late_report": with_(E, SENT, ARR, START, select=f"SELECT stream, arr.sequence, arr.arrival_ms - base_ms - arr.sequence * 20 AS late_ms FROM arr JOIN began USING (stream) WHERE arr.sequence < base OR NOT {ON_TIME}"),
    "last_wins": with_(E, select="SELECT user_id, event_type, arg_max(props, event_id) AS props FROM e GROUP BY ALL"),
    "conceal_fill": with_(E, select="SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS good_value FROM e"),
    "effective_loss": with_(*slots(ON_TIME), select="SELECT stream, count(*) AS played, count(*) FILTER (kind = 'concealed') AS concealed, round(count(*) FILTER (kind = 'concealed') / count(*), 6) AS loss FROM played GROUP BY stream"),
    "nack_recovery": with_(E, SENT, select="SELECT stream, sequence, sequence > newest - 16 AS recovered FROM (SELECT *, max(sequence) OVER (PARTITION BY stream) AS newest FROM sent) WHERE event_type = 'error'"),
    "sliding_bandwidth": with_(E, select=f"SELECT event_id, round(sum(floor(value * 100)) OVER w * 8.0::DOUBLE / 1000.0::DOUBLE / (greatest(ms - min(ms) OVER w, 1)::DOUBLE / 1000.0::DOUBLE), 6) AS kbps FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {DAY_MS} PRECEDING AND CURRENT ROW)"),
    "ema_loss": average("0.2", "0.8", "(event_type = 'error')::INTEGER::DOUBLE", "loss"),
    "ema_rtt": average("0.1", "0.9", "value", "rtt_ms"),
    "ema_running": with_(*RUNNING, recursive=True, select="SELECT event_id, round(x, 6) AS rtt_ms FROM a"),
    "bitrate_ladder": with_(E, NUM, SAMPLES, level("nl"), recursive=True, select="SELECT event_id, ['low', 'medium', 'high'][level + 1] AS level, [128, 512, 2048][level + 1]::INTEGER AS level_kbps FROM lad WHERE rn > 0"),
    "token_bucket": with_(E, SENT, REQ, BUCKET, recursive=True, select="SELECT stream, sequence, accepted FROM bk"),
    "priority_drain": with_(E, SENT, REQ, QUEUE, *DRAIN, recursive=True, select="SELECT stream, sequence, priority, sent FROM dr"),
    "adaptive_drain": with_(E, SENT, REQ, *REPORTS, *DRAIN, recursive=True, select="SELECT dr.stream, dr.sequence, dr.priority, level_kbps::INTEGER AS level_kbps, sent FROM dr JOIN d USING (stream, sequence)"),
    "metric_counters": "SELECT event_type, count(*) AS value FROM events GROUP BY event_type",
    "gauge_last": with_(E, select=f"SELECT * FROM {LAST.format('value')}"),
    "latency_histogram": histogram("SELECT * FROM e"),
    "sampled_latency": histogram("SELECT * FROM e WHERE event_id % 16 = 0"),
    "publish_latency": histogram("SELECT event_type, floor(value * 30)::BIGINT AS value FROM e", PUBLISH_BUCKETS).replace("round(sum(value), 4) AS sum", "sum(value)::BIGINT AS sum"),
    "prometheus_text": with_(E, f"parts AS (SELECT 0 AS k, event_type, '# TYPE events_total_' || event_type || ' counter' || {NL} || 'events_total_' || event_type || ' ' || count(*) || {NL} AS t FROM e GROUP BY event_type UNION ALL SELECT 1, event_type, '# TYPE last_value_' || event_type || ' gauge' || {NL} || 'last_value_' || event_type || ' ' || value || {NL} FROM {LAST.format('floor(value)::BIGINT')} UNION ALL SELECT 2, event_type, '# TYPE value_' || event_type || ' histogram' || {NL} || " + " || ".join(f"'value_' || event_type || '_bucket{{le=\"{x}\"}} ' || count(*) FILTER (floor(value) < {x}) || {NL}" for x in BOUNDS) + f" || 'value_' || event_type || '_bucket{{le=\"+Inf\"}} ' || count(*) || {NL} || 'value_' || event_type || '_sum ' || sum(floor(value))::BIGINT || {NL} || 'value_' || event_type || '_count ' || count(*) || {NL} FROM e GROUP BY event_type)", select="SELECT string_agg(t, '' ORDER BY k, event_type) AS text FROM parts"),
    "raft_stats": "SELECT 'n' || (user_id % 3) AS node, event_type AS key, event_id AS value FROM events WHERE event_id % 2 = 0 AND event_type IN ('click', 'view')",
    "exact_percentiles": "SELECT event_type, p::INTEGER AS percent, list_sort(list(value))[least(count(*) * p // 100, count(*) - 1) + 1] AS value FROM events, (VALUES (50), (90), (99), (100)) q(p) WHERE value IS NOT NULL GROUP BY event_type, p",
    "throughput": with_(E, select="SELECT event_type, count(*) AS n, max(ms) - min(ms) AS span_ms, round(count(*) / (nullif(max(ms) - min(ms), 0)::DOUBLE / 1000.0::DOUBLE), 6) AS per_second FROM e GROUP BY event_type"),
    "span_tree": with_(SPANS, "t AS (SELECT trace_id, span_id, 0 AS depth, a, b FROM sp WHERE parent = 0 UNION ALL SELECT sp.trace_id, sp.span_id, t.depth + 1, sp.a, sp.b FROM t JOIN sp ON sp.trace_id = t.trace_id AND sp.parent = t.span_id)", recursive=True, select="SELECT trace_id, span_id, depth, greatest(b - a, 0) AS duration_ms FROM t"),
    "span_children": with_(SPANS, select="SELECT s.trace_id, s.span_id, count(c.span_id) AS n_children, coalesce(sum(c.b - c.a), 0)::BIGINT AS child_ms FROM sp s LEFT JOIN sp c ON c.trace_id = s.trace_id AND c.parent = s.span_id GROUP BY s.trace_id, s.span_id"),
    "conversation_gaps": "SELECT stream, sequence + 1 AS gap_start, n - 1 AS gap_end, n - sequence - 1 AS n_missing FROM (SELECT conv_id AS stream, turn AS sequence, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn % 3 <> 1) WHERE n > sequence + 1",
    "liveness": with_(E, select=f"SELECT user_id, max(ms) AS last_ms, (SELECT max(ms) FROM e) - max(ms) < {DAY_MS} AS alive FROM e GROUP BY user_id"),
    "sessions": with_(E, SESSIONS, select="SELECT * FROM ses"),
    "command_replay": with_(E, COMMANDS, select="""SELECT log_index, kind, CASE WHEN kind = 'increment_counter' THEN row_number() OVER (PARTITION BY kind ORDER BY log_index) ELSE 0 END AS value,
CASE WHEN kind IS NULL THEN 'malformed command' WHEN kind = 'create_topic' AND parts <= 0 THEN 'invalid partition count: ' || topic
WHEN kind = 'create_topic' AND log_index > min(CASE WHEN parts > 0 THEN log_index END) OVER (PARTITION BY kind, topic) THEN 'topic already exists: ' || topic
WHEN kind = 'heartbeat' AND coalesce(max((kind = 'register_broker')::INTEGER) OVER (PARTITION BY CASE WHEN kind IS NULL THEN NULL ELSE broker END ORDER BY log_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 'heartbeat on unregistered broker: ' || broker
WHEN kind = 'noop' THEN 'unknown command kind: noop' END AS error FROM c"""),
    "topic_registry": with_(E, COMMANDS, select="SELECT topic AS name, arg_min(parts, log_index) AS num_partitions FROM c WHERE kind = 'create_topic' AND parts > 0 GROUP BY topic"),
    "topic_lookup": with_(E, COMMANDS, "reg AS (SELECT topic AS name, arg_min(parts, log_index) AS num_partitions FROM c WHERE kind = 'create_topic' AND parts > 0 GROUP BY topic)", "asked AS (SELECT 't' || CASE WHEN i % 3 = 2 THEN i + 1000 ELSE i END AS name FROM (SELECT unnest(range(30)) AS i))", select="SELECT name, num_partitions, CASE WHEN num_partitions IS NULL THEN 'unknown topic: ' || name END AS error FROM asked LEFT JOIN reg USING (name)"),
    "broker_registry": with_(E, COMMANDS, "f AS (SELECT broker, min(log_index) AS first, arg_max(address, log_index) AS address FROM c WHERE kind = 'register_broker' GROUP BY broker)", select=f"SELECT broker AS broker_id, f.address, max(ms) AS last_ms, (SELECT max(ms) FROM e) - max(ms) < {DAY_MS} AS alive FROM c JOIN f USING (broker) WHERE kind IN ('register_broker', 'heartbeat') AND log_index >= first GROUP BY broker, f.address"),
    "replication_lag": with_(E, R, LOG, PARTS, HWM, select="SELECT 'n' || partition AS node, greatest((SELECT next_offset FROM hwm WHERE partition = 0) - floor(next_offset * 0.9::DOUBLE)::BIGINT, 0) AS lag FROM hwm"),
    "counter_linearizability": "SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct, min(event_id + 1) AS least, max(event_id + 1) AS most, count(*) = count(DISTINCT event_id) AND min(event_id + 1) = 1 AND max(event_id + 1) = count(*) AS linearizable FROM events",
    "frame_roundtrip": with_(E, SENT, select="SELECT stream, sequence AS frame, payload, NULL::VARCHAR AS error FROM sent"),
    "packet_decode": with_(E, SENT, "k AS (SELECT *, CASE WHEN sequence % 7 = 6 THEN 'malformed' WHEN sequence % 11 = 10 THEN 'retransmit' ELSE 'media' END AS kind FROM sent)", select="SELECT stream, sequence AS sent, kind, CASE WHEN kind <> 'malformed' THEN sequence ELSE -1 END AS sequence, CASE WHEN kind = 'media' THEN sequence * 20 ELSE -1 END AS timestamp_ms, CASE WHEN kind = 'media' THEN (sequence % 2)::INTEGER ELSE -1 END AS flags, CASE WHEN kind = 'media' THEN payload END AS payload FROM k"),
    "silence_flag": "SELECT event_id, floor(floor(value) * 36 / 8) < 200 AS silent FROM events",
    "config_values": "SELECT * FROM (VALUES ('port', '12abc', 12, false, 12.0::DOUBLE), ('name', 'broker-1', -1, false, 0.0), ('enabled', 'true', -1, true, 0.0), ('rate', '2.5x', 2, false, 2.5), ('a', 'b=c', -1, false, 0.0)) v(key, value, as_int, as_bool, as_double)",
    "log_level_filter": "SELECT event_id, ['trace', 'debug', 'info', 'warn', 'error', 'fatal'][user_id % 6 + 1] AS level FROM events WHERE user_id % 6 >= 3",
    "prepare_frames": with_(E, SENT, select="SELECT stream, sequence, sequence * 20 AS timestamp_ms, (floor(value) * 2 < 200)::INTEGER AS flags, 28::BIGINT AS n_bytes FROM sent"),
    "registry_snapshot": with_(E, COMMANDS, select="SELECT 'topic' AS kind, topic AS name, arg_min(parts, log_index)::VARCHAR AS value FROM c WHERE kind = 'create_topic' AND parts > 0 GROUP BY topic UNION ALL SELECT 'broker', broker, arg_max(address, log_index) FROM c WHERE kind = 'register_broker' GROUP BY broker UNION ALL SELECT 'counter', 'counter', count(*)::VARCHAR FROM c WHERE kind = 'increment_counter'"),
    "stream_tumbling_counts": with_(E, select=f"SELECT w AS window_start_ms, event_type, count(*) AS n FROM (SELECT ms // {HOUR_MS} * {HOUR_MS} AS w, event_type FROM e) WHERE w + {HOUR_MS} <= (SELECT max(ms) FROM e) - 600000 GROUP BY w, event_type"),
    "stream_sessions": with_(E, SESSIONS, select=f"SELECT user_id, session_start, session_end, n FROM (SELECT *, lead(session_start) OVER (PARTITION BY user_id ORDER BY session_start) AS after FROM ses) WHERE after IS NOT NULL OR session_end + {6 * HOUR_MS} <= (SELECT max(ms) FROM e)"),
    "stream_dedup": "SELECT event_id, user_id FROM events",
    "stream_bandwidth": with_(E, select=f"SELECT user_id, ms, round(sum(floor(value * 100)) OVER w * 8.0::DOUBLE / 1000.0::DOUBLE / (greatest(ms - min(ms) OVER w, 1)::DOUBLE / 1000.0::DOUBLE), 6) AS kbps FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {DAY_MS} PRECEDING AND CURRENT ROW)"),
    "stream_playout": with_(*slots(ON_TIME), "ends AS (SELECT stream, max(arrival_ms) AS newest FROM arr GROUP BY stream)", select="SELECT stream, sequence, kind, payload FROM played JOIN began USING (stream) JOIN ends USING (stream) WHERE base_ms + sequence * 20 < newest OR base_ms + last * 20 < (SELECT max(newest) FROM ends)"),
    "stream_ema": with_(*RUNNING, recursive=True, select="SELECT user_id, ms, round(x, 6) AS rtt_ms FROM a"),
}
