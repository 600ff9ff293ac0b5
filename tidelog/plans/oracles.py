"""Independent SQL for every query that SQL can express, over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length({k}) + 1), lambda i: ascii(substr({k}, i, 1))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
EV = """ev AS (
  SELECT 'user:' || user_id AS key, event_id + 1 AS sequence, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS opcode, CASE WHEN event_type <> 'error' THEN props END AS value,
    epoch_us(ts) * 1000 AS commit_ns, CASE event_type WHEN 'view' THEN epoch_us(ts) * 1000 + 3600000000000 WHEN 'click' THEN epoch_us(ts) * 1000 + 86400000000000 ELSE 0 END AS expire_at_ns, user_id
  FROM events)"""
NOW = "(SELECT max(commit_ns) FROM ev)"
IDX = "idx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS rn FROM ev) WHERE rn = 1)"
DEAD = f"(expire_at_ns <> 0 AND expire_at_ns <= {NOW})"
SH = f"""hk AS MATERIALIZED (SELECT key, {FNV.format(k="key")} AS h FROM (SELECT DISTINCT key FROM ev)),
sh AS MATERIALIZED (SELECT ev.*, (h % 8)::INT AS shard FROM ev JOIN hk USING (key))"""
SIZE = "((56 + strlen(key) + coalesce(strlen(value), 0) + 7) // 8) * 8"


def packed(source: str, prefix: str) -> str:
    """Next-fit packing of (shard, sequence, size) as CTEs named by a prefix."""
    return f"""{prefix}n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY sequence) AS rn FROM {source}),
{prefix}r(shard, rn, seg, used) AS (
  SELECT shard, rn, 0::BIGINT, size::BIGINT FROM {prefix}n WHERE rn = 1
  UNION ALL
  SELECT n.shard, n.rn, CASE WHEN r.used + n.size > 12288 THEN r.seg + 1 ELSE r.seg END, CASE WHEN r.used + n.size > 12288 THEN n.size ELSE r.used + n.size END
  FROM {prefix}r r JOIN {prefix}n n ON n.shard = r.shard AND n.rn = r.rn + 1)"""


PK = f"""{SH},
sz AS MATERIALIZED (SELECT *, {SIZE} AS size FROM sh),
{packed("sz", "a")},
pk AS MATERIALIZED (
  SELECT n.* EXCLUDE (rn), r.seg AS segment_no, 4096 + r.used - n.size AS "offset", n.shard * 1000000 + r.seg + 1 AS segment_id, 1 AS generation,
    CASE WHEN r.seg = max(r.seg) OVER (PARTITION BY n.shard) THEN 'active' ELSE 'sealed' END AS role
  FROM an n JOIN ar r ON n.shard = r.shard AND n.rn = r.rn),
ref AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS v FROM pk) WHERE v = 1 AND opcode = 1)"""
ST = """st AS MATERIALIZED (
  SELECT pk.shard, pk.segment_id, pk.role, (4096 + sum(pk.size))::BIGINT AS used_bytes, coalesce(sum(pk.size) FILTER (WHERE ref.key IS NOT NULL), 0)::BIGINT AS live_bytes, count(*) AS record_count,
    count(ref.key) AS live_records, min(pk.sequence) AS first_sequence, max(pk.sequence) AS last_sequence
  FROM pk LEFT JOIN ref ON ref.segment_id = pk.segment_id AND ref."offset" = pk."offset" GROUP BY ALL)"""
SL = f"""{ST},
sl AS MATERIALIZED (
  SELECT segment_id, CASE WHEN segment_id % 3 = 0 AND record_count > 1 THEN lo ELSE lo + ls END AS committed_end,
    record_count - (segment_id % 3 = 0 AND record_count > 1)::INT + (segment_id % 5 = 0)::INT AS slot_count, first_sequence AS slot_first, last_sequence AS slot_last
  FROM st JOIN (SELECT segment_id, max("offset") AS lo, arg_max(size, "offset") AS ls FROM pk GROUP BY segment_id) USING (segment_id)),
cs AS MATERIALIZED (
  SELECT segment_id, count(*) AS scanned, min(sequence) AS first_seen, max(sequence) AS last_seen, any_value(committed_end) AS committed_end,
    count(*) = any_value(slot_count) AND min(sequence) = any_value(slot_first) AND max(sequence) = any_value(slot_last) AND max("offset" + size) = any_value(committed_end) AND bool_and(coalesce(b < sequence, true)) AS matches
  FROM (SELECT pk.*, sl.* EXCLUDE (segment_id), lag(sequence) OVER (PARTITION BY pk.segment_id ORDER BY "offset") AS b FROM pk JOIN sl USING (segment_id) WHERE "offset" < committed_end) GROUP BY segment_id)"""
CB = f"""kp AS MATERIALIZED (SELECT shard, key, sequence, size, segment_id, "offset" FROM ref WHERE role = 'sealed' AND NOT {DEAD}),
{packed("kp", "b")},
ob AS MATERIALIZED (SELECT n.shard, n.key, n.sequence, r.seg AS output_no, 4096 + r.used - n.size AS "offset", n.size FROM bn n JOIN br r ON n.shard = r.shard AND n.rn = r.rn),
ga AS MATERIALIZED (
  SELECT s.shard, s.sources, coalesce(o.outputs, 0) AS outputs, coalesce(o.bytes, 0) AS bytes FROM (SELECT shard, count(DISTINCT segment_id) AS sources FROM pk WHERE role = 'sealed' GROUP BY shard) s
  LEFT JOIN (SELECT shard, max(output_no) + 1 AS outputs, sum(size)::BIGINT AS bytes FROM ob GROUP BY shard) o USING (shard))"""
HIDE = """hd AS MATERIALIZED (
  SELECT DISTINCT t.segment_id FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS v FROM pk) WHERE v = 1 AND opcode = 2) t
  JOIN pk o ON o.key = t.key AND o.opcode = 1 AND o.segment_id <> t.segment_id)"""


def add(name: str, body: str, *ctes: str) -> None:
    head = f"WITH RECURSIVE {', '.join(ctes)} " if ctes else ""
    ORACLES[name] = head + body


OUT = "key, value, sequence, expire_at_ns"
add("live_snapshot", f"SELECT {OUT} FROM idx WHERE opcode = 1 AND NOT {DEAD}", EV, IDX)
add("live_snapshot_parts", """SELECT key, value, sequence FROM (SELECT 'part:' || l_partkey AS key, l_returnflag AS value, row_number() OVER w AS sequence, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem
  WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey)) WHERE sequence = n""")
add("live_snapshot_orders", "SELECT 'cust:' || o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS value, max(o_orderkey) + 1 AS sequence FROM orders GROUP BY o_custkey")
add("kv_get", f"SELECT {OUT} FROM idx WHERE opcode = 1 AND NOT {DEAD} AND key = 'user:7'", EV, IDX)
add("kv_multi_get", f"""SELECT pos, p.key, CASE WHEN l.sequence IS NULL THEN 'not_found' ELSE 'ok' END AS status, l.value, l.sequence
  FROM (SELECT c_custkey AS pos, 'user:' || (c_custkey * 3 % 2000) AS key FROM customer) p LEFT JOIN (SELECT * FROM idx WHERE opcode = 1 AND NOT {DEAD}) l ON l.key = p.key""", EV, IDX)
add("snapshot_as_of_seq", f"SELECT {OUT} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS rn FROM ev WHERE sequence <= 5000) WHERE rn = 1 AND opcode = 1", EV)
add("live_keys_sorted", "SELECT key, strlen(key)::INT AS key_bytes FROM idx WHERE opcode = 1", EV, IDX)
add("live_entries", 'SELECT key, sequence, segment_id, "offset", size, generation FROM ref', EV, PK)
add("prefix_scan", f"SELECT {OUT} FROM idx WHERE opcode = 1 AND NOT {DEAD} AND starts_with(key, 'user:1')", EV, IDX)
add("expired_keys", f"SELECT key, sequence, expire_at_ns FROM idx WHERE opcode = 1 AND {DEAD}", EV, IDX)
add("tombstoned_keys", "SELECT key, sequence FROM idx WHERE opcode = 2", EV, IDX)
add("rebuild_stats", f"SELECT (SELECT count(*) FROM ev) AS records_scanned, count(*) FILTER (WHERE opcode = 2) AS tombstones, count(*) FILTER (WHERE opcode = 1 AND {DEAD}) AS expired, count(*) FILTER (WHERE opcode = 1 AND NOT {DEAD}) AS visible FROM idx", EV, IDX)
add("overlay_get", f"SELECT {OUT} FROM idx WHERE opcode = 1", EV, IDX)
add("merge_base_delta", "SELECT sequence % 8 AS part, count(*) AS keys, sum(sequence)::BIGINT AS sequence_sum FROM idx WHERE opcode = 1 GROUP BY 1", EV, IDX)
add("version_intervals", "SELECT key, sequence, opcode, (SELECT min(o.sequence) FROM ev o WHERE o.key = e.key AND o.sequence > e.sequence) AS valid_to FROM ev e", EV)
add("erase_outcomes", "SELECT e.key, e.sequence, CASE WHEN p.opcode = 1 THEN 'erased' ELSE 'not_found' END AS status FROM ev e ASOF LEFT JOIN ev p ON p.key = e.key AND e.sequence > p.sequence WHERE e.opcode = 2", EV)
add("asof_reads", """SELECT read_id, r.key, CASE WHEN ok THEN value END AS value, CASE WHEN ok THEN sequence END AS sequence, CASE WHEN ok THEN 'ok' ELSE 'not_found' END AS status FROM (
  SELECT r.read_id, r.key, m.value, m.sequence, coalesce(m.opcode = 1 AND NOT (m.expire_at_ns <> 0 AND m.expire_at_ns <= r.now_ns), false) AS ok
  FROM (SELECT sequence * 10 AS read_id, 'user:' || (user_id * 7 % 1000) AS key, sequence AS at_sequence, commit_ns AS now_ns FROM ev) r ASOF LEFT JOIN ev m ON m.key = r.key AND r.at_sequence >= m.sequence) r""", EV)
add("duplicate_sequences", "SELECT 'part:' || l_partkey AS key, l_linenumber::BIGINT AS sequence, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
add("verify_index", """SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'extra' WHEN b.key IS NULL THEN 'missing' ELSE 'mismatch' END AS problem
  FROM (SELECT key, sequence FROM idx WHERE opcode = 1) a FULL JOIN (SELECT key, CASE WHEN sequence % 7 = 0 THEN sequence - 1 ELSE sequence END AS sequence FROM idx WHERE opcode = 1 AND sequence % 11 <> 0) b ON a.key = b.key
  WHERE a.sequence IS DISTINCT FROM b.sequence""", EV, IDX)
add("hot_cache_hits", """SELECT key, sequence, EXISTS (SELECT 1 FROM ref WHERE ref.key = o.key AND ref.sequence = o.sequence) AS hit
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS w FROM pk WHERE sequence <= 5000) o WHERE w = 1 AND opcode = 1""", EV, PK)
add("put_apply", f"""SELECT key, shard, last + row_number() OVER (PARTITION BY shard ORDER BY s) AS sequence, value FROM (
  SELECT 'cust:' || o_custkey AS key, o_orderstatus AS value, o_orderkey AS s, ({FNV.format(k="'cust:' || o_custkey")} % 8)::INT AS shard FROM orders) JOIN (SELECT shard, max(sequence) AS last FROM sh GROUP BY shard) USING (shard)""", EV, SH)
add("put_batch_status", """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey,
  CASE WHEN o_orderkey % 13 = 0 THEN 'invalid_argument' WHEN 56 + strlen('cust:' || o_custkey) + CASE WHEN o_orderkey % 17 = 0 THEN 1048576 ELSE strlen(o_orderpriority) END > 1048576 THEN 'too_large' ELSE 'ok' END AS status FROM orders""")
add("batch_grouping", "SELECT (sequence - 1) // 100 AS batch, shard, count(*) AS items, min(sequence) AS first, CASE WHEN shard = 3 THEN 'failed' ELSE 'ok' END AS status FROM sh GROUP BY ALL", EV, SH)
add("backup_verify", """SELECT *, source_rows = copy_rows AND source_sum = copy_sum AS equal FROM (
  SELECT count(*) AS source_rows, sum(c)::BIGINT AS source_sum, count(*) FILTER (WHERE sequence % 101 <> 0) AS copy_rows, (sum(c) FILTER (WHERE sequence % 101 <> 0))::BIGINT AS copy_sum
  FROM (SELECT sequence, crc AS c FROM (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(t) + 1), lambda i: ascii(substr(t, i, 1))::BIGINT)),
    lambda h, b: list_reduce([xor(h, b), 0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS raw, xor(raw, 4294967295) AS crc
    FROM (SELECT sequence, key || chr(31) || sequence || chr(31) || expire_at_ns AS t FROM idx WHERE opcode = 1))))""", EV, IDX)
add("reshard", f"SELECT key, (h % 8)::INT AS old_shard, (h % 12)::INT AS new_shard FROM (SELECT key FROM idx WHERE opcode = 1 AND NOT {DEAD}) JOIN hk USING (key)", EV, IDX, SH)
add("reshard_resume", f"SELECT key, (h % 12)::INT AS new_shard FROM (SELECT key FROM idx WHERE opcode = 1 AND NOT {DEAD} AND key > 'user:5') JOIN hk USING (key)", EV, IDX, SH)
add("segment_packing", 'SELECT shard, sequence, segment_no, "offset", size FROM pk', EV, PK)
add("segment_scan", 'SELECT segment_id, "offset", sequence, opcode, key FROM pk', EV, PK)
add("committed_scan_audit", "SELECT segment_id, scanned, first_seen, last_seen, matches FROM cs", EV, PK, SL)
add("positional_read", """SELECT key AS asked_key, segment_id, "offset", CASE WHEN sequence % 7 = 0 THEN 'stale_generation' WHEN sequence % 5 = 0 THEN 'size_mismatch' ELSE 'ok' END AS status FROM ref""", EV, PK)
add("segment_stats", "SELECT * FROM st", EV, PK, ST)
add("segment_inspect", "SELECT segment_id, shard, role, record_count, committed_end, printf('segment-%016x-%08x.seg', segment_id, 1) AS name FROM st JOIN sl USING (segment_id)", EV, PK, SL)
add("segments_retirable", "SELECT shard, segment_id, record_count FROM st WHERE role = 'sealed' AND live_records = 0 AND segment_id NOT IN (SELECT segment_id FROM hd)", EV, PK, ST, HIDE)
add("shard_live_bytes", "SELECT shard, role, sum(size)::BIGINT AS live_bytes, count(*) AS keys FROM ref GROUP BY ALL", EV, PK)
add("dead_bytes_by_shard", """SELECT shard, s AS sealed_bytes, l AS live_bytes, s - l AS dead_bytes, (CASE WHEN s = 0 THEN 10000 ELSE least((s - l) * 10000 // s, 10000) END)::INT AS dead_bp FROM (
  SELECT shard, coalesce(sum(used_bytes - 4096) FILTER (WHERE role = 'sealed'), 0)::BIGINT AS s, coalesce(sum(live_bytes) FILTER (WHERE role = 'sealed'), 0)::BIGINT AS l FROM st GROUP BY shard)""", EV, PK, ST)
add("unread_expired", f"SELECT shard, count(*) AS keys, sum(size)::BIGINT AS bytes FROM ref WHERE role = 'sealed' AND {DEAD} GROUP BY shard", EV, PK)
add("next_sequence", "SELECT shard, max(sequence) + 1 AS next_sequence FROM sh GROUP BY shard", EV, SH)
add("shard_histogram", "SELECT shard, count(*) AS records, count(DISTINCT key) AS keys FROM sh GROUP BY shard", EV, SH)
add("live_bytes_running", """SELECT shard, sequence, (sum(delta) OVER (PARTITION BY shard ORDER BY sequence))::BIGINT AS live_bytes FROM (
  SELECT shard, sequence, a - coalesce(lag(a) OVER (PARTITION BY key ORDER BY sequence), 0) AS delta FROM (SELECT *, CASE WHEN opcode = 1 THEN size ELSE 0 END AS a FROM pk))""", EV, PK)
VC = "vc AS MATERIALIZED (SELECT segment_id, shard, live_bytes, used_bytes FROM st WHERE role = 'sealed' AND live_bytes / used_bytes <= 0.25 ORDER BY live_bytes / used_bytes, segment_id LIMIT 4)"
add("vacuum_candidates", "SELECT * FROM vc", EV, PK, ST, VC)
add("vacuum_result", f"""SELECT segment_id, action, count(*) AS records, sum(size)::BIGINT AS bytes FROM (
  SELECT segment_id, size, CASE WHEN sequence < max_seq THEN 'dropped_superseded' WHEN opcode = 2 THEN CASE WHEN segment_id IN (SELECT segment_id FROM hd) THEN 'kept_tombstone' ELSE 'dropped_tombstone' END WHEN {DEAD} THEN 'dropped_expired' ELSE 'copied' END AS action
  FROM (SELECT *, max(sequence) OVER (PARTITION BY key) AS max_seq FROM pk) WHERE segment_id IN (SELECT segment_id FROM vc)) GROUP BY ALL""", EV, PK, ST, VC, HIDE)
add("compaction_order", 'SELECT shard, key, sequence, row_number() OVER (PARTITION BY shard ORDER BY sequence, segment_id, "offset") AS position FROM kp', EV, PK, CB)
add("compaction_build", 'SELECT shard, key, sequence, output_no, "offset", size FROM ob', EV, PK, CB)
add("compaction_plan", """SELECT shard, segment_id, action, CASE WHEN action = 'replaced' THEN 2 ELSE 1 END AS generation FROM (
  SELECT shard, segment_id, CASE WHEN outputs >= sources THEN 'no_gain' WHEN row_number() OVER (PARTITION BY shard ORDER BY segment_id) <= outputs THEN 'replaced' ELSE 'removed' END AS action
  FROM (SELECT DISTINCT shard, segment_id FROM pk WHERE role = 'sealed') JOIN ga USING (shard))""", EV, PK, CB)
add("compaction_gain", "SELECT shard, sources, outputs, outputs < sources AS gains FROM ga", EV, PK, CB)
add("packing_lower_bound", "SELECT shard, outputs, (bytes + 12287) // 12288 AS least_outputs FROM ga", EV, PK, CB)
add("compaction_estimate", """SELECT shard, outputs * 16384 AS temporary_bytes, (sources - outputs) * 16384 AS reclaimed_bytes, 384 + 32 * (2 * n - sources + outputs) AS intent_bytes,
  n * 16384 + outputs * 16384 + 256 + 32 * (2 * n - sources + outputs) + 384 + 32 * (2 * n - sources + outputs) AS peak_bytes,
  CASE WHEN outputs = 0 THEN 'ok' WHEN sources = outputs THEN 'no_reclaim' WHEN outputs > 4 * (sources - outputs) THEN 'amplification' ELSE 'ok' END AS verdict FROM ga, (SELECT count(DISTINCT segment_id) AS n FROM pk)""", EV, PK, CB)
add("compaction_stats", """SELECT v AS verified, c AS copied, a - c AS dropped_expired, v - a AS dropped_superseded, o AS old_segments, n AS new_segments FROM
  (SELECT count(*) AS v FROM pk WHERE role = 'sealed'), (SELECT count(*) AS a FROM ref WHERE role = 'sealed'), (SELECT count(*) AS c FROM kp), (SELECT sum(sources)::BIGINT AS o, sum(outputs)::BIGINT AS n FROM ga)""", EV, PK, CB)
add("next_compaction_shard", "SELECT arg_min(shard, (shard + 3) % 8) AS shard FROM (SELECT DISTINCT shard FROM pk WHERE role = 'sealed' AND shard NOT IN (5, 6))", EV, PK)
add("compaction_transition", """SELECT DISTINCT segment_id, 'changed' AS problem FROM pk WHERE (shard = 4 AND role = 'active') OR (role = 'sealed' AND segment_id = (SELECT min(segment_id) + 1 FROM pk WHERE shard = 2 AND role = 'sealed'))""", EV, PK)
add("entry_catalog_join", "SELECT key, segment_id, sequence FROM ref WHERE segment_id % 4 = 0", EV, PK)
add("sequence_monotonic", """SELECT segment_id, "offset", sequence, before FROM (SELECT segment_id, "offset", s AS sequence, lag(s) OVER (PARTITION BY segment_id ORDER BY "offset") AS before
  FROM (SELECT *, CASE WHEN sequence % 50 = 0 THEN sequence - 40 ELSE sequence END AS s FROM pk)) WHERE before >= sequence""", EV, PK)
add("segment_overlap", """SELECT a.shard, a.segment_id, a.first_sequence, max(b.last_sequence + CASE WHEN b.segment_id % 4 = 1 THEN 100 ELSE 0 END) AS reached FROM st a JOIN st b ON a.shard = b.shard AND b.segment_id < a.segment_id
  GROUP BY ALL HAVING reached >= a.first_sequence""", EV, PK, ST)
add("wrong_owner", "SELECT key, sequence, (shard + 1) % 8 AS shard, shard AS owner FROM sh WHERE sequence % 97 = 0", EV, SH)
add("hash_mismatch", "SELECT key, sequence, reverse(x) AS key_hash, x AS actual FROM (SELECT ev.key, sequence, printf('%016x', h::UBIGINT) AS x FROM ev JOIN hk USING (key)) WHERE sequence % 89 = 0 AND x <> reverse(x)", EV, SH)
add("record_validity", """SELECT i AS record_id, CASE WHEN i % 31 = 0 THEN 'bad_magic' WHEN i % 29 = 0 THEN 'bad_opcode' WHEN i % 5 = 0 THEN 'bad_type' WHEN o = 2 AND v <> 0 THEN 'erase_with_value' WHEN z > 1048576 THEN 'too_large'
  WHEN i % 19 = 0 THEN 'misaligned' WHEN z <> need THEN 'bad_size' ELSE 'ok' END AS verdict FROM (
  SELECT *, (56 + k + v + 7) // 8 * 8 AS need, CASE WHEN i % 23 = 0 THEN need + 8 WHEN i % 41 = 0 THEN 1048584 ELSE need END AS z FROM (
  SELECT o_orderkey AS i, o_orderkey % 40 + 1 AS k, CASE WHEN o_orderkey % 4 = 1 THEN 0 ELSE o_orderkey * 7 % 300 END AS v, CASE WHEN o_orderkey % 4 = 1 OR o_orderkey % 37 = 0 THEN 2 ELSE 1 END AS o FROM orders))""")
SP = """sp AS MATERIALIZED (
  SELECT *, CASE WHEN blank THEN 'empty' WHEN good AND gen > 0 AND fin <= 67108864 AND fin % 8 = 0 AND ((n = 0 AND fin = 4096) OR (n > 0 AND fin > 4096)) THEN 'valid' ELSE 'invalid' END AS validity,
    CASE WHEN n > 0 THEN s + n ELSE 0 END AS last_sequence FROM (
  SELECT *, CASE WHEN blank THEN 0 WHEN s % 17 = 0 THEN 4100 ELSE 4096 + n * 96 END AS fin FROM (
  SELECT s, x, s % 11 = 0 AND x = 1 AS blank, CASE WHEN s % 11 = 0 AND x = 1 THEN 0 WHEN s % 13 = 0 THEN 7 ELSE s * 3 % 50 + x + 1 END AS gen, CASE WHEN s % 11 = 0 AND x = 1 THEN 0 ELSE s % 9 + x END AS n, (s + x) % 19 <> 0 AS good
  FROM (SELECT o_orderkey AS s, unnest([0, 1]) AS x FROM orders))))"""
add("commit_slot_validity", "SELECT s AS segment_id, x AS slot_index, validity FROM sp", SP)
add("commit_slot_newest", """SELECT segment_id, g AS commit_generation, CASE WHEN k > 1 THEN 'conflict' ELSE 'ok' END AS status, CASE WHEN k = 1 THEN e END AS committed_end, CASE WHEN k = 1 THEN n END AS record_count, CASE WHEN k = 1 THEN l END AS last_sequence FROM (
  SELECT s AS segment_id, any_value(gen) AS g, count(DISTINCT (fin, n, last_sequence)) AS k, min(fin) AS e, min(n) AS n, min(last_sequence) AS l FROM (SELECT *, max(gen) OVER (PARTITION BY s) AS top FROM sp WHERE validity = 'valid') WHERE gen = top GROUP BY s)""", SP)
add("manifest_newest", """SELECT store, g AS manifest_generation, CASE WHEN k > 1 THEN 'conflict' ELSE 'ok' END AS status, CASE WHEN k = 1 THEN w END AS worker_count FROM (
  SELECT store, any_value(gen) AS g, count(DISTINCT wc) AS k, min(wc) AS w FROM (SELECT *, max(gen) OVER (PARTITION BY store) AS top FROM (SELECT o_custkey % 50 AS store, o_orderkey % 400 AS gen, CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE 4 END AS wc FROM orders)) WHERE gen = top GROUP BY store)""")
add("manifest_invariants", """SELECT 'ids_not_increasing' AS problem, segment_id AS subject FROM (SELECT segment_id, lag(segment_id) OVER (ORDER BY position) AS b FROM mi) WHERE b >= segment_id
  UNION ALL SELECT 'owner_out_of_range', segment_id FROM mi WHERE owner NOT BETWEEN 0 AND 7
  UNION ALL SELECT 'active_count', w FROM range(8) t(w) WHERE (SELECT count(*) FROM mi WHERE mi.owner = w AND role = 'active') <> 1""", EV, PK,
    """mi AS MATERIALIZED (SELECT segment_id, position, owner, CASE WHEN owner = 1 THEN 'sealed' ELSE role END AS role FROM (
  SELECT DISTINCT segment_id, role, CASE WHEN segment_id % 7 = 3 THEN segment_id - 2.5 ELSE segment_id END AS position, CASE WHEN segment_id % 9 = 4 THEN 99 ELSE shard END AS owner FROM pk))""")
DIR = """dr AS MATERIALIZED (SELECT *, printf('segment-%016x-%08x', i, i % 3) AS hx, CASE WHEN i % 23 = 0 THEN '.' || hx || '.seg.tmp' WHEN i % 29 = 0 THEN 'notes-' || i || '.txt' WHEN i % 31 = 0 THEN 'segment-' || i WHEN i = 5 THEN 'manifest'
  WHEN i = 7 THEN '.manifest.tmp' WHEN i = 8 THEN '.compaction.intent' WHEN i = 10 THEN '.compaction.tmp' ELSE hx || '.seg' END AS name FROM (SELECT p_partkey AS i FROM part)),
en AS MATERIALIZED (SELECT *, i % 41 <> 0 AS private FROM dr WHERE i % 37 <> 0),
ca AS MATERIALIZED (SELECT hx || '.seg' AS name FROM dr WHERE i % 43 <> 0 AND i % 3 <> 0),
na AS MATERIALIZED (
  SELECT * FROM (SELECT name, CASE WHEN NOT private THEN 'unsafe_entry' WHEN i % 23 = 0 THEN CASE WHEN i % 3 = 0 THEN 'malformed_engine_name' ELSE 'stale_segment_temporary' END WHEN i % 29 = 0 THEN 'unknown_entry' WHEN i % 31 = 0 THEN 'malformed_engine_name'
    WHEN i = 5 THEN NULL WHEN i = 7 THEN 'stale_manifest_temporary' WHEN i = 8 THEN 'compaction_intent' WHEN i = 10 THEN 'stale_compaction_temporary' WHEN i % 3 = 0 THEN 'malformed_engine_name' WHEN name NOT IN (SELECT name FROM ca) THEN 'unlisted_segment' END AS kind FROM en) WHERE kind IS NOT NULL
  UNION ALL SELECT name, 'missing_catalog_segment' FROM ca WHERE name NOT IN (SELECT name FROM en)
  UNION ALL SELECT '.store.lock', 'missing_required_entry')"""
add("namespace_audit", "SELECT * FROM na", DIR)
add("namespace_issue_counts", "SELECT kind, count(*) AS issues, kind NOT LIKE 'stale%' AS blocks_recovery FROM na GROUP BY kind", DIR)
add("repair_split", "SELECT coalesce(e.name, na.name) AS name, CASE WHEN kind IS NULL THEN 'copied' WHEN kind LIKE 'missing%' OR kind = 'unsafe_entry' THEN 'blocks' ELSE 'quarantined' END AS action FROM en e FULL JOIN na ON e.name = na.name", DIR)
add("verify_report", "SELECT count(*) AS segments, sum(scanned)::BIGINT AS records, count(*) FILTER (WHERE NOT matches) AS mismatches, count(*) FILTER (WHERE committed_end + 128 > 16384) AS rotations_required FROM cs", EV, PK, SL)
add("recovery_replay", f"""SELECT {OUT} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS w FROM pk JOIN sl USING (segment_id) WHERE "offset" < committed_end) WHERE w = 1 AND opcode = 1 AND NOT {DEAD}""", EV, PK, SL)
add("hash_fnv1a", f"SELECT key, printf('%016x', ({FNV.format(k='key')})::UBIGINT) AS fnv1a FROM (SELECT 'part:' || p_partkey AS key FROM part)")
add("shard_route", "SELECT key, (h % 4)::INT AS of4, (h % 8)::INT AS of8, (h % 13)::INT AS of13 FROM hk", EV, SH)
add("crc32c_values", """SELECT sequence, printf('%08x', c) AS checksum FROM ev JOIN (SELECT value, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(value) + 1), lambda i: ascii(substr(value, i, 1))::BIGINT)),
    lambda h, b: list_reduce([xor(h, b), 0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 2197175160) ELSE x // 2 END)), 4294967295) AS c FROM (SELECT DISTINCT value FROM ev WHERE value IS NOT NULL)) USING (value)""", EV)
add("encoded_sizes", f"SELECT sequence, {SIZE} AS size FROM ev", EV)
add("basis_points", "SELECT i, (CASE WHEN d = 0 THEN 0 ELSE least(n * 10000 // d, 10000) END)::INT AS bp FROM (SELECT o_orderkey AS i, o_orderkey * 7919 % 5000 AS n, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey * 104729 % 4000 END AS d FROM orders)")
add("key_hex", "SELECT DISTINCT key, lower(hex(key)) AS hex, key AS back FROM ev", EV)
add("segment_filename", "SELECT p_partkey AS segment_id, printf('segment-%016x-%08x.seg', p_partkey * 1000003, p_partkey % 70000 + 1) AS name, p_partkey * 1000003 AS parsed_id FROM part")
OB = """ob_ AS (SELECT o_orderkey AS i, o_orderkey % 5 <> 0 AS durable, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 100 END AS m, o_orderkey * 13 % 110 AS n, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * 7919 % 300000000 END AS free,
  o_orderkey % 4 * 10000000 AS res, CASE WHEN o_orderkey % 2 = 0 THEN 67108864 ELSE 50000000 END AS rot, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey * 31 % 10001 END AS dbp, o_orderkey * 17 % 5000 + o_orderkey * 3 % 2000 AS dead,
  CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey * 19 % 9000 END AS sealed, o_orderkey % 6 AS nseal, o_orderkey * 23 % 9000 AS live, o_orderkey % 9 = 0 AS guard, o_orderkey % 10 AS gain, o_orderkey * 29 % 8000 AS used, o_orderkey * 37 % 30000000 AS cpu, o_orderkey % 27 = 0 AS debt FROM orders),
mp AS (SELECT *, CASE WHEN NOT durable THEN 'normal' WHEN (m > 0 AND n >= m) OR coalesce(free < res + rot, false) THEN 'emergency' WHEN (m > 0 AND n >= 80) OR coalesce(free <= res + 5000000, false) THEN 'pressure' ELSE 'normal' END AS p,
  CASE WHEN dbp IS NULL OR sealed = 0 THEN dbp ELSE least(dead, sealed) * 10000 // sealed END AS bp FROM ob_)"""
add("maintenance_pressure", "SELECT i AS case_id, p AS pressure FROM mp", OB)
add("scheduling_ratio", "SELECT i AS case_id, bp::INT AS bp FROM mp", OB)
add("maintenance_decision", """SELECT i AS case_id, p AS pressure, CASE WHEN skip IS NULL THEN 'run' ELSE 'skip' END AS decision, coalesce(skip, CASE WHEN p = 'emergency' THEN 'emergency_capacity'
    WHEN p = 'pressure' THEN CASE WHEN coalesce(free <= res + 5000000, false) THEN 'free_space_pressure' ELSE 'segment_pressure' END WHEN debt THEN 'latency_debt_override' WHEN durable AND nseal > 0 THEN 'sealed_history' ELSE 'scheduled' END) AS reason FROM (
  SELECT *, CASE WHEN durable AND nseal = 0 THEN 'no_candidate' WHEN p <> 'normal' THEN NULL WHEN durable AND bp < 5000 THEN 'reclaim_threshold' WHEN guard AND NOT debt THEN 'latency_budget' WHEN gain >= 8 THEN 'budget_backoff'
    WHEN durable AND live > 6000 THEN 'copy_budget' WHEN cpu >= 25000000 THEN 'rate_budget' WHEN used >= 7000 OR (durable AND live > least(6000, 7000 - used)) THEN 'rate_budget' END AS skip FROM mp)""", OB)
add("eval_interval", "SELECT i AS case_id, CASE WHEN p <> 'normal' THEN 1000 WHEN gain >= 8 THEN 60000 ELSE 30500 END::BIGINT AS interval_ms FROM mp", OB)
add("status_taxonomy", """SELECT s::INT AS wire_status, c AS category, r AS read_retry, o AS mutation_outcome, w AS mutation_retry, p AS pipeline_outcome, u AS unhealthy FROM (VALUES
  (0, 'ok', 'none', 'committed', 'none', 'committed', false), (1, 'invalid_argument', 'never', 'rejected', 'reconcile_first', 'failed', false), (2, 'invalid_argument', 'never', 'rejected', 'reconcile_first', 'failed', false),
  (3, 'internal', 'new_attempt', 'indeterminate', 'reconcile_first', 'indeterminate', false), (4, 'not_found', 'new_attempt', 'rejected', 'new_attempt', 'failed', false), (5, 'overloaded', 'never', 'rejected', 'never', 'failed', false),
  (6, 'protocol', 'new_attempt', 'rejected', 'reconcile_first', 'failed', true), (7, 'unavailable', 'never', 'rejected', 'never', 'failed', true), (8, 'permission_denied', 'never', 'rejected', 'never', 'failed', false),
  (9, 'protocol', 'new_attempt', 'indeterminate', 'reconcile_first', 'indeterminate', false), (10, 'protocol', 'new_attempt', 'indeterminate', 'reconcile_first', 'indeterminate', false), (11, 'protocol', 'new_attempt', 'indeterminate', 'reconcile_first', 'indeterminate', false)) t(s, c, r, o, w, p, u)""")
add("completion_decisions", """SELECT i AS case_id, CASE WHEN k = 0 THEN 'known_not_committed' WHEN k = 1 AND pub = 3 THEN 'success' ELSE 'indeterminate' END AS kind,
  CASE WHEN k = 0 THEN false WHEN k = 2 THEN true ELSE e = 1 OR pub <> 3 END AS fail_closed, CASE WHEN k = 0 THEN false WHEN k = 2 THEN true ELSE pub <> 3 END AS drain
  FROM (SELECT o_orderkey AS i, o_orderkey % 3 AS k, o_orderkey // 3 % 2 AS e, o_orderkey // 6 % 5 AS pub FROM orders)""")
add("lifecycle_violations", """SELECT mutation_id, step, before, stage FROM (SELECT *, lag(stage) OVER (PARTITION BY mutation_id ORDER BY step) AS before FROM (
  SELECT l_orderkey AS mutation_id, l_linenumber AS step, ['not_admitted', 'admitted', 'staged', 'expired_pre_store', 'durable_started', 'authority_committed', 'publication_required', 'published', 'indeterminate', 'rejected', 'completion_decided', 'completed'][least(l_linenumber + (min(l_partkey) % 6 = 0)::INT, 12)] AS stage
  FROM lineitem GROUP BY l_orderkey, l_linenumber)) WHERE before <> stage AND (before, stage) NOT IN (VALUES ('not_admitted', 'admitted'), ('admitted', 'staged'), ('admitted', 'rejected'), ('admitted', 'expired_pre_store'), ('staged', 'durable_started'), ('staged', 'expired_pre_store'), ('staged', 'rejected'),
  ('expired_pre_store', 'completion_decided'), ('expired_pre_store', 'rejected'), ('expired_pre_store', 'completed'), ('durable_started', 'authority_committed'), ('durable_started', 'rejected'), ('durable_started', 'indeterminate'), ('durable_started', 'publication_required'),
  ('authority_committed', 'publication_required'), ('publication_required', 'published'), ('publication_required', 'indeterminate'), ('published', 'completion_decided'), ('indeterminate', 'completion_decided'), ('indeterminate', 'publication_required'), ('rejected', 'completion_decided'), ('rejected', 'completed'), ('completion_decided', 'completed'))""")
add("health_ready", "SELECT i AS case_id, i % 11 <> 0 AND i % 7 <> 0 AS live, i % 11 <> 0 AND i % 7 <> 0 AND i % 5 <> 0 AND i % 13 <> 0 AND i % 6 <> 0 AND NOT (i % 4 = 0 AND i % 8 = 0) AS ready FROM (SELECT o_orderkey AS i FROM orders)")
add("session_status", "SELECT sequence AS request_id, CASE WHEN sequence % 10 = 0 THEN 'not_bound' WHEN sequence % 7 = 0 AND shard <> 0 THEN 'wrong_owner' ELSE 'ok' END AS status, shard AS owner FROM sh", EV, SH)
RQ = """rq AS MATERIALIZED (SELECT sequence AS id, CASE WHEN sequence % 3 = 0 THEN 'get' WHEN sequence % 50 = 1 THEN 'stats' WHEN sequence % 50 = 2 THEN 'bind_worker' WHEN sequence % 50 = 4 THEN 'backup' WHEN opcode = 2 THEN 'erase' ELSE 'put' END AS op, key, value, expire_at_ns, 'p' || (user_id % 5) AS principal FROM ev),
au AS MATERIALIZED (SELECT *, CASE WHEN op = 'bind_worker' OR principal = 'p0' THEN 'allowed' WHEN principal = 'p4' OR op = 'backup' THEN 'capability_denied' WHEN principal = 'p1' THEN 'allowed' WHEN op IN ('put', 'erase') THEN 'capability_denied'
  WHEN principal = 'p2' THEN 'allowed' WHEN op = 'stats' THEN 'capability_denied' WHEN op = 'get' AND key NOT LIKE 'user:1%' THEN 'prefix_denied' ELSE 'allowed' END AS decision FROM rq)"""
add("authz_decisions", "SELECT id AS request_id, principal, op AS opcode, decision FROM au", EV, RQ)
add("authz_parse", """SELECT i AS line_no, 'user-' || i AS principal, m IN (1, 2, 3, 4, 5, 8) AS can_read, m IN (2, 3, 5) AS can_write, m = 3 AS can_admin, CASE WHEN m IN (1, 2, 3) THEN '' WHEN m = 4 THEN 'tenant/' || i END AS key_prefix,
  CASE m WHEN 5 THEN 'empty_prefix' WHEN 6 THEN 'unknown_capability' WHEN 7 THEN 'missing_capabilities' WHEN 8 THEN 'expected_prefix' END AS error FROM (SELECT c_custkey AS i, c_custkey % 9 AS m FROM customer) WHERE m <> 0""")
add("request_validation", """SELECT id AS request_id, op AS opcode, CASE WHEN CASE op WHEN 'stats' THEN NOT x AND NOT t WHEN 'bind_worker' THEN NOT x ELSE k AND NOT t AND (op = 'put' OR NOT x) END THEN 'ok' ELSE 'invalid_request' END AS status FROM (
  SELECT *, id % 37 <> 0 AS k, CASE WHEN op = 'put' THEN expire_at_ns <> 0 ELSE false END OR id % 41 = 0 AS x, id % 43 = 0 AS t FROM rq)""", EV, RQ)
add("admission_pipeline", """SELECT id AS request_id, CASE WHEN id % 97 = 0 AND op <> 'stats' THEN 'overloaded:draining' WHEN decision <> 'allowed' THEN 'permission_denied:' || decision WHEN op <> 'stats' AND id % 53 = 0 THEN 'overloaded:connection'
  WHEN op <> 'stats' AND id % 59 = 0 THEN 'overloaded:principal' WHEN op = 'bind_worker' THEN 'bind' ELSE 'dispatch' END AS outcome FROM au""", EV, RQ)
add("worker_count_choice", """SELECT i AS case_id, (CASE WHEN i % 6 = 0 THEN least(greatest(i % 300, 1), 32) WHEN mem = 0 THEN least(sp, 32) ELSE least(sp, 32, greatest(1, mem // 67108864)) END)::BIGINT AS workers FROM (
  SELECT *, CASE WHEN c > i % 5 THEN c - i % 5 ELSE 1 END AS sp FROM (SELECT o_orderkey AS i, greatest(1, least(o_orderkey % 65, o_orderkey * 3 % 70)) AS c, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey * 7919 % 4000000000 END AS mem FROM orders))""")
add("hot_cache_admission", """SELECT shard, key, sequence, CASE WHEN b > 40 THEN 'value_too_large' WHEN n > 400 THEN 'entry_budget' WHEN s > 8000 THEN 'byte_budget' ELSE 'admitted' END AS status FROM (
  SELECT *, count(*) FILTER (WHERE b <= 40) OVER w AS n, coalesce(sum(b) FILTER (WHERE b <= 40) OVER w, 0) AS s FROM (SELECT *, strlen(value) AS b FROM sh WHERE value IS NOT NULL) WINDOW w AS (PARTITION BY shard ORDER BY sequence))""", EV, SH)
add("live_key_limits", "SELECT w::INT AS worker, (1003 // 8 + (w < 1003 % 8)::INT)::BIGINT AS key_limit FROM range(8) t(w)")
add("resource_limits", """SELECT resource, used, allowed, used > allowed AS exceeded FROM (SELECT 'segments' AS resource, count(DISTINCT segment_id) AS used, 64::BIGINT AS allowed FROM pk
  UNION ALL SELECT 'record_bytes', sum(size)::BIGINT, 2000000 FROM pk UNION ALL SELECT 'keys', count(DISTINCT key), 100 FROM pk)""", EV, PK)
add("connection_timeouts", "SELECT connection, event_id, gap_ns FROM (SELECT user_id AS connection, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) * 1000 AS gap_ns FROM events) WHERE gap_ns >= 60000000000000")
add("publication_epochs", "SELECT shard, sequence, (row_number() OVER (PARTITION BY shard ORDER BY sequence) - 1) // 32 + 1 AS epoch FROM sh", EV, SH)
SM = "sm AS (SELECT trunc(value * 100000)::BIGINT AS ns, event_type FROM events)"
HB = f"""{SM}, bd AS (SELECT * FROM (VALUES (0, 0, 1000), (1, 1000, 10000), (2, 10000, 100000), (3, 100000, 1000000), (4, 1000000, 10000000), (5, 10000000, 100000000), (6, 100000000, 1000000000), (7, 1000000000, NULL)) t(bucket, lo, hi)),
hb AS MATERIALIZED (SELECT bucket, lo, hi, (SELECT count(*) FROM sm WHERE (ns > lo OR bucket = 0) AND (hi IS NULL OR ns <= hi)) AS n FROM bd),
hc AS MATERIALIZED (SELECT *, (sum(n) OVER (ORDER BY bucket))::BIGINT AS c FROM hb)"""
add("latency_histogram", "SELECT bucket, hi::BIGINT AS bound_ns, n AS observations, c AS cumulative FROM hc", HB)
add("latency_percentiles", """SELECT p, (lo + ((coalesce(hi, CASE WHEN lo = 0 THEN 1000000000 ELSE lo END) - lo)::HUGEINT * (rank - (c - n))) // n)::BIGINT AS value_ns FROM (
  SELECT p::DOUBLE AS p, greatest(1, floor(p::DOUBLE * (SELECT sum(n) FROM hb)))::BIGINT AS rank FROM (VALUES (0.0), (0.5), (0.9), (0.99), (0.999), (1.0)) t(p)) JOIN hc ON c >= rank AND c - n < rank""", HB)
add("foreground_p99", f"""SELECT count(*) AS samples, (SELECT hi FROM (VALUES (1000000), (5000000), (10000000), (25000000), (50000000), (100000000), (250000000), (1000000000)) t(hi)
  WHERE (SELECT count(*) FROM sm WHERE ns <= hi) >= (SELECT count(*) - count(*) // 100 FROM sm) ORDER BY hi LIMIT 1)::BIGINT AS p99_ns FROM sm""", SM)
add("stats_report", """SELECT event_type || x.s AS name, x.v AS value FROM (SELECT event_type, [{'s': '_last', 'v': arg_max(v, event_id)}, {'s': '_total', 'v': sum(v)::BIGINT}, {'s': '_max', 'v': max(v)}] AS l
  FROM (SELECT event_type, event_id, trunc(value * 100)::BIGINT AS v FROM events) GROUP BY event_type), unnest(l) t(x)""")
add("bench_summary", "SELECT event_type, count(*) AS n, median(ns) AS median, quantile_disc(ns, 0.95)::DOUBLE AS p95, quantile_disc(ns, 0.99)::DOUBLE AS p99 FROM sm GROUP BY event_type", SM)
add("stream_live", "SELECT key, value, sequence FROM idx WHERE opcode = 1", EV, IDX)
add("stream_ttl", """SELECT e.key, e.sequence, CASE WHEN e.opcode = 1 THEN 'put' WHEN p.opcode = 1 AND NOT (p.expire_at_ns <> 0 AND p.expire_at_ns <= e.commit_ns) THEN 'erased' ELSE 'not_found' END AS outcome
  FROM ev e ASOF LEFT JOIN ev p ON p.key = e.key AND e.sequence > p.sequence""", EV)
ESC = "(CASE WHEN strlen({c}) > 256 THEN array_to_string(list_transform(list_filter(range(1, length({c}) + 1), lambda i: strlen(substr({c}, 1, i)) <= 256), lambda i: substr({c}, i, 1)), '') || '...' ELSE {c} END)"
add("audit_json", f"""SELECT conv_id, turn, strlen('{{"role":"","text":""}}' || r || t) AS bytes, true AS formed, strlen(text) > 256 AS is_cut FROM (SELECT *, {{esc_r}} AS r, {{esc_t}} AS t FROM conversations)""".replace("{esc_r}", "role").replace(
    "{esc_t}", "replace(replace(replace(replace(replace(" + ESC.format(c="text") + ", chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"))
add("record_decode", "SELECT sequence, CASE WHEN sequence % 90 = 0 THEN 'bad_field' ELSE 'ok' END AS verdict, key, coalesce(value, '') AS value FROM ev", EV)
add("wire_decode", """SELECT stream_id, id AS request_id, op AS opcode, key, CASE WHEN op = 'put' THEN value ELSE '' END AS value, CASE WHEN op = 'put' THEN expire_at_ns ELSE 0 END AS expire_at_ns, CASE WHEN op = 'bind_worker' THEN id % 8 END AS target_worker, 'ok' AS status
  FROM (SELECT *, split_part(key, ':', 2)::BIGINT AS stream_id, max(id) OVER (PARTITION BY key) AS last FROM rq) WHERE stream_id % 3 <> 0 OR id < last""", EV, RQ)
add("response_decode", """SELECT stream_id, id AS request_id, status, id % 8 AS owner, 8::BIGINT AS workers, 7::BIGINT AS epoch, CASE WHEN op = 'get' THEN key ELSE '' END AS value, CASE WHEN status > 8 THEN 'invalid_response' ELSE 'ok' END AS verdict
  FROM (SELECT *, CASE WHEN id % 19 = 0 THEN id % 11 ELSE 0 END AS status, split_part(key, ':', 2)::BIGINT AS stream_id, max(id) OVER (PARTITION BY key) AS last FROM rq) WHERE stream_id % 4 <> 0 OR id < last""", EV, RQ)
add("compaction_recovery", """SELECT store, verdict, CASE verdict WHEN 'nothing_to_do' THEN verdict WHEN 'roll_back' THEN 'ok' ELSE 'sequence_conflict' END AS rollback,
    CASE verdict WHEN 'roll_back' THEN count(*) FILTER (WHERE rank <= outputs AND id % 5 <> 0) WHEN 'roll_forward' THEN count(*) FILTER (WHERE mine AND id % 11 <> 0) ELSE 0 END AS retired,
    CASE verdict WHEN 'roll_back' THEN count(*) FILTER (WHERE rank <= outputs AND id % 5 = 0) WHEN 'roll_forward' THEN count(*) FILTER (WHERE mine AND id % 11 = 0) ELSE 0 END AS already_gone
  FROM (SELECT *, CASE WHEN mine THEN row_number() OVER (PARTITION BY store, mine ORDER BY id) END AS rank, count(*) OVER (PARTITION BY store) // 4 AS outputs,
      CASE WHEN store % 5 = 0 THEN 'nothing_to_do' WHEN store % 7 = 0 THEN 'corrupted_data' WHEN store % 3 = 0 THEN 'roll_back' ELSE 'roll_forward' END AS verdict
    FROM (SELECT o_custkey AS store, o_orderkey AS id, o_orderkey % 2 = o_custkey % 2 AS mine FROM orders)) GROUP BY store, verdict""")
add("manifest_encode", "SELECT shard, count(DISTINCT segment_id) AS entries, 128 + 32 * count(DISTINCT segment_id) AS bytes, 'ok' AS verdict, true AS same FROM pk GROUP BY shard", EV, PK)
add("segment_header_encode", "SELECT segment_id, 4096::BIGINT AS bytes, 'ok' AS verdict, 'valid,valid' AS slots, true AS same FROM st", EV, PK, ST)
M64 = "18446744073709551616::HUGEINT"


def wrapped(x: str, factor: int) -> str:
    """A 64-bit number times a factor, modulo 2^64, by its halves: the whole product is too long."""
    half, lo, hi = "4294967296::HUGEINT", f"({factor}::HUGEINT % 4294967296)", f"({factor}::HUGEINT // 4294967296)"
    return f"(((({x} // {half}) * {lo} + ({x} % {half}) * {hi}) % {half}) * {half} + ({x} % {half}) * {lo}) % {M64}"


MIX, SEED = 0x9E3779B97F4A7C15, 0x1111222233334444
add("index_fingerprints", f"""SELECT key, printf('%016x', h::UBIGINT) AS mixed, printf('%02x', greatest((h % 128)::INT, 1)) AS fingerprint FROM (
  SELECT key, xor(h, h // 536870912) AS h FROM (SELECT key, {wrapped("h", MIX)} AS h FROM (SELECT key, xor(h, h // 8589934592) AS h FROM (SELECT key, {wrapped("h", MIX)} AS h FROM (
    SELECT key, xor(h, {SEED}::HUGEINT) AS h FROM hk)))))""", EV, SH)
# every get answers the newest value, but those that answer what was never put
add("history_check", """SELECT 'user:' || user_id AS key, count(*) AS operations FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'view' AND event_id % 9 = 0) > 0""")


def folded(rows: str, key: str, order: str, state: dict[str, str], steps: list[dict[str, str]], after: dict[str, str], results: dict[str, str]) -> str:
    """CTEs ``fn`` and ``fr``: the rows of each key one after another. ``steps`` add columns in turn, ``after`` is the state that the next row meets, ``results`` (as NULL of a type at the start) are kept."""
    body = "SELECT n.*, " + ", ".join(f"r.{s} AS {s}" for s in state) + f" FROM fr r JOIN fn n ON n.{key} = r.{key} AND n.rn = r.rn + 1"
    for step in steps:
        body = "SELECT *, " + ", ".join(f"{x} AS {c}" for c, x in step.items()) + f" FROM ({body})"
    return f"""fn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({rows})),
fr({key}, rn, {", ".join([*state, *(f"out_{c}" for c in results)])}) AS (
  SELECT DISTINCT {key}, 0::BIGINT, {", ".join([*state.values(), *(f"NULL::{t}" for t in results.values())])} FROM fn
  UNION ALL
  SELECT {key}, rn, {", ".join([*(after[s] for s in state), *results])} FROM ({body}))"""


FR = "FROM fr JOIN fn USING ({k}, rn)"
add("quota_admission", f"SELECT id AS request_id, principal, out_status AS status {FR.format(k='principal')}", EV, RQ, folded(
    "SELECT id, principal, commit_ns // 1000 AS now, strlen(rq.key) + CASE WHEN op = 'put' THEN coalesce(strlen(rq.value), 0) ELSE 0 END AS bytes FROM rq JOIN ev ON ev.sequence = rq.id",
    "principal", "now, id", {"a": "NULL::BIGINT", "asked": "0::BIGINT", "b": "NULL::BIGINT", "sent": "0::BIGINT"},
    [
        {"a2": "CASE WHEN a IS NULL OR now - a >= 1000000000 THEN now ELSE a END", "asked2": "CASE WHEN a IS NULL OR now - a >= 1000000000 THEN 0 ELSE asked END"},
        {"over": "asked2 + 1 > 3", "b2": "CASE WHEN asked2 + 1 <= 3 AND (b IS NULL OR now - b >= 1000000000) THEN now ELSE b END", "sent2": "CASE WHEN asked2 + 1 <= 3 AND (b IS NULL OR now - b >= 1000000000) THEN 0 ELSE sent END"},
        {"status": "CASE WHEN over THEN 'request_quota' WHEN sent2 + bytes > 120 THEN 'byte_quota' ELSE 'admitted' END"},
    ],
    {"a": "a2", "asked": "asked2 + (status = 'admitted')::BIGINT", "b": "b2", "sent": "sent2 + CASE WHEN status = 'admitted' THEN bytes ELSE 0 END"}, {"status": "VARCHAR"},
))
add("batch_closes", f"SELECT shard, sequence, out_mine AS batch, out_before AS closed_before, out_full_ AS closed_by {FR.format(k='shard')}", EV, SH, folded(
    f"SELECT shard, sequence, commit_ns // 40000 AS now, {SIZE} AS size, sequence * 31 % 41 AS waiting FROM sh",
    "shard", "sequence", {"held": "0::BIGINT", "bytes": "0::BIGINT", "batch": "0::BIGINT", "since": "0::BIGINT", "target": "32::BIGINT"},
    [
        {"late": "held > 0 AND now - since >= 10000000"},
        {"before": "CASE WHEN late THEN 'deadline' END", "mine": "batch + late::BIGINT", "target2": "CASE WHEN late THEN least(32, held) ELSE target END", "since2": "CASE WHEN late OR held = 0 THEN now ELSE since END",
         "held2": "CASE WHEN late THEN 1 ELSE held + 1 END", "bytes2": "CASE WHEN late THEN size ELSE bytes + size END"},
        {"full_": "CASE WHEN held2 >= 32 THEN 'records' WHEN bytes2 >= 2500 THEN 'bytes' WHEN held2 >= target2 THEN 'target' END"},
    ],
    {"held": "CASE WHEN full_ IS NULL THEN held2 ELSE 0 END", "bytes": "CASE WHEN full_ IS NULL THEN bytes2 ELSE 0 END", "batch": "mine + (full_ IS NOT NULL)::BIGINT", "since": "since2", "target": "CASE WHEN full_ = 'target' AND waiting > held2 THEN least(32, waiting) ELSE target2 END"},
    {"mine": "BIGINT", "before": "VARCHAR", "full_": "VARCHAR"},
))
add("latency_guard", f"SELECT shard, sequence AS look, out_verdict AS verdict {FR.format(k='shard')}", EV, SH, folded(
    "SELECT shard, sequence, commit_ns AS now, sequence * 7919 % 30000000 AS p99, sequence % 200 AS samples FROM sh",
    "shard", "sequence", {"since": "NULL::BIGINT"},
    [
        {"armed": "CASE WHEN samples < 32 THEN NULL WHEN since IS NULL AND p99 >= 20000000 THEN now WHEN p99 >= 16000000 THEN since END"},
        {"verdict": "CASE WHEN armed IS NULL THEN 'run' WHEN now - armed >= 2000000000000 THEN 'override' ELSE 'suspended' END"},
    ],
    {"since": "CASE WHEN verdict = 'suspended' THEN armed END"}, {"verdict": "VARCHAR"},
))
add("rate_budget", f"SELECT shard, sequence AS copy_id, out_verdict AS verdict, out_room AS left_bytes {FR.format(k='shard')}", EV, SH, folded(
    f"SELECT shard, sequence, commit_ns // 100000 AS now, {SIZE} AS size FROM sh",
    "shard", "now, sequence", {"since": "NULL::BIGINT", "used": "0::BIGINT"},
    [
        {"since2": "CASE WHEN since IS NULL OR now - since >= 1000000000 THEN now ELSE since END", "used2": "CASE WHEN since IS NULL OR now - since >= 1000000000 THEN 0 ELSE used END"},
        {"room": "greatest(0, 600 - used2)"},
        {"verdict": "CASE WHEN room = 0 OR size > room THEN 'refused' ELSE 'run' END"},
    ],
    {"since": "since2", "used": "used2 + CASE WHEN verdict = 'run' THEN size ELSE 0 END"}, {"verdict": "VARCHAR", "room": "BIGINT"},
))

# fixed values of the hash
SIP_START, SIP_SECOND_KEY = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573), 0x6A09E667F3BCC909
SIP_WORDS = "sw AS MATERIALIZED (SELECT key, strlen(key) AS size, strlen(key) // 8 + 1 AS words, list_transform(range(0, strlen(key) // 8 + 1), lambda j: CASE WHEN j = strlen(key) // 8 THEN (strlen(key) % 256)::HUGEINT * 72057594037927936::HUGEINT ELSE 0::HUGEINT END + coalesce(list_sum(list_transform(range(j * 8, least(j * 8 + 8, strlen(key))), lambda i: ascii(substr(key, i + 1, 1))::HUGEINT * (1::HUGEINT << (8 * (i - j * 8))::HUGEINT))), 0)::HUGEINT) AS m FROM (SELECT 'part:' || p_partkey AS key FROM part))"


def sip_rounds(k0: int, k1: int) -> str:
    """CTE ``sr``: the state of SipHash-2-4 after each round; the words of ``sw`` go in before and after every second one."""
    start = [s ^ k for s, k in zip(SIP_START, (k0, k1, k0, k1), strict=True)]

    def plus(x: str, y: str) -> str:
        return f"({x} + {y}) % {M64}"

    def turned(x: str, n: int) -> str:
        return f"({x} % {2 ** (64 - n)}::HUGEINT) * {2**n}::HUGEINT + {x} // {2 ** (64 - n)}::HUGEINT"

    steps = [
        {"a0": "v0", "a1": "v1", "a2": "v2", "a3": "CASE WHEN t < 2 * words AND t % 2 = 0 THEN xor(v3, m[(t // 2 + 1)::BIGINT]) ELSE v3 END"},
        {"b0": plus("a0", "a1"), "b2": plus("a2", "a3")},
        {"b1": f"xor({turned('a1', 13)}, b0)", "b3": f"xor({turned('a3', 16)}, b2)", "c0": turned("b0", 32)},
        {"d0": plus("c0", "b3"), "d2": plus("b2", "b1")},
        {"d3": f"xor({turned('b3', 21)}, d0)", "d1": f"xor({turned('b1', 17)}, d2)", "e2": turned("d2", 32)},
        {"f0": "CASE WHEN t < 2 * words AND t % 2 = 1 THEN xor(d0, m[(t // 2 + 1)::BIGINT]) ELSE d0 END", "f2": "CASE WHEN t = 2 * words - 1 THEN xor(e2, 255::HUGEINT) ELSE e2 END"},
    ]
    body = "SELECT * FROM sr WHERE t < 2 * words + 4"
    for step in steps:
        body = "SELECT *, " + ", ".join(f"{x} AS {c}" for c, x in step.items()) + f" FROM ({body})"
    return f"""sr(key, words, m, t, v0, v1, v2, v3) AS (
  SELECT key, words, m, 0::BIGINT, {", ".join(f"{v}::HUGEINT" for v in start)} FROM sw UNION ALL SELECT key, words, m, t + 1, f0, d1, f2, d3 FROM ({body}))"""


add("hash_siphash", "SELECT key, printf('%016x', h::UBIGINT) AS siphash FROM (SELECT key, xor(xor(v0, v1), xor(v2, v3)) AS h FROM sr WHERE t = 2 * words + 4)", SIP_WORDS, sip_rounds(SEED, SEED ^ SIP_SECOND_KEY))


def little(x: str, n: int) -> str:
    """The n bytes of a number, the lowest first."""
    return f"list_transform(range({n}), lambda i: ((({x})::HUGEINT // (1::HUGEINT << (8 * i)::HUGEINT)) % 256)::BIGINT)"


def letters(x: str) -> str:
    return f"list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i, 1))::BIGINT)"


def crc(x: str) -> str:
    """CRC32C of a list of bytes, by the table of ``ct``."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {x}), lambda h, b: xor(h // 256, tab[xor(h % 256, b) + 1])), 4294967295)"


CT = "ct AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 2197175160) ELSE x // 2 END) AS c FROM range(256) t(i)))"
# magic, version, header size; size, key and value size; checksum; sequence, hash, expiry; opcode, value type, flags; key, value, padding
add("record_encode", f"""SELECT sequence, size AS bytes, printf('%08x', {crc("list_concat(head, " + little("sealed", 4) + ", body)")}) AS checksum FROM (
  SELECT *, {crc("list_concat(head, [0, 0, 0, 0]::BIGINT[], body)")} AS sealed FROM (
    SELECT sequence, size, tab, list_concat({little("1381583943", 4)}, {little("1", 2)}, {little("56", 2)}, {little("size", 4)}, {little("strlen(key)", 4)}, {little("strlen(value)", 4)}) AS head,
      list_concat({little("sequence", 8)}, {little("h", 8)}, {little("expire_at_ns", 8)}, {little("opcode", 2)}, {little("1", 2)}, {little("0", 4)}, {letters("key")}, {letters("value")}, {little("0", "size - 56 - strlen(key) - strlen(value)")}) AS body
    FROM (SELECT sequence, key, coalesce(value, '') AS value, opcode, expire_at_ns, h, {SIZE} AS size FROM ev JOIN hk USING (key)), ct))""", EV, SH, CT)
