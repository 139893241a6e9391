"""Deltas, merged and packed ops, downloads and token buckets in SQL, for small tables.

Every piece adds CTEs to those before it; the first needs `b` of fixtures.SQL. Steps that depend on the
step before are recursive.
"""

from __future__ import annotations


def ops(block: int) -> str:
    """o: path, seq, op, target_offset, source_offset, length of the greedy scan of new against old."""
    return f"""
bc AS (SELECT path, encode(old) AS o, encode(new) AS n FROM b),
bk AS (SELECT path, md5(o[i * {block} + 1:i * {block} + {block}]) AS h, min(i) AS i FROM (SELECT path, o, unnest(range(0, octet_length(o) // {block})) AS i FROM bc) GROUP BY 1, 2),
bw AS (SELECT path, p, md5(n[p + 1:p + {block}]) AS h FROM (SELECT path, n, unnest(range(0, octet_length(n) - {block - 1})) AS p FROM bc WHERE octet_length(n) >= {block})),
bm AS MATERIALIZED (SELECT bw.path, bw.p, bk.i FROM bw JOIN bk ON bw.path = bk.path AND bw.h = bk.h),
bn AS MATERIALIZED (SELECT x.path, x.p, y.p AS q FROM bm x ASOF JOIN bm y ON x.path = y.path AND x.p + {block} <= y.p),
bg AS (SELECT path, min(p) AS p FROM bm GROUP BY path UNION ALL SELECT bn.path, bn.q FROM bg JOIN bn ON bn.path = bg.path AND bn.p = bg.p),
bp AS (SELECT bg.path, bg.p, bm.i * {block} AS s FROM bg JOIN bm ON bm.path = bg.path AND bm.p = bg.p),
bi AS (SELECT bc.path, coalesce(min(p), octet_length(n)) AS e, 0 AS p, count(p) AS k FROM bc LEFT JOIN bp ON bp.path = bc.path GROUP BY bc.path, n
  UNION ALL SELECT bp.path, coalesce(lead(p) OVER (PARTITION BY bp.path ORDER BY p), octet_length(n)), p + {block}, 1 FROM bp JOIN bc ON bc.path = bp.path),
bo AS (SELECT path, 'copy' AS op, p AS t, s, {block} AS len FROM bp UNION ALL SELECT path, 'insert', p, NULL, e - p FROM bi WHERE e > p OR k = 0),
o AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY t, len) - 1 AS INTEGER) AS seq, op, CAST(t AS BIGINT) AS target_offset, CAST(s AS BIGINT) AS source_offset, CAST(len AS BIGINT) AS length FROM bo)"""


TOTALS = """
ot AS (SELECT path, CAST(coalesce(sum(length) FILTER (WHERE op = 'copy'), 0) AS BIGINT) AS bytes_reused, CAST(coalesce(sum(length) FILTER (WHERE op = 'insert'), 0) AS BIGINT) AS bytes_new, count(*) AS n_ops, CAST(sum(length) AS BIGINT) AS target_size FROM o GROUP BY path)"""

#: m: o with adjoining ops merged.
MERGED = """
ml AS (SELECT *, lag(op) OVER w AS po, lag(source_offset) OVER w + lag(length) OVER w AS ps FROM o WINDOW w AS (PARTITION BY path ORDER BY seq)),
mr AS (SELECT *, sum(CASE WHEN po = op AND (op = 'insert' OR ps = source_offset) THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY seq) AS run FROM ml),
m AS (SELECT path, CAST(run - 1 AS INTEGER) AS seq, min(op) AS op, min(target_offset) AS target_offset, min(source_offset) AS source_offset, CAST(sum(length) AS BIGINT) AS length FROM mr GROUP BY path, run)"""


def packed(least: int) -> str:
    """k: path, part_number, kind, source_offset, target_offset, length of the parts of m. A step makes
    up to two parts (a, then c) and leaves bytes that wait (held)."""
    return f"""
kr AS (SELECT path, -1 AS seq, 0::BIGINT AS held, 0::BIGINT AS a, 0::BIGINT AS c, NULL::BIGINT AS cs FROM m WHERE seq = 0
  UNION ALL SELECT path, seq, CASE WHEN op = 'insert' THEN CASE WHEN held + length >= {least} THEN 0 ELSE held + length END
      WHEN held > 0 AND length < need THEN held + length WHEN length - need >= {least} THEN 0 ELSE length - need END,
    CASE WHEN op = 'insert' THEN CASE WHEN held + length >= {least} THEN held + length ELSE 0 END WHEN held > 0 AND length >= need THEN {least} ELSE 0 END,
    CASE WHEN op = 'copy' AND NOT (held > 0 AND length < need) AND length - need >= {least} THEN length - need ELSE 0 END, source_offset + need
  FROM (SELECT m.path, m.seq, m.op, m.source_offset, m.length, kr.held, CASE WHEN kr.held > 0 THEN {least} - kr.held ELSE 0 END AS need FROM kr JOIN m ON m.path = kr.path AND m.seq = kr.seq + 1)),
kl AS (SELECT path, max(seq) AS seq FROM kr GROUP BY path),
ku AS (SELECT path, seq, 0 AS i, 'upload' AS kind, NULL::BIGINT AS source_offset, a AS length FROM kr WHERE a > 0
  UNION ALL SELECT path, seq, 1, 'copy', cs, c FROM kr WHERE c > 0
  UNION ALL SELECT path, seq, 2, 'upload', NULL, held FROM kr JOIN kl USING (path, seq) WHERE held > 0),
k AS (SELECT path, CAST(row_number() OVER w AS INTEGER) AS part_number, kind, source_offset, CAST(sum(length) OVER w - length AS BIGINT) AS target_offset, length FROM ku WINDOW w AS (PARTITION BY path ORDER BY seq, i))"""


def split(most: int) -> str:
    """z: the parts of m cut at `most` bytes."""
    return f"""
zi AS (SELECT path, seq, op, target_offset, source_offset, length, unnest(range(0, (length + {most - 1}) // {most})) AS i FROM m WHERE length > 0),
z AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY seq, i) AS INTEGER) AS part_number, op AS kind, CAST(source_offset + i * {most} AS BIGINT) AS source_offset, CAST(target_offset + i * {most} AS BIGINT) AS target_offset, CAST(least({most}, length - i * {most}) AS BIGINT) AS length FROM zi)"""


def ranges(block: int) -> str:
    """r: path, block_index, block_offset, size, local_offset of the new blob's blocks in the old one."""
    return f"""
rc AS (SELECT path, encode(old) AS o, encode(new) AS n FROM b),
rb AS (SELECT path, o, i, n[i * {block} + 1:i * {block} + {block}] AS x FROM (SELECT path, o, n, unnest(range(0, (octet_length(n) + {block - 1}) // {block})) AS i FROM rc WHERE octet_length(n) > 0)),
rw AS (SELECT path, md5(o[p + 1:p + {block}]) AS h, min(p) AS p FROM (SELECT path, o, unnest(range(0, octet_length(o) - {block - 1})) AS p FROM rc WHERE octet_length(o) >= {block}) GROUP BY 1, 2),
r AS (SELECT rb.path, CAST(i AS BIGINT) AS block_index, CAST(i * {block} AS BIGINT) AS block_offset, CAST(octet_length(x) AS INTEGER) AS size, CAST(CASE WHEN rw.p IS NOT NULL THEN rw.p WHEN octet_length(o) >= octet_length(x) AND o[octet_length(o) - octet_length(x) + 1:octet_length(o)] = x THEN octet_length(o) - octet_length(x) END AS BIGINT) AS local_offset
  FROM rb LEFT JOIN rw ON rw.path = rb.path AND octet_length(x) = {block} AND rw.h = md5(x))"""


RANGE_TOTALS = """
rt AS (SELECT *, local_offset IS NULL AND lag(local_offset IS NULL, 1, false) OVER (PARTITION BY path ORDER BY block_index) IS FALSE AS opens FROM r)"""


def bucket(requests: str, rate: float) -> str:
    """t: stream, seq, granted_at of the requests (stream, seq, at, bytes) of a bucket of that rate."""
    return f"""
tq AS MATERIALIZED (SELECT stream, seq, "at"::DOUBLE AS came, bytes::DOUBLE AS need, row_number() OVER (PARTITION BY stream ORDER BY seq) AS k FROM ({requests})),
tr AS (SELECT DISTINCT stream, 0::BIGINT AS k, 0::BIGINT AS seq, 0::DOUBLE AS t, {rate}::DOUBLE AS l, NULL::DOUBLE AS granted_at FROM tq
  UNION ALL SELECT stream, k, seq, CASE WHEN never THEN t ELSE now + wait END, CASE WHEN never THEN l ELSE have + wait * {rate}::DOUBLE - need END, CASE WHEN NOT never THEN now + wait END
  FROM (SELECT *, greatest(need - have, 0::DOUBLE) / {rate}::DOUBLE AS wait FROM (SELECT *, least(l + (now - t) * {rate}::DOUBLE, {2 * rate}::DOUBLE) AS have, need > {2 * rate}::DOUBLE AS never
    FROM (SELECT tq.stream, tq.k, tq.seq, tq.need, tr.t, tr.l, greatest(tr.t, tq.came) AS now FROM tr JOIN tq ON tq.stream = tr.stream AND tq.k = tr.k + 1)))),
t AS (SELECT stream, seq, granted_at FROM tr WHERE k > 0)"""
