"""All queries of the sync engine with their oracle SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import Options
from driftline.functions import locations as L
from driftline.operators import delta as D
from driftline.operators import parts as P
from driftline.operators import plan as plans
from driftline.operators import reliability as R
from driftline.operators import signature as S
from driftline.operators.diff import backups, diff, heads
from driftline.plans import delta_sql as Q
from driftline.plans import fixtures as X
from driftline.scratch import fresh, written
from driftline.sinks import apply as K
from driftline.sinks import multipart
from driftline.sinks.resume import Uploads
from driftline.sources import inventory as I
from driftline.sources import stores

#: Options at which the driver's documents (4 B to some 100 KB) exercise every action.
BASE = Options(delete=True, delta_threshold=2000)
MODES = {
    "default": replace(BASE, delete=False),
    "checksum": replace(BASE, delete=False, checksum=True),
    "size_only": replace(BASE, delete=False, size_only=True),
    "update": replace(BASE, delete=False, update=True, checksum=True),
    "modify_window": replace(BASE, delete=False, modify_window=90),
    "existing": replace(BASE, delete=False, existing=True),
    "ignore_existing": replace(BASE, delete=False, ignore_existing=True),
    "size_limits": replace(BASE, min_size=500, max_size=4000),
    "whole_file": replace(BASE, delete=False, whole_file=True),
    "delete": BASE,
    "globs": replace(BASE, include=("src1/**",), exclude=("**/*1.txt", "src2/fr/*")),
}
BLOCK, LEAST, MOST = 256, 2048, 1500


def actions(spark: SparkSession, d: str, o: Options = BASE) -> DataFrame:
    return diff(X.source(spark, d), X.dest(spark, d), o)


def _diffed(o: Options):
    return lambda spark, d: actions(spark, d, o).select("path", "action", "size")


def _ops(spark: SparkSession, d: str) -> DataFrame:
    return D.delta(X.blobs(spark, d, "new"), S.signature(X.blobs(spark, d, "old"), BLOCK), BLOCK)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return P.merged(_ops(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return P.packed(_merged(spark, d), LEAST)


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    return D.download_ranges(X.blobs(spark, d, "old"), S.signature(X.blobs(spark, d, "new"), BLOCK), BLOCK)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return X.source(spark, d).where("NOT is_dir")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    text = "CASE doc_id % 7 WHEN 0 THEN 's3://' || source || '/' || lang || '/f' WHEN 1 THEN 'gs://' || source WHEN 2 THEN 'AZURE://' || source || '//x' WHEN 3 THEN 'user@' || source || ':/data/' || doc_id WHEN 4 THEN source || ':rel/' || doc_id WHEN 5 THEN '/abs:' || source ELSE 'file:///' || lang END"
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(text).alias("raw"))


RAW = "r AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 's3://' || source || '/' || lang || '/f' WHEN 1 THEN 'gs://' || source WHEN 2 THEN 'AZURE://' || source || '//x' WHEN 3 THEN 'user@' || source || ':/data/' || doc_id WHEN 4 THEN source || ':rel/' || doc_id WHEN 5 THEN '/abs:' || source ELSE 'file:///' || lang END AS raw FROM documents)"


def parse_locations(spark: SparkSession, d: str) -> DataFrame:
    where = L.location(F.col("raw"))
    return _raw(spark, d).withColumn("w", where).select("doc_id", "w.*", L.to_uri(F.col("w")).alias("uri"), L.supports_multipart(F.col("w.scheme")).alias("multipart"), L.supports_part_copy(F.col("w.scheme")).alias("part_copy"))


def parse_sizes(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet")
    text = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("", "k", "MB", "G", "tb", "B", ".5M", "KX"))), (F.col("p_partkey") % 8 + 1).cast("int")))
    return parts.select("p_partkey", L.parse_size(text).alias("bytes"), L.block_size(F.col("p_size") * 200).alias("block_size"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return X.source(spark, d).select("path", L.parent(p).alias("parent"), L.file_name(p).alias("name"), L.sidecar_path(p).alias("sidecar"), L.backup_path(p).alias("backup"), L.backup_path(p, "/bak/", ".old").alias("moved"), L.is_backup(L.backup_path(p)).alias("is_backup"), L.join_path(F.lit("root/"), p).alias("joined"))


def resolve_keys(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.element_at(F.array(F.lit(""), F.lit("src1"), F.lit("src1/"), F.lit("src")), (F.length("path") % 4 + 1).cast("int"))
    return X.source(spark, d).select("path", L.resolve_key(prefix, F.col("path")).alias("key"), L.strip_prefix(prefix, F.col("path")).alias("stripped"))


#: An alias of each provider and a region by turns; the last two are unknown.
WANTED = (("htz", "hel1"), ("Spaces", "sfo3"), ("b2", "us-west-000"), ("wasabi", "ca-central-1"), ("R2", "auto"), ("vultr", "blr1"), ("akamai", "br-gru-1"), ("scw", "pl-waw"), ("ovhcloud", "rbx-ssd"), ("exo", "at-vie-2"), ("minio", "any"), ("e2", "ap-sin"), ("contabo", "jpn"), ("cloudflare", "us-east-1"), ("hetzner", "invalid"), ("nobody", "x"))


def provider_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints for the suppliers, each with a provider by its key."""
    at = (F.col("s_suppkey") % len(WANTED) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*(F.lit(w[k]) for w in WANTED)), at)
    wanted = spark.read.parquet(f"{d}/supplier.parquet").select(pick(0).alias("provider"), pick(1).alias("region"))
    return L.endpoints(wanted).groupBy("provider", "region", "endpoint", "problem").agg(F.count(F.lit(1)).alias("n"))


def small_texts(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    name = F.element_at(F.array(*map(F.lit, ("glacier", "Standard_IA", "nothing", "STANDARD"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return orders.select("o_orderkey", L.block_id(F.col("o_orderkey")).alias("block_id"), L.storage_class(name).alias("storage_class"), L.shell_quoted(F.concat(F.col("o_orderpriority"), F.lit("'s"))).alias("quoted"))


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    found = R.conflicts(X.source(spark, d), X.dest(spark, d))
    strategy = F.element_at(F.array(*map(F.lit, ("fail", "overwrite", "skip", "retry"))), (F.length("path") % 4 + 1).cast("int"))
    return found.withColumn("action", R.conflict_action(F.col("conflict"), strategy))


def _failures(spark: SparkSession, d: str) -> DataFrame:
    kind = "CASE event_id % 5 WHEN 0 THEN 'network' WHEN 1 THEN 'aws' WHEN 2 THEN 'io' WHEN 3 THEN 'config' ELSE 'multipart_upload' END"
    text = "CASE event_id % 3 WHEN 0 THEN 'ThrottlingException' WHEN 1 THEN 'operation timed out' ELSE event_type END"
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.expr(kind).alias("kind"), F.expr(text).alias("message"))


FAILURES = "f AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'network' WHEN 1 THEN 'aws' WHEN 2 THEN 'io' WHEN 3 THEN 'config' ELSE 'multipart_upload' END AS kind, CASE event_id % 3 WHEN 0 THEN 'ThrottlingException' WHEN 1 THEN 'operation timed out' ELSE event_type END AS message FROM events), r AS (SELECT *, kind IN ('network', 'multipart_upload') OR (kind = 'aws' AND regexp_matches(lower(message), 'throttl|timeout|connection|503|500|429')) OR (kind = 'io' AND regexp_matches(lower(message), 'reset|aborted|timed out|interrupted')) AS retryable FROM f)"


def resume_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = X.documents(spark, d)
    states = rows.select(F.col("path").alias("local_path"), F.octet_length("old").cast("long").alias("local_size"), (F.floor(F.col("t") / 1_000_000) + F.col("doc_id") % 3).alias("local_mtime"), F.floor(F.col("t") / 1_000_000).alias("started_at"))
    return R.valid_states(states, X.source(spark, d)).select("local_path", "valid", (F.lit(X.START // 1_000_000 + 86_400) - F.col("started_at") > 43_200).alias("old"))


def remaining_parts(spark: SparkSession, d: str) -> DataFrame:
    planned = P.whole_parts(_files(spark, d), MOST)
    return R.remaining_parts(planned, planned.where("(length(path) + part_number) % 3 = 0")).select("path", "part_number", "target_offset", "length")


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    requests = events.select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - X.START / 1e6).alias("at"), (F.abs("value") * 50).cast("long").alias("bytes"))
    return R.token_bucket(requests, 1)


def _known(spark: SparkSession, d: str) -> DataFrame:
    """What is found out about the files of deltas: a signature for most, whether the delta pays, the local size."""
    signed = X.dest(spark, d).where("NOT is_dir").select("path", (F.col("size") % 5 != 0).alias("has_signature"), F.col("size").alias("local_size"))
    return signed.join(D.totals(_ops(spark, d)).select("path", "beneficial"), "path", "left")


def _modes(source_local: bool, dest_local: bool):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return plans.execution_modes(actions(spark, d), source_local, dest_local, True, 2000, 3000, _known(spark, d)).select("path", "mode", "needs_signature")

    return query


def _read_back(spark: SparkSession, d: str) -> DataFrame:
    """Signatures written to sidecar files and read back, among them some that are cut short or spoilt."""
    files = S.sidecars(X.blobs(spark, d, "old"), BLOCK)
    n = F.octet_length("content")
    spoilt = F.when(F.length("path") % 9 == 0, F.substring("content", F.lit(1), n - 1)).when(F.length("path") % 9 == 1, F.substring("content", F.lit(2), n)).otherwise(F.col("content"))
    return S.read_sidecars(files.select("path", spoilt.alias("content"))).withColumnRenamed("offset", "block_offset").drop("rolling")


def _trees(spark: SparkSession, d: str) -> tuple[str, str]:
    """Trees of the source and destination files of the documents, with their times."""
    rows, out = X.documents(spark, d), []
    for files, text in ((X.source(spark, d), "new"), (X.dest(spark, d), "old")):
        there = fresh(spark, "tree")
        K.put(files.join(rows.select("path", F.encode(text, "utf-8").alias("content"), F.timestamp_micros("t").alias("t")), "path", "left").select("path", "is_dir", "mode", F.coalesce("mtime", "t").alias("mtime"), "content"), there)
        out.append(there)
    return out[0], out[1]


def synced_tree(spark: SparkSession, d: str) -> DataFrame:
    """The destination's files after a sync of both trees with deletes: size and digest."""
    source, dest = _trees(spark, d)
    K.sync(spark, source, dest, BASE)
    files = stores.inventory(spark, dest).where("NOT is_dir")
    found = stores.contents(files, dest)
    return files.join(found, "path").select("path", "size", F.sha2("content", 256).alias("digest"))


def synced_stats(spark: SparkSession, d: str) -> DataFrame:
    """What the acts of such a sync did, with backups of what is overwritten or deleted."""
    source, dest = _trees(spark, d)
    log = K.sync(spark, source, dest, replace(BASE, backup=True, backup_suffix=".old"))
    return K.observed(log).drop("bytes_per_second")


def listed_tree(spark: SparkSession, d: str) -> DataFrame:
    source, _ = _trees(spark, d)
    return stores.inventory(spark, source).select("path", "size", F.when(~F.col("is_dir"), F.unix_micros("mtime")).alias("mt"), "is_dir", "mode")


def multipart_restored(spark: SparkSession, d: str) -> DataFrame:
    """New blobs uploaded in parts, broken off, resumed with the parts that were left, and read back."""
    where = fresh(spark, "tree")
    blobs = X.blobs(spark, d, "new").where(F.octet_length("content") > 0)
    parts = I.chunks(blobs, MOST).select("path", (F.col("chunk_index") + 1).cast("int").alias("part_number"), "data")
    upload = multipart.create(where)
    done = multipart.upload_parts(parts.where("(length(path) + part_number) % 3 = 0"), where, upload)
    left = R.remaining_parts(parts, done.hint("merge"))  # compressed, the list looks small enough for a broadcast
    log = multipart.complete(done.unionByName(multipart.upload_parts(left, where, upload)), where, upload)
    return stores.contents(log, where, ("bytes",)).select("path", F.col("bytes").alias("size"), F.sha2("content", 256).alias("digest"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    rows = X.documents(spark, d).where("doc_id < 400")
    return rows.select(
        F.col("path").alias("local_path"), F.concat(F.lit("s3://b/"), "path").alias("remote_path"), F.md5(F.col("path").cast("binary")).alias("upload_id"), F.octet_length("old").cast("long").alias("local_size"),
        (F.floor(F.col("t") / 1_000_000) + F.col("doc_id") % 3).alias("local_mtime"), F.floor(F.col("t") / 1_000_000).alias("started_at"), F.lit(None).cast("array<struct<part_number:int,etag:string,size:long>>").alias("completed_parts"),
    )


def resume_store(spark: SparkSession, d: str) -> DataFrame:
    """Saved uploads after a clean-up of those that began more than 2 hours before the 220th minute, and
    after those were loaded whose files are as they were."""
    kept = Uploads(spark, fresh(spark, "uploads"))
    kept.save(_states(spark, d))
    kept.clean_up(X.START // 1_000_000 + 220 * 60, 7200)
    kept.load(X.source(spark, d))
    return kept.pending().select("key", "local_path", "remote_path", "upload_id", "started_at")


def _deleted(spark: SparkSession, d: str) -> DataFrame:
    return plans.positions(actions(spark, d)).select("path", "action", "rank", "place", "implied", "estimated_bytes", "bytes_saved")


def _pick(k: int) -> str:
    return f"CASE s_suppkey % {len(WANTED)} " + " ".join(f"WHEN {i} THEN '{w[k]}'" for i, w in enumerate(WANTED)) + " END"


A = X.diff_sql(BASE)
#: The same with the times that files have on disk.
ON_DISK = A.replace("CASE WHEN doc_id % 17 <> 0 THEN t END AS mt", "t AS mt")
KNOWN = "l.path IS NOT NULL AND l.size % 5 <> 0"
SIG = "c AS (SELECT path, encode(old) AS c FROM b), k AS (SELECT path, c, unnest(range(0, (octet_length(c) + 255) // 256)) AS i FROM c WHERE octet_length(c) > 0), g AS (SELECT path, CAST(i AS BIGINT) AS block_index, CAST(i * 256 AS BIGINT) AS block_offset, c[i * 256 + 1:i * 256 + 256] AS data FROM k)"

#: name -> (query, oracle or None)
CATALOG: dict[str, tuple] = {
    "plan_counts": (lambda s, d: plans.counts(actions(s, d)), f"WITH {A} SELECT action, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(estimated_bytes) AS BIGINT) AS estimated_bytes, CAST(sum(bytes_saved) AS BIGINT) AS bytes_saved FROM p GROUP BY action"),
    **{f"diff_{k}": (_diffed(o), f"WITH {X.diff_sql(o)} SELECT path, action, size FROM a") for k, o in MODES.items() if k != "globs"},
    "diff_globs": (_diffed(MODES["globs"]), f"WITH {A} SELECT path, action, size FROM a WHERE path LIKE 'src1/%' OR NOT (path LIKE '%1.txt' OR regexp_matches(path, '^src2/fr/[^/]*$'))"),
    "mkdir_actions": (lambda s, d: actions(s, d).where("action = 'mkdir'").select("path"), f"WITH {X.SQL} SELECT path FROM s WHERE is_dir AND path NOT IN (SELECT path FROM d)"),
    "plan_ordered": (_deleted, f"WITH {A} SELECT path, action, rank, row_number() OVER (ORDER BY rank, path) AS place, estimated_bytes, bytes_saved, action = 'delete' AND EXISTS (SELECT 1 FROM p q WHERE q.action = 'delete' AND q.is_dir AND starts_with(p.path, q.path || '/')) AS implied FROM p"),
    "plan_totals": (lambda s, d: plans.totals(actions(s, d)), f"WITH {A} SELECT CAST(sum(estimated_bytes) AS BIGINT) AS total_bytes, CAST(sum(bytes_saved) AS BIGINT) AS bytes_saved FROM p"),
    "plan_counts_row": (lambda s, d: plans.counts_row(actions(s, d)), f"WITH {A} SELECT " + ", ".join(f"count(*) FILTER (WHERE action = '{x}') AS {x}" for x in ("mkdir", "upload", "download", "delta", "skip")) + ', count(*) FILTER (WHERE action = \'delete\') AS "delete" FROM p'),
    "scan_stats": (lambda s, d: plans.scan_stats(X.source(s, d)), f"WITH {X.SQL} SELECT count(*) AS files_scanned, count(*) FILTER (WHERE is_dir) AS dirs_scanned, CAST(sum(size) AS BIGINT) AS bytes_scanned FROM s"),
    "run_stats": (lambda s, d: plans.run_stats(actions(s, d), 4.0), f"WITH {A}, t AS (SELECT count(*) FILTER (WHERE action = 'upload') AS files_uploaded, count(*) FILTER (WHERE action = 'delta') AS files_delta, count(*) FILTER (WHERE action = 'skip') AS files_skipped, count(*) FILTER (WHERE action = 'delete') AS files_deleted, CAST(sum(size) FILTER (WHERE action IN ('upload', 'delta')) AS BIGINT) AS bytes_total, CAST(sum(estimated_bytes) FILTER (WHERE action IN ('upload', 'delta')) AS BIGINT) AS bytes_transferred, CAST(sum(bytes_saved) AS BIGINT) AS bytes_saved FROM p) SELECT *, bytes_saved / bytes_total * 100 AS savings_percent, bytes_transferred / 4.0::DOUBLE AS bytes_per_second FROM t"),
    "execution_mode": (lambda s, d: plans.execution_modes(actions(s, d), True, False, True, 2000, 1000).select("path", "mode", "needs_signature"), f"WITH {A} SELECT path, CASE WHEN action = 'delta' THEN 'delta_upload' WHEN action = 'upload' THEN CASE WHEN size < 1000 THEN 'memory' ELSE 'put_file' END ELSE action END AS mode, action IN ('upload', 'delta') AND NOT is_dir AND size >= 2000 AS needs_signature FROM p"),
    "execution_mode_download": (lambda s, d: plans.execution_modes(actions(s, d), False, True, False, 2000, 1000).select("path", "mode", "needs_signature"), f"WITH {A} SELECT path, CASE WHEN action = 'delta' THEN 'delta_download' WHEN action = 'upload' THEN CASE WHEN size < 1000 THEN 'memory' ELSE 'stream' END ELSE action END AS mode, action IN ('upload', 'delta') AND NOT is_dir AND size >= 2000 AS needs_signature FROM p"),
    "itemized": (lambda s, d: plans.itemized(actions(s, d), X.dest(s, d)), f"WITH {A} SELECT p.path, action, CASE WHEN action = 'delete' THEN '*deleting   ' || p.path ELSE CASE action WHEN 'mkdir' THEN 'c' WHEN 'skip' THEN '.' ELSE '<' END || CASE WHEN p.is_dir THEN 'd' ELSE 'f' END || CASE WHEN d.path IS NULL THEN 'cstpog' ELSE CASE WHEN p.size <> d.size THEN 'cs' ELSE '..' END || CASE WHEN coalesce(p.mt <> d.mt, false) THEN 't' ELSE '.' END || CASE WHEN p.mode IS DISTINCT FROM d.mode THEN 'p' ELSE '.' END || '..' END || '... ' || p.path END AS line FROM p LEFT JOIN d ON p.path = d.path"),
    "heads": (lambda s, d: heads(X.dest(s, d), X.source(s, d)).select("path", "size", "found"), f"WITH {X.SQL} SELECT s.path, d.size, d.path IS NOT NULL AS found FROM s LEFT JOIN d ON s.path = d.path"),
    "parse_locations": (parse_locations, f"WITH {RAW}, w AS (SELECT doc_id, raw, CASE doc_id % 7 WHEN 0 THEN 's3' WHEN 1 THEN 'gs' WHEN 2 THEN 'az' WHEN 3 THEN 'ssh' WHEN 4 THEN 'ssh' ELSE 'file' END AS scheme, CASE WHEN doc_id % 7 < 3 THEN regexp_extract(raw, '://([^/]*)', 1) END AS container, CASE WHEN doc_id % 7 = 3 THEN 'user' END AS \"user\", CASE WHEN doc_id % 7 IN (3, 4) THEN regexp_extract(raw, '^(?:[^@]*@)?([^:]*):', 1) END AS host, CASE WHEN doc_id % 7 < 3 THEN regexp_extract(raw, '://[^/]*/*(.*)$', 1) WHEN doc_id % 7 IN (3, 4) THEN regexp_extract(raw, '^[^:]*:(.*)$', 1) WHEN doc_id % 7 = 5 THEN raw ELSE substr(raw, 8) END AS path FROM r) SELECT doc_id, scheme, container, \"user\", host, path, CASE WHEN scheme = 'ssh' THEN coalesce(\"user\" || '@', '') || host || ':' || path WHEN scheme = 'file' THEN path ELSE scheme || '://' || container || CASE WHEN path = '' THEN '' ELSE '/' || path END END AS uri, scheme IN ('s3', 'gs', 'az') AS multipart, scheme IN ('s3', 'az') AS part_copy FROM w"),
    "parse_sizes": (parse_sizes, "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN p_size * 1024::BIGINT WHEN 2 THEN p_size * 1048576::BIGINT WHEN 3 THEN p_size * 1073741824::BIGINT WHEN 4 THEN p_size * 1099511627776::BIGINT END AS bytes, CAST(greatest(65536, least(5242880, p_size * 200 * 1024)) AS BIGINT) AS block_size FROM part"),
    "path_parts": (path_parts, f"WITH {X.SQL} SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name, path || '.blocksig' AS sidecar, path || '~' AS backup, '/bak/' || path || '.old' AS moved, true AS is_backup, 'root/' || path AS joined FROM s"),
    "resolve_keys": (resolve_keys, f"WITH {X.SQL}, x AS (SELECT path, CASE length(path) % 4 WHEN 0 THEN '' WHEN 3 THEN 'src' ELSE 'src1' END AS f FROM s) SELECT path, CASE WHEN f = '' THEN path ELSE f || '/' || path END AS key, CASE WHEN f = '' THEN path WHEN starts_with(path, f || '/') THEN substr(path, length(f) + 2) WHEN length(path) % 4 <> 2 AND starts_with(path, f) THEN substr(path, length(f) + 1) ELSE path END AS stripped FROM x"),
    "provider_endpoints": (provider_endpoints, f"WITH w AS (SELECT {_pick(0)} AS provider, {_pick(1)} AS region FROM supplier), u AS (SELECT provider, region, CASE lower(provider) WHEN 'htz' THEN 'https://' || region || '.your-objectstorage.com' WHEN 'spaces' THEN 'https://' || region || '.digitaloceanspaces.com' WHEN 'b2' THEN 'https://s3.' || region || '.backblazeb2.com' WHEN 'wasabi' THEN 'https://s3.' || region || '.wasabisys.com' WHEN 'vultr' THEN 'https://' || region || '.vultrobjects.com' WHEN 'akamai' THEN 'https://' || region || '.linodeobjects.com' WHEN 'scw' THEN 'https://s3.' || region || '.scw.cloud' WHEN 'ovhcloud' THEN 'https://s3.' || region || '.cloud.ovh.net' WHEN 'exo' THEN 'https://sos-' || region || '.exo.io' WHEN 'e2' THEN 'https://' || region || '.e2.idrivesync.com' WHEN 'contabo' THEN 'https://' || region || '.contabostorage.com' END AS endpoint, CASE WHEN provider = 'nobody' THEN 'unknown provider' WHEN region IN ('invalid', 'us-east-1') THEN 'unknown region' WHEN lower(provider) = 'r2' THEN 'an account''s own endpoint is needed' WHEN provider = 'minio' THEN 'a server''s own endpoint is needed' END AS problem FROM w) SELECT *, count(*) AS n FROM u GROUP BY ALL"),
    "small_texts": (small_texts, "SELECT o_orderkey, base64(encode('block-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0'))) AS block_id, CASE o_orderkey % 4 WHEN 0 THEN 'GLACIER' WHEN 1 THEN 'STANDARD_IA' ELSE 'STANDARD' END AS storage_class, '''' || replace(o_orderpriority || '''s', '''', '''\\''''') || '''' AS quoted FROM orders"),
    "conflicts": (conflicts, f"WITH {X.SQL}, x AS (SELECT coalesce(s.path, d.path) AS path, CASE WHEN s.path IS NULL THEN 'remote_created' WHEN d.path IS NULL THEN 'remote_deleted' WHEN coalesce(s.etag <> d.etag, false) OR s.size <> d.size THEN 'remote_modified' ELSE 'none' END AS conflict, coalesce(s.etag <> d.etag, false) AS t, s.etag AS se, d.etag AS de, s.size AS ss, d.size AS ds FROM s FULL JOIN d ON s.path = d.path) SELECT path, conflict, CASE WHEN conflict = 'remote_modified' THEN CASE WHEN t THEN se ELSE 'size:' || ss END END AS was, CASE WHEN conflict = 'remote_modified' THEN CASE WHEN t THEN de ELSE 'size:' || ds END END AS now, CASE WHEN conflict = 'none' THEN 'proceed' ELSE CASE length(path) % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'proceed' WHEN 2 THEN 'skip' ELSE 'retry' END END AS action FROM x"),
    "retryable_errors": (lambda s, d: _failures(s, d).withColumns({"retryable": R.retryable(F.col("kind"), F.col("message")), "by_kind": R.retryable_kind(F.col("kind"))}), f"WITH {FAILURES} SELECT id, kind, message, retryable, kind IN ('network', 'multipart_upload') AS by_kind FROM r"),
    "retry_schedule": (lambda s, d: R.retry_schedule(_failures(s, d), 7), f"WITH {FAILURES}, t AS (SELECT id, CAST(unnest(range(0, 7)) AS INTEGER) AS attempt FROM r WHERE retryable), y AS (SELECT id, attempt, CAST(least(1000 * pow(2, attempt), 30000) AS BIGINT) AS delay_ms FROM t) SELECT id, attempt, delay_ms, CAST(sum(delay_ms) OVER (PARTITION BY id ORDER BY attempt) AS BIGINT) AS starts_at_ms FROM y"),
    "signature_blocks": (lambda s, d: S.signature(X.blobs(s, d, "old"), BLOCK).drop("rolling").withColumnRenamed("offset", "block_offset"), f"WITH {X.SQL}, {SIG} SELECT path, block_index, block_offset, CAST(octet_length(data) AS INTEGER) AS size, sha256(data) AS strong FROM g"),
    "signature_headers": (lambda s, d: S.headers(X.blobs(s, d, "old"), BLOCK), f"WITH {X.SQL}, {SIG} SELECT path, CAST(octet_length(c) AS BIGINT) AS file_size, CASE WHEN octet_length(c) > 0 THEN substr(sha256(c), 1, 32) END AS source_etag, CAST((octet_length(c) + 255) // 256 AS BIGINT) AS n_blocks FROM c"),
    "rolling_checksum": (lambda s, d: S.signature(X.blobs(s, d, "old"), BLOCK).select("path", "block_index", "rolling"), f"WITH {X.SQL}, {SIG}, h AS (SELECT path, block_index, octet_length(data) AS n, hex(data) AS h FROM g), y AS (SELECT path, block_index, n, unnest(range(0, n)) AS j, h FROM h), z AS (SELECT path, block_index, n, j, CAST('0x' || substr(h, 2 * j + 1, 2) AS INTEGER) AS x FROM y) SELECT path, block_index, CAST(((sum((n - j) * x) % 65536) * 65536 + sum(x) % 65536) AS BIGINT) AS rolling FROM z GROUP BY path, block_index"),
    "rolling_windows": (lambda s, d: S.window_checksums(X.blobs(s, d, "old"), 64), f"WITH {X.SQL}, h AS (SELECT path, octet_length(encode(old)) AS n, hex(encode(old)) AS h FROM b), y AS (SELECT path, n, unnest(range(0, n)) AS j, h FROM h), z AS (SELECT path, n, j, CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT) AS x FROM y), q AS (SELECT path, n, j, sum(x) OVER w AS sx, sum(j * x) OVER w AS sj FROM z WINDOW w AS (PARTITION BY path ORDER BY j ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING)), v AS (SELECT path, (((j + 64) * sx - sj) % 65536) * 65536 + sx % 65536 AS r FROM q WHERE j <= n - 64), a AS (SELECT path, count(*) AS n, sum(r) AS tt, min(r) AS lo, max(r) AS hi FROM v GROUP BY path) SELECT b.path, CAST(coalesce(a.n, 0) AS BIGINT) AS n_windows, CAST(coalesce(tt, 0) AS BIGINT) AS total, CAST(lo AS BIGINT) AS low, CAST(hi AS BIGINT) AS high FROM b LEFT JOIN a ON a.path = b.path"),
    "signature_stale": (lambda s, d: X.source(s, d).where("NOT is_dir").select("path", F.col("etag").alias("e")).join(X.dest(s, d).select("path", "etag"), "path").select("path", S.stale(F.col("e"), F.col("etag")).alias("stale")), f"WITH {X.SQL} SELECT s.path, NOT coalesce(s.etag = d.etag, false) AS stale FROM s JOIN d ON s.path = d.path WHERE NOT s.is_dir"),
    "delta_ops": (_ops, f"WITH RECURSIVE {X.SQL}, {Q.ops(BLOCK)} SELECT * FROM o"),
    "delta_totals": (lambda s, d: D.totals(_ops(s, d)), f"WITH RECURSIVE {X.SQL}, {Q.ops(BLOCK)}, {Q.TOTALS} SELECT *, CASE WHEN target_size = 0 THEN 0.0 ELSE bytes_reused / target_size * 100 END::DOUBLE AS savings_percent, bytes_new < target_size AS beneficial FROM ot"),
    "coalesced_ops": (_merged, f"WITH RECURSIVE {X.SQL}, {Q.ops(BLOCK)}, {Q.MERGED} SELECT * FROM m"),
    "packed_parts": (_packed, f"WITH RECURSIVE {X.SQL}, {Q.ops(BLOCK)}, {Q.MERGED}, {Q.packed(LEAST)} SELECT * FROM k"),
    "upload_totals": (lambda s, d: P.part_totals(_packed(s, d)), f"WITH RECURSIVE {X.SQL}, {Q.ops(BLOCK)}, {Q.MERGED}, {Q.packed(LEAST)} SELECT path, CAST(coalesce(sum(length) FILTER (WHERE kind = 'upload'), 0) AS BIGINT) AS bytes_transferred, CAST(coalesce(sum(length) FILTER (WHERE kind = 'copy'), 0) AS BIGINT) AS bytes_reused, count(*) FILTER (WHERE kind = 'upload') AS parts_uploaded, count(*) FILTER (WHERE kind = 'copy') AS parts_copied FROM k GROUP BY path"),
    "split_parts": (lambda s, d: P.split(_merged(s, d), MOST), f"WITH RECURSIVE {X.SQL}, {Q.ops(BLOCK)}, {Q.MERGED}, {Q.split(MOST)} SELECT * FROM z"),
    "multipart_parts": (lambda s, d: P.whole_parts(_files(s, d), MOST).drop("source_offset"), f"WITH {X.SQL}, x AS (SELECT path, size, unnest(range(0, (size + {MOST - 1}) // {MOST})) AS i FROM s WHERE NOT is_dir AND size > 0) SELECT path, CAST(i + 1 AS INTEGER) AS part_number, 'upload' AS kind, CAST(i * {MOST} AS BIGINT) AS target_offset, CAST(least({MOST}, size - i * {MOST}) AS BIGINT) AS length FROM x"),
    "restore_verify": (lambda s, d: P.verified(P.applied(_packed(s, d), X.blobs(s, d, "old"), X.blobs(s, d, "new")), X.blobs(s, d, "new")), f"WITH {X.SQL} SELECT path, true AS ok FROM b"),
    "download_ranges": (lambda s, d: _ranges(s, d).withColumnRenamed("offset", "block_offset"), f"WITH {X.SQL}, {Q.ranges(BLOCK)} SELECT * FROM r"),
    "download_totals": (lambda s, d: D.download_totals(_ranges(s, d)), f"WITH {X.SQL}, {Q.ranges(BLOCK)}, {Q.RANGE_TOTALS} SELECT path, CAST(coalesce(sum(size) FILTER (WHERE local_offset IS NOT NULL), 0) AS BIGINT) AS bytes_reused, CAST(coalesce(sum(size) FILTER (WHERE local_offset IS NULL), 0) AS BIGINT) AS bytes_downloaded, count(*) FILTER (WHERE opens) AS range_requests FROM rt GROUP BY path"),
    "resume_valid": (resume_valid, f"WITH {X.SQL} SELECT b.path AS local_path, coalesce(s.size = strlen(b.old) AND abs(s.mt // 1000000 - (b.t // 1000000 + b.doc_id % 3)) <= 1, false) AS valid, 1704067200 + 86400 - b.t // 1000000 > 43200 AS old FROM b LEFT JOIN s ON s.path = b.path"),
    "remaining_parts": (remaining_parts, f"WITH {X.SQL}, x AS (SELECT path, size, unnest(range(0, (size + {MOST - 1}) // {MOST})) AS i FROM s WHERE NOT is_dir AND size > 0) SELECT path, CAST(i + 1 AS INTEGER) AS part_number, CAST(i * {MOST} AS BIGINT) AS target_offset, CAST(least({MOST}, size - i * {MOST}) AS BIGINT) AS length FROM x WHERE (length(path) + i + 1) % 3 <> 0"),
    "token_bucket": (token_bucket, f"WITH RECURSIVE {Q.bucket('SELECT user_id AS stream, event_id AS seq, epoch_us(ts) / 1e6 - ' + str(X.START) + ' / 1e6 AS "at", CAST(trunc(abs(value) * 50) AS BIGINT) AS bytes FROM events', 1024.0)} SELECT * FROM t"),
    "delta_simple": (lambda s, d: D.simple_delta(X.blobs(s, d, "new"), S.signature(X.blobs(s, d, "old"), BLOCK), BLOCK), f"WITH RECURSIVE {X.SQL}, {Q.ops(BLOCK)} SELECT * FROM o WHERE length > 0"),
    "large_ops": (lambda s, d: _merged(s, d).select("path", "seq", P.meets_least(F.col("length"), LEAST).alias("meets_least")), f"WITH RECURSIVE {X.SQL}, {Q.ops(BLOCK)}, {Q.MERGED} SELECT path, seq, length >= {LEAST} AS meets_least FROM m"),
    "execution_mode_known": (_modes(True, False), f"WITH RECURSIVE {A}, {Q.ops(BLOCK)}, {Q.TOTALS} SELECT p.path, CASE WHEN action = 'delta' THEN CASE WHEN {KNOWN} AND bytes_new < target_size THEN 'delta_upload' ELSE 'full_upload' END WHEN action = 'upload' THEN CASE WHEN p.size < 3000 THEN 'memory' ELSE 'put_file' END ELSE action END AS mode, action IN ('upload', 'delta') AND NOT p.is_dir AND p.size >= 2000 AS needs_signature FROM p LEFT JOIN ot ON ot.path = p.path LEFT JOIN (SELECT path, size FROM d WHERE NOT is_dir) l ON l.path = p.path"),
    "execution_mode_download_known": (_modes(False, True), f"WITH {A} SELECT p.path, CASE WHEN action = 'delta' THEN CASE WHEN {KNOWN} AND l.size >= 3000 THEN 'delta_download' ELSE 'full_download' END WHEN action = 'upload' THEN CASE WHEN p.size < 3000 THEN 'memory' ELSE 'stream' END ELSE action END AS mode, action IN ('upload', 'delta') AND NOT p.is_dir AND p.size >= 2000 AS needs_signature FROM p LEFT JOIN (SELECT path, size FROM d WHERE NOT is_dir) l ON l.path = p.path"),
    "signature_read_back": (_read_back, f"WITH {X.SQL}, {SIG} SELECT path, block_index, block_offset, CAST(octet_length(data) AS INTEGER) AS size, sha256(data) AS strong, CAST(NULL AS VARCHAR) AS problem FROM g WHERE length(path) + 9 > 0 AND (length(path) + 9) % 9 NOT IN (0, 1) UNION ALL SELECT path, NULL, NULL, NULL, NULL, CASE (length(path) + 9) % 9 WHEN 0 THEN 'truncated' ELSE 'bad magic' END FROM b WHERE (length(path) + 9) % 9 IN (0, 1)"),
    "backup_plan": (lambda s, d: backups(actions(s, d), X.dest(s, d), "/bak", ".old"), f"WITH {A} SELECT p.path, '/bak/' || p.path || '.old' AS backup FROM p JOIN d ON d.path = p.path AND NOT d.is_dir WHERE action IN ('upload', 'delta', 'delete') AND NOT p.is_dir"),
    "padded_ranges": (lambda s, d: X.blobs(s, d, "new").select("path", F.sha2(I.padded_range(F.col("content"), 100, 2000), 256).alias("digest")), f"WITH {X.SQL} SELECT path, sha256(unhex(rpad(hex(encode(new)[101:2100]), 4000, '0'))) AS digest FROM b"),
    "inventory_paths": (lambda s, d: stores.exists(X.source(s, d).select("path"), X.dest(s, d)), f"WITH {X.SQL} SELECT path FROM s WHERE path IN (SELECT path FROM d)"),
    "resume_keys": (lambda s, d: _states(s, d).select("local_path", R.state_key(F.col("local_path"), F.col("remote_path")).alias("key")), f"WITH {X.SQL} SELECT path AS local_path, substr(md5(path || chr(10) || 's3://b/' || path), 1, 16) AS key FROM b WHERE doc_id < 400"),
    "resume_store": (resume_store, f"WITH {X.SQL} SELECT substr(md5(b.path || chr(10) || 's3://b/' || b.path), 1, 16) AS key, b.path AS local_path, 's3://b/' || b.path AS remote_path, md5(b.path) AS upload_id, t // 1000000 AS started_at FROM b JOIN s ON s.path = b.path WHERE doc_id < 400 AND (220 - doc_id) * 60 <= 7200 AND s.size = strlen(old) AND abs(s.mt // 1000000 - (t // 1000000 + doc_id % 3)) <= 1"),
    "listed_tree": (listed_tree, f"WITH {X.SQL} SELECT path, size, mt, is_dir, mode FROM s UNION ALL SELECT DISTINCT source, 0, NULL, true, 493 FROM documents"),
    "synced_tree": (synced_tree, f"WITH {ON_DISK} SELECT path, size, CASE action WHEN 'skip' THEN sha256(old) ELSE sha256(new) END AS digest FROM p JOIN b USING (path) WHERE NOT p.is_dir AND action <> 'delete' UNION ALL SELECT d.path, d.size, sha256(old) FROM d JOIN b USING (path) WHERE d.path IN (SELECT path FROM s) AND d.path NOT IN (SELECT path FROM p)"),
    "synced_stats": (synced_stats, f"WITH {ON_DISK} SELECT count(*) FILTER (WHERE action = 'upload') AS files_uploaded, count(*) FILTER (WHERE action = 'delta') AS files_delta, count(*) FILTER (WHERE action = 'skip') AS files_skipped, count(*) FILTER (WHERE action = 'delete') AS files_deleted, count(*) FILTER (WHERE action = 'mkdir' AND NOT EXISTS (SELECT 1 FROM d WHERE starts_with(d.path, p.path || '/'))) AS dirs_made, CAST(sum(size) FILTER (WHERE action IN ('upload', 'delta')) AS BIGINT) AS bytes_transferred, count(*) FILTER (WHERE action IN ('upload', 'delta', 'delete') AND path IN (SELECT path FROM d)) AS files_kept, 0::BIGINT AS errors FROM p"),
    "multipart_restored": (multipart_restored, f"WITH {X.SQL} SELECT path, CAST(strlen(new) AS BIGINT) AS size, sha256(new) AS digest FROM b WHERE strlen(new) > 0"),
    "chunk_stream": (lambda s, d: I.chunks(X.blobs(s, d, "new"), 1000).select("path", "chunk_index", F.col("offset").alias("chunk_offset"), F.sha2("data", 256).alias("digest")), f"WITH {X.SQL}, c AS (SELECT path, encode(new) AS c FROM b), k AS (SELECT path, c, unnest(range(0, (octet_length(c) + 999) // 1000)) AS i FROM c WHERE octet_length(c) > 0) SELECT path, CAST(i AS BIGINT) AS chunk_index, CAST(i * 1000 AS BIGINT) AS chunk_offset, sha256(c[i * 1000 + 1:i * 1000 + 1000]) AS digest FROM k"),
    "byte_ranges": (lambda s, d: X.blobs(s, d, "new").select("path", F.sha2(I.byte_range(F.col("content"), 10, 99), 256).alias("digest")), f"WITH {X.SQL} SELECT path, sha256(encode(new)[11:100]) AS digest FROM b"),
}


def queries() -> dict:
    return {name: query for name, (query, _) in CATALOG.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
