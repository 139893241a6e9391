"""Column functions over sizes, locations, keys, paths and provider endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import KIB, MAX_BLOCK, MIN_BLOCK, SIDECAR

# Storage providers, their aliases, regions and endpoint patterns ({r}: the region), in the
# order of their names. A pattern without {r} is the reason why there is no endpoint.
PROVIDERS: tuple[tuple[str, tuple[str, ...], tuple[str, ...], str], ...] = (
    ("backblaze", ("backblaze", "b2"), ("us-west-000", "us-west-001", "us-west-002", "us-west-004", "eu-central-003"), "https://s3.{r}.backblazeb2.com"),
    ("cloudflare", ("cloudflare", "r2"), ("auto",), "an account's own endpoint is needed"),
    ("contabo", ("contabo",), ("eu", "us-central", "sin", "aus", "uk", "jpn"), "https://{r}.contabostorage.com"),
    ("digitalocean", ("digitalocean", "do", "spaces"), ("nyc3", "sfo3", "ams3", "sgp1", "fra1", "syd1"), "https://{r}.digitaloceanspaces.com"),
    ("exoscale", ("exoscale", "exo"), ("ch-gva-2", "ch-dk-2", "de-fra-1", "de-muc-1", "at-vie-1", "at-vie-2", "bg-sof-1"), "https://sos-{r}.exo.io"),
    ("hetzner", ("hetzner", "htz"), ("fsn1", "nbg1", "hel1"), "https://{r}.your-objectstorage.com"),
    ("idrive", ("idrive", "e2"), ("us-or", "us-va", "us-la", "us-phx", "us-dal", "eu-fra", "eu-lon", "eu-par", "ap-sin"), "https://{r}.e2.idrivesync.com"),
    ("linode", ("linode", "akamai"), ("us-east-1", "us-southeast-1", "us-ord-1", "eu-central-1", "ap-south-1", "us-iad-1", "fr-par-1", "se-sto-1", "in-maa-1", "jp-osa-1", "it-mil-1", "us-lax-1", "us-mia-1", "id-cgk-1", "br-gru-1"), "https://{r}.linodeobjects.com"),
    ("minio", ("minio",), (), "a server's own endpoint is needed"),
    ("ovh", ("ovh", "ovhcloud"), ("gra", "sbg", "bhs", "de", "uk", "waw", "rbx-hdd", "rbx-ssd"), "https://s3.{r}.cloud.ovh.net"),
    ("scaleway", ("scaleway", "scw"), ("fr-par", "nl-ams", "pl-waw"), "https://s3.{r}.scw.cloud"),
    ("vultr", ("vultr",), ("ewr1", "ord1", "dfw1", "sea1", "lax1", "atl1", "ams1", "lhr1", "fra1", "sjc1", "syd1", "jnb1", "sgp1", "nrt1", "blr1", "del1"), "https://{r}.vultrobjects.com"),
    ("wasabi", ("wasabi",), ("us-east-1", "us-east-2", "us-central-1", "us-west-1", "eu-central-1", "eu-central-2", "eu-west-1", "eu-west-2", "ap-northeast-1", "ap-northeast-2", "ap-southeast-1", "ap-southeast-2", "ca-central-1"), "https://s3.{r}.wasabisys.com"),
)
# Storage classes by name.
STORAGE_CLASSES = ("STANDARD", "REDUCED_REDUNDANCY", "STANDARD_IA", "ONEZONE_IA", "INTELLIGENT_TIERING", "GLACIER", "DEEP_ARCHIVE", "GLACIER_IR", "OUTPOSTS", "SNOW", "EXPRESS_ONEZONE")


def parse_size(text: Column) -> Column:
    """Bytes of "10", "4K", "2MB", ...; an empty text is 0 and anything else null."""
    clean = F.upper(F.trim(text))
    number = F.regexp_extract(clean, r"^(\d+)(?:([KMGT])B?)?$", 1)
    unit = F.regexp_extract(clean, r"^(\d+)(?:([KMGT])B?)?$", 2)
    times = F.when(unit == "K", KIB).when(unit == "M", KIB**2).when(unit == "G", KIB**3).when(unit == "T", KIB**4).otherwise(1)
    return F.when(clean == "", F.lit(0).cast("long")).otherwise(number.try_cast("long") * times.cast("long"))


def block_size(kib: Column) -> Column:
    return F.greatest(F.lit(MIN_BLOCK), F.least(F.lit(MAX_BLOCK), kib * KIB)).cast("long")


def location(raw: Column) -> Column:
    """struct(scheme, container, user, host, path) of a location. A scheme needs "://"; a text with
    ":" that is no path is host:path; the rest are local paths."""
    none = F.lit(None).cast("string")
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z0-9]+)://", 1))
    named = F.when(scheme == "azure", "az").otherwise(scheme)
    rest = F.regexp_replace(raw, r"^[A-Za-z0-9]+://", "")
    container = F.regexp_extract(rest, r"^([^/]*)", 1)
    key = F.regexp_replace(F.substring(rest, F.length(container) + 1, F.length(rest)), "^/+", "")
    make = lambda s, c, u, h, p: F.struct(s.alias("scheme"), c.alias("container"), u.alias("user"), h.alias("host"), p.alias("path"))
    remote = (F.instr(raw, "://") == 0) & (F.instr(raw, ":") > 0) & ~raw.startswith("/")
    before = F.substring_index(raw, ":", 1)
    user = F.when(F.instr(before, "@") > 0, F.substring_index(before, "@", 1))
    host = F.regexp_replace(before, "^[^@]*@", "")
    return (
        F.when(remote, make(F.lit("ssh"), none, user, host, F.regexp_replace(raw, "^[^:]*:", "")))
        .when(named.isin("s3", "gs", "az"), make(named, container, none, none, key))
        .when(named == "file", make(F.lit("file"), none, none, none, rest))
        .otherwise(make(F.lit("file"), none, none, none, raw))
    )


def to_uri(where: Column) -> Column:
    at = F.when(where["user"].isNotNull(), F.concat(where["user"], F.lit("@"))).otherwise("")
    tail = F.when(where["path"] == "", "").otherwise(F.concat(F.lit("/"), where["path"]))
    return F.when(where["scheme"] == "ssh", F.concat(at, where["host"], F.lit(":"), where["path"])).when(where["scheme"] == "file", where["path"]).otherwise(F.concat(where["scheme"], F.lit("://"), where["container"], tail))


def resolve_key(prefix: Column, path: Column) -> Column:
    """prefix/path with exactly one slash between them."""
    return F.when(prefix == "", path).otherwise(F.concat(F.regexp_replace(prefix, "/$", ""), F.lit("/"), path))


def strip_prefix(prefix: Column, key: Column) -> Column:
    """A key without "prefix/", else without "prefix", else as it is."""
    folder = F.concat(F.regexp_replace(prefix, "/$", ""), F.lit("/"))
    cut = lambda p: F.substring(key, F.length(p) + 1, F.length(key))
    return F.when(prefix == "", key).when(F.startswith(key, folder), cut(folder)).when(F.startswith(key, prefix), cut(prefix)).otherwise(key)


def sidecar_path(path: Column) -> Column:
    return F.concat(path, F.lit(SIDECAR))


def backup_path(path: Column, directory: str | None = None, suffix: str = "~") -> Column:
    if directory is None:
        return F.concat(path, F.lit(suffix))
    return F.concat(F.lit(directory.rstrip("/") + "/"), path, F.lit(suffix))


def is_backup(path: Column, suffix: str = "~") -> Column:
    return F.endswith(path, F.lit(suffix))


def parent(path: Column) -> Column:
    """The directory of a path; null at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def join_path(base: Column, name: Column) -> Column:
    return F.when(base == "", name).otherwise(F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), name))


def block_id(number: Column) -> Column:
    """Base64 of "block-" and six digits."""
    return F.base64(F.encode(F.concat(F.lit("block-"), F.lpad(number.cast("string"), 6, "0")), "utf-8"))


def storage_class(name: Column) -> Column:
    """A known class in upper case; any other text is STANDARD."""
    return F.when(F.upper(name).isin(*STORAGE_CLASSES), F.upper(name)).otherwise("STANDARD")


def shell_quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def supports_multipart(scheme: Column) -> Column:
    return scheme.isin("s3", "gs", "az")


def supports_part_copy(scheme: Column) -> Column:
    return scheme.isin("s3", "az")


def providers(spark: SparkSession) -> DataFrame:
    """provider, alias, region, endpoint: one row per alias and region; endpoint is null where each
    account or server has its own."""
    rows = [(name, alias, region, url.format(r=region) if "{r}" in url else None) for name, aliases, regions, url in PROVIDERS for alias in aliases for region in regions]
    return spark.createDataFrame(rows, "provider string, alias string, region string, endpoint string")


def endpoints(wanted: DataFrame) -> DataFrame:
    """provider and region of each wanted row with its endpoint, or the reason why there is none.

    The provider tables are constants of some 150 rows, so they are broadcast.
    """
    spark = wanted.sparkSession
    known = providers(spark).select(F.col("alias").alias("_key"), "region", "endpoint", F.lit(True).alias("_there"))
    reasons = [(alias, None if "{r}" in url else url, not regions) for _, aliases, regions, url in PROVIDERS for alias in aliases]
    named = spark.createDataFrame(reasons, "_key string, _own string, _any boolean")
    out = wanted.withColumn("_key", F.lower("provider")).join(F.broadcast(known), ["_key", "region"], "left").join(F.broadcast(named), "_key", "left")
    problem = F.when(F.col("_any").isNull(), "unknown provider").when(F.col("_there").isNull() & ~F.col("_any"), "unknown region").otherwise(F.col("_own"))
    return out.select("provider", "region", "endpoint", problem.alias("problem"))
