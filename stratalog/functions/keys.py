"""Storage keys, names of repositories and requests, page and configuration parameters, status lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formats.
PACKS, LOOSE = "objects/pack/", "objects/loose/"
HYDRATION = "pack-hydr-"
MOST_REF, MOST_PATH = 256, 4096
TOO_LARGE = 5 * 1024 * 1024


def repository(owner: Column, name: Column) -> Column:
    return F.concat_ws("/", owner, name)


def actor_prefix(actor: Column) -> Column:
    return F.concat(F.lit("do/"), actor)


def loose_key(prefix: Column, oid: Column) -> Column:
    return F.concat(prefix, F.lit("/" + LOOSE), oid)


def pack_key(prefix: Column, name: Column) -> Column:
    return F.concat(prefix, F.lit("/" + PACKS), name)


def index_of_pack(key: Column) -> Column:
    return F.regexp_replace(key, r"\.pack$", ".idx")


def pack_of_index(key: Column) -> Column:
    return F.regexp_replace(key, r"\.idx$", ".pack")


def kind(key: Column) -> Column:
    """pack, index or other."""
    return F.when(key.endswith(".pack"), "pack").when(key.endswith(".idx"), "index").otherwise("other")


def actor_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "^do/([^/]+)", 1), F.lit(""))


def is_hydration(key: Column) -> Column:
    return F.substring_index(key, "/", -1).startswith(HYDRATION)


def is_owner_or_repository(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]{1,100}$")


def is_request_ref(ref: Column) -> Column:
    """A reference as requests may name it: HEAD, an id, or letters, digits, dots, slashes, dashes and underscores."""
    return (F.length(ref) <= MOST_REF) & ref.rlike(r"^[A-Za-z0-9._/-]{1,256}$")


def is_request_path(path: Column) -> Column:
    return (F.length(path) <= MOST_PATH) & ~path.rlike(r"[\x00-\x1F]")


def is_deletion(oid: Column) -> Column:
    return oid.rlike("^0{40}$")


def default_branch(target: Column) -> Column:
    """The short name of HEAD's target; main without one."""
    return F.coalesce(F.regexp_replace(target, "^refs/(heads|tags)/", ""), F.lit("main"))


def clamped(value: Column, low: int, high) -> Column:
    """Rounded down and kept in [low, high]; ``low`` if it is no finite number."""
    number = F.try_to_number(value, F.lit("S999999999.999999")).cast("double")
    high = high if isinstance(high, Column) else F.lit(high)
    return F.coalesce(F.greatest(F.lit(low), F.least(high, F.floor(number))), F.lit(low)).cast("long")


def page_bounds(page: Column, size: Column, default: int = 25, low: int = 5, high: int = 100) -> Column:
    """struct(page, size, offset): a page from 0, and its size within bounds, ``default`` if it is none."""
    at, n = F.greatest(F.coalesce(page, F.lit(0)), F.lit(0)), F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(size, F.lit(default))))
    return F.struct(at.cast("long").alias("page"), n.cast("long").alias("size"), (at * n).cast("long").alias("offset"))


def too_large(stored: Column, actual: Column) -> Column:
    """Whether a blob is shown by its size only: by ten times its stored size, or by its actual one."""
    return (stored * 10 > TOO_LARGE) | (actual > TOO_LARGE)


def cache_key(path: Column, params: dict[str, Column]) -> Column:
    """A path with its parameters; empty ones are dropped."""
    pairs = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(k + "="), F.url_encode(v))) for k, v in params.items()]
    query = F.concat_ws("&", *pairs)
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def hydration_status(running: Column, stage: Column, queued: Column, packs: Column, hydration_packs: Column) -> Column:
    return (
        F.when(running, F.concat(F.lit("Running: "), F.coalesce(stage, F.lit("unknown"))))
        .when(stage == "done", "Completed")
        .when(queued > 0, F.concat(F.lit("Queued ("), queued.cast("string"), F.lit(" pending)")))
        .when((packs > 0) & (hydration_packs > 0), "Completed (hydration packs present)")
        .otherwise("Not Started")
    )
