"""Small request functions as column expressions: authorization headers, media types, fetch lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extension to media type; all others are octet streams.
MEDIA = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
    "ico": "image/x-icon", "svg": "image/svg+xml", "pdf": "application/pdf", "txt": "text/plain; charset=utf-8",
}


def media_type(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in sorted(MEDIA.items()) for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(name, ".", -1))), F.lit("application/octet-stream"))


def basic_credentials(header: Column) -> Column:
    """struct(user, password) of a Basic header, split at the first colon; null for anything else."""
    raw = F.try_to_binary(F.regexp_extract(header, r"^Basic\s+(\S+)$", 1), F.lit("base64"))
    plain = F.decode(raw, "UTF-8")
    colon = F.instr(plain, ":")
    user = F.when(colon > 0, F.substring(plain, F.lit(1), colon - 1)).otherwise(plain)
    password = F.when(colon > 0, F.substring(plain, colon + 1, F.length(plain))).otherwise("")
    return F.when(header.startswith("Basic ") & raw.isNotNull(), F.struct(user.alias("user"), password.alias("password")))


def bearer_token(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, r"^Bearer\s+(\S+)$", 1), F.lit(""))


def fetch_request(lines: Column) -> Column:
    """struct(wants, haves, done) of a fetch request's lines: wants once each, haves as they come."""
    take = lambda key: F.transform(F.filter(lines, lambda x: x.startswith(key + " ")), lambda x: F.substring(x, len(key) + 2, 40))
    return F.struct(F.array_distinct(take("want")).alias("wants"), take("have").alias("haves"), F.array_contains(lines, "done").alias("done"))
