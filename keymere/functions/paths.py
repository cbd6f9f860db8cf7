"""Paths of the blob file system: elements joined by slashes, the first of which is the container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elements(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def container(path: Column) -> Column:
    return F.get(elements(path), F.lit(0))


def parent(path: Column) -> Column:
    e = elements(path)
    return F.array_join(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), "/")


def identifier(path: Column) -> Column:
    return F.element_at(elements(path), -1)


def join(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "/")


def file_stem(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*?)(?:\.[^.]*)?$", 1)


def file_type(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([^.]*)$", 1)


def blob_number(name: Column, file: str) -> Column:
    """The number of a blob ``file.N``; null for other names."""
    prefix = "".join("\\" + c if not c.isalnum() else c for c in file)
    number = F.regexp_extract(name, f"^{prefix}\\.(\\d+)$", 1)
    return F.when(number != "", number.cast("long"))


def children(paths: DataFrame, path_col: str, folder: str) -> DataFrame:
    """Immediate children of a folder: name and whether it is a folder."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    below = paths.where(F.col(path_col).startswith(prefix)).select(F.split(F.substring(path_col, len(prefix) + 1, 1 << 30), "/").alias("e"))
    return below.where("e[0] <> ''").groupBy(F.col("e")[0].alias("name")).agg(F.max(F.size("e") > 1).alias("is_folder"))


#: Fixed rules of the stores: pattern, least and most characters of a container's name.
CONTAINER_RULES: dict[str, tuple[str, int, int]] = {
    "s3": (r"^[a-z0-9][a-z0-9.-]*$", 3, 63),
    "azure": (r"^[a-z0-9](-?[a-z0-9])*$", 3, 63),
    "oci": (r"^[a-z0-9]([a-z0-9._-]*[a-z0-9])?$", 1, 256),
    "kafka": (r"^[A-Za-z0-9._-]+$", 1, 249),
}
#: Fixed: names that look like an address of the internet protocol.
_ADDRESS = r"^((0|1\d?\d?|2[0-4]?\d?|25[0-5]?|[3-9]\d?)\.){3}(0|1\d?\d?|2[0-4]?\d?|25[0-5]?|[3-9]\d?)$"
#: Fixed: the most characters of a blob's key in the stores that limit it, and characters that one of them reserves.
KEY_CHARACTERS, RESERVED = 1024, r'[<>:"|?*]'
#: Fixed: letters before names of topics that would be reserved.
TOPIC_PREFIX = "ns"


def valid_container(name: Column, store: str) -> Column:
    pattern, least, most = CONTAINER_RULES[store]
    ok = name.rlike(pattern) & F.length(name).between(least, most)
    if store == "s3":
        ok &= ~name.contains("..") & ~name.contains(".-") & ~name.contains("-.") & ~name.endswith("-") & ~name.startswith("xn--") & ~name.rlike(_ADDRESS)
    if store == "oci":
        ok &= ~name.contains("..")
    if store == "kafka":
        ok &= ~name.isin(".", "..")
    return F.coalesce(ok, F.lit(False))


def valid_key(key: Column, store: str) -> Column:
    """Whether a blob may have this key (the path without its container)."""
    ok = (F.length(key) <= KEY_CHARACTERS) & ~key.contains("\0")
    if store == "azure":
        ok &= ~key.rlike(r"[\x00-\x1f\x7f-\u009f]") & ~key.rlike(RESERVED) & ~key.rlike(r"[. ]$") & ~key.startswith(" ")
    if store == "oci":
        ok &= (key != "") & ~key.isin(".", "..") & (key == F.regexp_replace(key, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(ok, F.lit(False))


def topic_name(path: Column) -> Column:
    """The topic that holds a path's blobs: separators and other characters become underscores, and the end of long names is kept."""
    name = F.regexp_replace(F.regexp_replace(path, "/", "_"), r"[^a-zA-Z0-9._-]", "_")
    name = F.when(name.startswith("__"), F.concat(F.lit(TOPIC_PREFIX), name)).when(name.isin(".", ".."), F.concat(F.lit(TOPIC_PREFIX + "_"), name)).otherwise(name)
    most = CONTAINER_RULES["kafka"][2]
    return F.when(F.length(name) > most, F.substring(name, -most, most)).otherwise(name)


def index_topic(topic: Column) -> Column:
    return F.concat(F.lit("__"), topic, F.lit("_index"))


def is_valid_path(path: Column, store: str) -> Column:
    """Container and key of a path."""
    key = F.array_join(F.slice(elements(path), F.lit(2), F.greatest(F.size(elements(path)) - 1, F.lit(0))), "/")
    return valid_container(container(path), store) & ((key == "") | valid_key(key, store))
