"""Content keys and location logs of a git annex, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: backends whose keys are understood
BACKENDS = ("SHA256", "SHA256E", "SHA512", "SHA512E", "SHA1", "SHA1E", "MD5", "MD5E", "BLAKE2B", "BLAKE2BP")


def parse_key(key: str) -> Column:
    """BACKEND-sSIZE-...--NAME -> struct of backend, size, sha256, sha512, supported. The E backends carry an extension behind the digest."""
    raw = F.col(key)
    fields = F.split(F.split_part(raw, F.lit("--"), F.lit(1)), "-")
    marked = raw.contains("--")
    name = F.when(marked, F.expr(f"substr({key}, instr({key}, '--') + 2)")).otherwise("")
    backend = F.element_at(fields, 1)
    sizes = F.filter(F.slice(fields, 2, 64), lambda f: f.startswith("s"))
    hexes = lambda n, whole: F.regexp_extract(name, f"^([0-9a-f]{{{n}}}){'$' if whole else ''}", 1)
    pick = lambda plain, n: F.nullif(F.when(backend == plain, hexes(n, True)).when(backend == f"{plain}E", hexes(n, False)), F.lit(""))
    return F.struct(
        backend.alias("backend"), F.try_element_at(sizes, F.lit(1)).substr(2, 30).try_cast("bigint").alias("size"), pick("SHA256", 64).alias("sha256"), pick("SHA512", 128).alias("sha512"),
        (marked & backend.isin(*BACKENDS)).alias("supported"),
    )


def key_of_pointer(mode: str, blob: str) -> Column:
    """The key that a tree entry points to: a link whose last two components agree, or a pointer file."""
    parts = F.split(blob, "/")
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    link = F.when(F.col(blob).contains("annex/objects/") & (last == before), last)
    pointer = F.nullif(F.regexp_extract(blob, r"^/annex/objects/([^\n]+)", 1), F.lit(""))
    return F.when(F.col(mode) == "120000", link).otherwise(pointer)


def location_states(logs: DataFrame) -> DataFrame:
    """logs (key, blob) -> key, uuid, state. The last line of a uuid counts, in the order of the file, whatever its time."""
    lines = logs.select("key", F.posexplode(F.split("blob", "\n")).alias("at", "line")).filter(F.col("line") != "")
    fields = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    checked = F.when(F.size(fields) != 3, F.raise_error(F.concat(F.lit("malformed location log of "), "key")).cast("array<string>")).otherwise(fields)
    rows = lines.select("key", "at", checked.alias("f"))
    flag = F.col("f")[1]
    state = F.when(flag == "1", "present").when(flag == "0", "missing").otherwise("unknown")
    return rows.groupBy("key", F.col("f")[2].alias("uuid")).agg(F.max_by(state, "at").alias("state"))
