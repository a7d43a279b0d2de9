"""Paths as bytes: checks, text forms and escapes at the edge of the engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(text: str) -> int:
    """30d -> milliseconds; a positive whole number and one of s, m, h, d, w."""
    found = re.fullmatch(r"([0-9]+)([smhdw])", text)
    if not found or not int(found[1]):
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * _UNITS[found[2]]


def base64url(column) -> Column:
    return F.translate(F.regexp_replace(F.base64(column), "=+$", ""), "+/", "-_")


def text_or_base64(encoding: str, data: str) -> Column:
    """The two output forms of a path: text when it says it is UTF-8 and is, else base64url."""
    text = F.try_validate_utf8(F.col(data).cast("string"))
    fine = (F.col(encoding) == "utf8") & text.isNotNull()
    return F.struct(F.when(fine, text).alias("text"), F.when(~fine, base64url(F.col(data))).alias("base64"))


def is_normal(path: str) -> Column:
    """Relative, without NUL, and without empty, . or .. components."""
    text = F.col(path)
    parts = F.split(text, "/")
    return (F.length(text) > 0) & ~text.contains("\0") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def entity_key(*columns: str) -> Column:
    """Length-prefixed parts, eight bytes big-endian each, as one binary key."""
    parts = []
    for c in columns:
        data = F.col(c).cast("binary")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(data)), 16, "0")), data]
    return F.concat(*parts)


def shown(text: str) -> str:
    """Control characters and invalid bytes escaped for a terminal."""
    return "".join(c if c.isprintable() else c.encode("unicode_escape").decode() if ord(c) < 0xDC80 or ord(c) > 0xDCFF else f"\\x{ord(c) - 0xDC00:02x}" for c in text)


def manifest_line(path: bytes) -> str:
    """A path for a script manifest: backslash, line feed, carriage return and tab are escaped."""
    return path.decode("utf-8", "surrogateescape").replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def domain_parts(column: str) -> tuple[Column, Column]:
    """kind and id of kind:id, cut at the first colon."""
    return F.split_part(F.col(column), F.lit(":"), F.lit(1)), F.expr(f"substr({column}, instr({column}, ':') + 1)")
