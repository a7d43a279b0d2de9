"""Keyset cursors: opaque text that holds the snapshot, the query and the last key."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


class StaleCursor(ValueError):
    """The snapshot has changed since the cursor was made."""


class InvalidCursor(ValueError):
    """The cursor belongs to another query, or is damaged."""


def query_hash(request) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()


def encode(archive: str, revision: int, request, as_of: int, key: list) -> str:
    body = json.dumps({"a": archive, "r": revision, "q": query_hash(request), "t": as_of, "k": [x.hex() if isinstance(x, bytes | bytearray) else x for x in key], "b": [isinstance(x, bytes | bytearray) for x in key]})
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode(text: str, archive: str, revision: int, request, as_of: int) -> list:
    try:
        body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        key = [bytes.fromhex(x) if b else x for x, b in zip(body["k"], body["b"], strict=True)]
        found = (body["a"], body["r"]), (body["q"], body["t"])
    except (ValueError, KeyError, TypeError) as error:
        raise InvalidCursor("not a cursor") from error
    if found[0] != (archive, revision):
        raise StaleCursor("the archive has changed")
    if found[1] != (query_hash(request), as_of):
        raise InvalidCursor("the cursor belongs to another query")
    return key


def after(columns: list[str], key: list) -> Column:
    """Rows behind a key, as a comparison of whole rows."""
    return F.struct(*columns) > F.struct(*[F.lit(x) for x in key])
