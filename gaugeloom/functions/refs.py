"""References to single rows, and text as it is shown."""

from __future__ import annotations

import base64
import json
import zlib

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

VERSION, MOST_BYTES = 1, 8_192


def reference(section: str, segment: Column, ts: Column, type_id: Column, ordinal: Column, identity: list[Column]) -> Column:
    """A URL-safe text that names one stored row: base64 of a JSON array and its checksum, without padding."""
    body = F.to_json(F.array(F.lit(str(VERSION)), F.lit(section), *[F.coalesce(c.cast("string"), F.lit("")) for c in (segment, ts, type_id, ordinal, *identity)]))
    raw = F.concat(F.encode(body, "UTF-8"), F.unhex(F.lpad(F.hex(F.crc32(body)), 8, "0")))
    return F.translate(F.replace(F.base64(raw), F.lit("\r\n"), F.lit("")), "+/=", "-_")


def parse(text: str) -> dict:
    """What a reference names; a ValueError if it is too long, damaged or not in the form that reference() gives."""
    if len(text) > MOST_BYTES:
        raise ValueError("the reference is too long")
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        fields = json.loads(raw[:-4])
    except ValueError as e:
        raise ValueError("no reference") from e
    if zlib.crc32(raw[:-4]) != int.from_bytes(raw[-4:], "big") or fields[0] != str(VERSION) or base64.urlsafe_b64encode(raw).decode().rstrip("=") != text:
        raise ValueError("the reference is damaged")
    return {"section": fields[1], "segment": int(fields[2]), "ts": int(fields[3]), "type_id": int(fields[4]), "ordinal": int(fields[5]), "identity": fields[6:]}


def shortened(text: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis if some are left out."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def locate(df: DataFrame, type_id: int, ordinal: int) -> Row:
    """The row that a locator names; a LookupError unless it is exactly one."""
    found = df.where((F.col("type_id") == type_id) & (F.col("row_ordinal") == ordinal)).head(2)
    if len(found) != 1:
        raise LookupError("no row has this locator" if not found else "several rows have this locator")
    return found[0]
