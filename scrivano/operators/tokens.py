"""Signed tokens of downloads: a body and its keyed digest, made and checked as Column expressions.

HMAC-SHA256 is two digests of padded keys, so no user function is needed.  A token is base64url(body).base64url(signature).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of HMAC: block size and pads.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C


def _pads(secret: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(secret).digest() if len(secret) > BLOCK else secret).ljust(BLOCK, b"\0")
    return bytes(b ^ INNER for b in key), bytes(b ^ OUTER for b in key)


def signature(body: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a binary column."""
    inner, outer = (F.lit(bytearray(p)) for p in _pads(secret))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256))


def _url(data: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(data), "+/", "-_"), "=+$", "")


def signed(session: Column, artifact: Column, expires: Column, secret: bytes) -> Column:
    """A token for an artifact of a session until expires (seconds)."""
    body = F.to_json(F.struct(artifact.alias("artifact"), expires.cast("long").alias("exp"), session.alias("session"))).cast("binary")
    return F.concat_ws(".", _url(body), _url(signature(body, secret)))


def checked(token: Column, now: Column, secret: bytes) -> Column:
    """struct(session, artifact, fault): fault is malformed, bad_signature, expired or null; the others are null with a fault."""
    parts = F.split(token, "\\.")
    raw = F.translate(F.get(parts, F.lit(0)), "-_", "+/")
    body = F.try_to_binary(F.rpad(raw, F.length(raw) + (4 - F.length(raw) % 4) % 4, F.lit("=")), F.lit("base64"))
    fields = F.from_json(body.cast("string"), "artifact string, exp long, session string")
    fault = (
        F.when((F.size(parts) != 2) | body.isNull(), "malformed").when(F.get(parts, F.lit(1)) != _url(signature(body, secret)), "bad_signature")
        .when(fields["exp"].isNull(), "malformed").when(fields["exp"] < now, "expired")
    )
    good = lambda f: F.when(fault.isNull(), fields[f])
    return F.when(token.isNull(), F.struct(F.lit(None).cast("string").alias("session"), F.lit(None).cast("string").alias("artifact"), F.lit("malformed").alias("fault"))).otherwise(
        F.struct(good("session").alias("session"), good("artifact").alias("artifact"), fault.alias("fault"))
    )
