"""Fingerprints, keyed pseudonyms and purpose-bound tokens, from built-in hash functions."""

from __future__ import annotations

import hashlib
import hmac as _hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR, MISSING = "\x1f", "\x00"


def fingerprint(*parts: Column, more: Column | None = None) -> Column:
    """SHA-256 over parts, each followed by a separator; null is a byte of its own, so it differs from empty. ``more``: an array of
    further parts."""
    ended = lambda p: F.concat(F.coalesce(p.cast("string"), F.lit(MISSING)), F.lit(SEPARATOR))
    whole = [ended(p) for p in parts]
    if more is not None:
        whole.append(F.array_join(F.transform(more, ended), ""))
    return F.sha2(F.concat(*whole), 256)


def _pads(key: bytes) -> tuple[str, str]:
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string column, by its two nested digests."""
    inner, outer = _pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def pseudonym(key: bytes, address: Column, version: str) -> Column:
    """What stays of an address that is given up: keyed digest of its trimmed lower-case form under a version tag."""
    return hmac_sha256(key, F.concat(F.lit(version + ":"), F.lower(F.trim(address))))


def token(key: bytes, seed: Column, purpose: str, version: str) -> Column:
    """``seed.signature``; the signature is bound to version and purpose."""
    raw = F.unhex(hmac_sha256(key, F.concat(F.lit(f"{version}:{purpose}:"), seed)))
    url_safe = F.regexp_replace(F.translate(F.base64(raw), "+/", "-_"), "=+$", "")
    return F.concat(seed, F.lit("."), url_safe)


def verify_token(key: bytes, value: Column, purpose: str, version: str) -> Column:
    """The seed of a valid token, else null."""
    seed = F.substring_index(value, ".", 1)
    return F.when(token(key, seed, purpose, version) == value, seed)


def hmac_reference(key: bytes, message: str) -> str:
    """The same digest for a driver-side value."""
    return _hmac.new(key, message.encode(), hashlib.sha256).hexdigest()
