"""Hashing and encrypting columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_value(c: Column, salt: str = "") -> Column:
    """SHA-256 of the value's text in hex, HMAC-SHA-256 with a salt; null stays null."""
    data = c.cast("string").cast("binary")
    if not salt:
        return F.sha2(data, 256)
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda n: F.lit(bytes(b ^ n for b in key))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), data), 256))), 256)


def key_of(passphrase: str) -> bytes:
    """A 32-byte key from a passphrase."""
    return hashlib.sha256(passphrase.encode()).digest()


def encrypt(c: Column, key: bytes) -> Column:
    """AES-256-GCM in base64: a random 12-byte nonce, the ciphertext, the tag; null stays null."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    return F.base64(F.aes_encrypt(c.cast("string"), F.lit(key), F.lit("GCM")))


def decrypt(c: Column, key: bytes) -> Column:
    """The text that :func:`encrypt` was given."""
    return F.aes_decrypt(F.unbase64(c), F.lit(key), F.lit("GCM")).cast("string")
