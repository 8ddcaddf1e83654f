"""Identities and seeds as columns (HASH01-08); each is the same in every engine that has SHA-256."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modulus of the seed formulas.
PRIME = 2147483647


def stable_hash(value: Column) -> Column:
    """HASH01: the first 63 bits of SHA-256 after the first; null counts as the empty text."""
    digest = F.sha2(F.coalesce(value.cast("string"), F.lit("")), 256)
    first = F.conv(F.substring(digest, 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(7))
    return F.conv(F.concat(F.hex(first), F.substring(digest, 2, 15)), 16, 10).cast("long")


def stable_hash_of(value: object) -> int:
    """HASH01 of a value on the driver."""
    raw = hashlib.sha256(("" if value is None else str(value)).encode()).digest()
    return int.from_bytes(raw[:8], "big") & ((1 << 63) - 1)


def example_id(dataset: Column, split: Column, clip: Column, given: Column, given_is_text: bool = True) -> Column:
    """HASH02: of ``dataset::split::clip`` if all are there, else the given number, or the given text's hash."""
    whole = F.when(dataset.isNotNull() & split.isNotNull() & clip.isNotNull(), stable_hash(F.concat_ws("::", dataset, split, clip)))
    own = F.when(given.isNotNull(), stable_hash(given)) if given_is_text else F.when(given >= 0, given.cast("long"))
    return F.coalesce(whole, own)


def view_key(metadata_json: Column) -> Column:
    """HASH03: of canonical JSON, never 0."""
    h = stable_hash(metadata_json)
    return F.when(h == 0, F.lit(1)).otherwise(h)


def canonical_json(value: object) -> str:
    """HASH04: sorted keys, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest_of(value: object) -> str:
    """HASH04"""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def identity(name: str, version: str, descriptor: object) -> str:
    """HASH05: ``name@version:sha256:digest`` of what it does."""
    return f"{name}@{version}:sha256:{digest_of(descriptor)}"


def stack_identity(steps: list[tuple[str, float]]) -> str:
    """HASH05: of ordered (identity, strength) pairs."""
    return digest_of([[i, s] for i, s in steps])


def image_seed(seed: int, position: Column, salt: int = 0) -> tuple[Column, Column]:
    """HASH06: the two seeds of a row for an image corruption. |seed| must be below 2**32."""
    if abs(seed) >= 1 << 32:
        raise ValueError("the seed must be below 2**32")
    return F.pmod(F.lit(seed).cast("long"), F.lit(PRIME)), F.pmod(F.lit(seed * 1103515245) + position.cast("long") + F.lit(salt), F.lit(PRIME))


def audio_seed(first: int, second: int, position: Column, salt: int = 0) -> tuple[Column, Column]:
    """HASH06 for a waveform."""
    return F.lit(first).cast("long"), F.pmod(F.lit(second).cast("long") + position.cast("long") + F.lit(salt), F.lit(PRIME))


def epoch_seed(schema: str, run_seed: int, epoch: int, view: int) -> int:
    """HASH07: of the canonical list of what names an epoch."""
    return stable_hash_of(canonical_json([schema, run_seed, epoch, view]))


def draw(seed: int, *of: Column | str | int) -> Column:
    """HASH08: a number in [0, 1) that depends on the seed and the given columns alone."""
    parts = [c if isinstance(c, Column) else F.lit(c) for c in of]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") / float(1 << 53)


def fingerprint(metadata_json: Column) -> list[Column]:
    """JOIN05: SHA-256 as four signed 64-bit numbers."""
    digest = F.sha2(metadata_json, 256)
    return [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long") for k in range(4)]
