"""256-bit picture signatures: well-formedness in Spark, distances in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the picture match: Hamming distance at most, of so many bits, at a quality of at least.
RADIUS, BITS, QUALITY = 31, 256, 50


def well_formed(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def packed(value: Column) -> Column:
    """The 32 bytes of a well-formed hash; letter case is gone."""
    return F.unhex(value)


def words(signatures: list[bytes]) -> np.ndarray:
    """(n, 4) unsigned 64-bit words of packed signatures, most significant bits first."""
    return np.frombuffer(b"".join(signatures), ">u8").astype(np.uint64).reshape(-1, 4)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances row by row."""
    total = np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int16)
    for k in range(1, a.shape[1]):
        total += np.bitwise_count(a[:, k] ^ b[:, k])
    return total
