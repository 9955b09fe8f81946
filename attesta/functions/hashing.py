"""Digests, perceptual-hash distance and median bits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def well_formed_hash(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{64}$")


def hamming(a: Column, b: Column) -> Column:
    """Hamming distance of two hashes of 64 hex digits; null where one is malformed."""
    total = F.lit(0)
    for k in range(4):
        words = [F.conv(F.substring(x, 16 * k + 1, 16), 16, -10).cast("long") for x in (a, b)]
        total = total + F.bit_count(words[0].bitwiseXOR(words[1]))
    return F.when(well_formed_hash(a) & well_formed_hash(b), total)


def closest(a: Column, b: Column) -> Column:
    """Least distance between any well-formed hash of one array and any of the other; null where there is none."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: hamming(x, y))))
    return F.array_min(F.filter(pairs, lambda d: d.isNotNull()))


def comparison(a: Column, a_quality: Column, b: Column, b_quality: Column) -> Column:
    """``match``, ``differs``, ``low_quality`` or ``unavailable``, for arrays of hashes."""
    distance = closest(a, b)
    return F.when(distance.isNull(), "unavailable").when((a_quality < 50) | (b_quality < 50), "low_quality").when(distance <= 31, "match").otherwise("differs")


def median_bits(values: Column, size: int) -> Column:
    """Bits, as 0 and 1, of the values that exceed the lower median of ``size`` values."""
    median = F.element_at(F.array_sort(values), size // 2)
    return F.transform(values, lambda v: (v > median).cast("int"))


def trust_version(day: Column, pem: Column) -> Column:
    """Version of a certificate bundle: its date and twelve digits of its digest."""
    return F.concat(day, F.lit("-"), F.substring(F.sha2(pem, 256), 1, 12))


def certificate_count(pem: Column) -> Column:
    return F.size(F.split(pem, "-----BEGIN CERTIFICATE-----")) - 1
