"""What the first bytes of a file tell: dimensions, animation, certificates, placeholders; in Arrow batches, never a failure."""

from __future__ import annotations

import base64
import binascii
import hashlib
import ipaddress
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from attesta.functions.dictionaries import LIMITS
from attesta.operators.metadata import jpeg_segments, png_chunks, riff_chunks

#: The brands of image sequences, and how far into a file they are looked for.
SEQUENCE_BRANDS, BRANDS_WITHIN = (b"avis", b"msf1", b"hevc", b"hevx"), 64
#: What stands before a signature's placeholder, and its length.
SIGNATURE_PREFIX, PLACEHOLDER = b"\x58\x40", 64
_PEM = re.compile(r"-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----", re.DOTALL)


def size_of(data: bytes) -> tuple[int, int] | None:
    """(width, height) by the header alone, None where it can't be read."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return struct.unpack_from(">LL", data, 16)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack_from("<HH", data, 6)
        if data[:2] == b"\xff\xd8":
            frames = (d for m, d in jpeg_segments(data) if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC))
            height, width = struct.unpack_from(">HH", next(frames), 1)
            return width, height
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            for kind, d in riff_chunks(data):
                if kind == b"VP8X":
                    return 1 + int.from_bytes(d[4:7], "little"), 1 + int.from_bytes(d[7:10], "little")
                if kind == b"VP8L" and d[:1] == b"\x2f":
                    bits = int.from_bytes(d[1:5], "little")
                    return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
                if kind == b"VP8 " and d[3:6] == b"\x9d\x01\x2a":
                    return tuple(v & 0x3FFF for v in struct.unpack_from("<HH", d, 6))
        if data[:2] == b"BM":
            width, height = struct.unpack_from("<ll", data, 18)
            return width, abs(height)
    except (struct.error, StopIteration):
        pass
    return None


def animated(data: bytes, form: str) -> bool:
    """Whether a file of a format holds, or may hold, several frames."""
    if form == "gif":
        return True
    if form == "png":
        return data[:8] == b"\x89PNG\r\n\x1a\n" and any(k == b"acTL" for k, _ in png_chunks(data))
    if form == "webp":
        return data[:4] == b"RIFF" and any(k == b"VP8X" and d[:1] and bool(d[0] & 2) for k, d in riff_chunks(data))
    return form in ("avif", "heic", "heif") and any(b in data[:BRANDS_WITHIN] for b in SEQUENCE_BRANDS)


_SIZE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("error", StringType())])


@F.pandas_udf(_SIZE)
def dimensions(content: pd.Series) -> pd.DataFrame:
    """``width``, ``height`` and ``error`` (``limit_exceeded`` beyond the pixel limit) of files; nulls where no header can be read."""
    sizes = [size_of(c) if c is not None else None for c in content]
    over = [s is not None and s[0] * s[1] > LIMITS["pixels"] for s in sizes]
    rows = [(None, None, "limit_exceeded") if o else (*(s or (None, None)), None) for s, o in zip(sizes, over)]
    return pd.DataFrame(rows, columns=["width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})


@F.pandas_udf(BooleanType())
def is_animation(content: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([animated(c or b"", f or "") for c, f in zip(content, form)])


def _routable(host: str | None) -> bool | None:
    try:
        ip = ipaddress.ip_address(host or "")
    except ValueError:
        return None
    if ip.version == 6 and ip.ipv4_mapped is not None:
        ip = ip.ipv4_mapped
    closed = ("0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3" if ip.version == 4 else "::/127 ff00::/8 fc00::/7 fe80::/10 2001:db8::/32").split()
    return not any(ip in ipaddress.ip_network(n) for n in closed)


@F.pandas_udf(BooleanType())
def routable(hosts: pd.Series) -> pd.Series:
    """Whether literal addresses, of both versions, are publicly routable; null where the text is none. An address of version 4 inside one of 6 counts as itself."""
    known = {h: _routable(h) for h in hosts.dropna().unique()}
    return hosts.map(known).astype("boolean")


def certificates(pem: str) -> list[bytes]:
    """The certificates of a PEM text; blocks that are no base64 are left out."""
    out = []
    for block in _PEM.findall(pem):
        try:
            out.append(base64.b64decode("".join(block.split()), validate=True))
        except binascii.Error:
            continue
    return out


@F.pandas_udf(ArrayType(StringType()))
def certificate_digests(pem: pd.Series) -> pd.Series:
    """The sha256 of each certificate (DER) of PEM texts, in order."""
    return pem.map(lambda t: [hashlib.sha256(d).hexdigest() for d in certificates(t)] if t is not None else None)


_PATCHED = StructType([StructField("content", BinaryType()), StructField("error", StringType())])


@F.pandas_udf(_PATCHED)
def patched(content: pd.Series, placeholder: pd.Series, signature: pd.Series) -> pd.DataFrame:
    """``content`` with the signature in the one place of its placeholder, else ``error``: signature_size, placeholder_missing or placeholder_ambiguous."""

    def one(data: bytes | None, mark: bytes | None, value: bytes | None) -> tuple[bytes | None, str | None]:
        if len(mark or b"") != PLACEHOLDER or len(value or b"") != PLACEHOLDER:
            return None, "signature_size"
        needle = SIGNATURE_PREFIX + mark
        at = (data or b"").find(needle)
        if at < 0:
            return None, "placeholder_missing"
        if data.find(needle, at + 1) >= 0:
            return None, "placeholder_ambiguous"
        return data[: at + 2] + value + data[at + 2 + PLACEHOLDER :], None

    return pd.DataFrame([one(*row) for row in zip(content, placeholder, signature)], columns=["content", "error"])


def anchors(official: Column, interim: Column, selector: Column) -> Column:
    """The certificates that a selector names: official, interim, both or none."""
    return F.when(selector == "official", official).when(selector == "interim", interim).when(selector == "both", F.concat_ws("\n", official, interim)).otherwise(F.lit(""))
