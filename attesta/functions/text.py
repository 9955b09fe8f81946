"""String functions of the report and gate operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def target_key(target: Column) -> Column:
    """Key form of a target: ``\\`` becomes ``/``, then every leading ``./`` goes. Case is kept."""
    return F.regexp_replace(F.translate(target, "\\", "/"), r"^(\./)+", "")


def canonical_status(status: Column) -> Column:
    """One of the five credential statuses however it is spelled; anything else is null."""
    plain = F.regexp_replace(F.lower(F.trim(status)), r"[\s_-]+", "_")
    return F.when(plain.isin("valid_trusted", "valid_untrusted", "present_invalid", "absent", "error"), plain)


def canonical_hash(value: Column) -> Column:
    """A hex digest without outer blanks, in lower case."""
    return F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))


def fingerprint(*columns: Column) -> Column:
    """64-bit hash of a row's canonical form; a null never equals a value, nor shifts into the next column."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.xxhash64(F.concat_ws("\u0001", *parts))


def last_segment(value: Column) -> Column:
    """The part after the last slash; blanks about the value and slashes at its end are cut first."""
    return F.element_at(F.split(F.regexp_replace(F.trim(value), "/+$", ""), "/"), -1)


def xml_escape(value: Column) -> Column:
    """Entities for ``& < > "``; tab and line ends become blanks, other controls ``?``."""
    out = F.regexp_replace(F.translate(value, "\t\n\r", "   "), r"[\x00-\x1f]", "?")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def xml_unescape(value: Column) -> Column:
    """The five entities as characters, ``&amp;`` last."""
    out = value
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return out


def slug(value: Column) -> Column:
    """Lower case, what isn't ``a-z 0-9 _ . : -`` as ``_``, at most 64 characters."""
    return F.substring(F.regexp_replace(F.lower(value), "[^a-z0-9_.:-]", "_"), 1, 64)


def host_of(url: Column) -> Column:
    """Host of a URL without user, port and brackets."""
    authority = F.regexp_extract(F.regexp_replace(url, r"^(?s).*?://", ""), r"^[^/?#]*", 0)
    authority = F.substring_index(authority, "@", -1)
    return F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)", 1)).otherwise(F.substring_index(authority, ":", 1))


def routable_ipv4(host: Column) -> Column:
    """Whether a literal IPv4 address is publicly routable; null where the text is no such address."""
    octets = F.transform(F.split(host, r"\."), lambda o: o.cast("int"))
    a, b, c = octets[0], octets[1], octets[2]
    closed = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 198) & b.between(18, 19))
    documentation = ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    number = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(host.rlike(rf"^({number}\.){{3}}{number}$"), ~(closed | documentation))


def device(make: Column, model: Column) -> Column:
    """The model if it begins with the make in any case, else both."""
    return F.when(F.startswith(F.lower(model), F.lower(make)), model).otherwise(F.nullif(F.concat_ws(" ", make, model), F.lit("")))


def organization(subject: Column) -> Column:
    """The first ``O=`` part of a certificate subject, else the whole of it."""
    parts = F.filter(F.transform(F.split(subject, ","), lambda p: F.trim(p)), lambda p: F.startswith(p, F.lit("O=")))
    return F.when(F.size(parts) > 0, F.substring(F.get(parts, F.lit(0)), 3, 100_000)).otherwise(subject)
