"""Media types, source categories and credential flags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import dictionaries as D


def base_type(mime: Column) -> Column:
    return F.trim(F.substring_index(mime, ";", 1))


def format_for(mime: Column) -> Column:
    """Container format of a media type, null where it isn't supported; case counts."""
    return D.lookup(D.FORMAT_OF_MIME, base_type(mime))


def mime_from_name(name: Column) -> Column:
    """Media type by extension, ``application/octet-stream`` where it is unknown."""
    return F.coalesce(D.lookup(D.MIME_OF_EXTENSION, F.lower(F.element_at(F.split(name, r"\."), -1))), F.lit("application/octet-stream"))


def guard_error(length: Column, mime: Column, pixels: Column | None = None) -> Column:
    """``limit_exceeded`` or ``unsupported_media_type``, in this order of checks; null where a file passes."""
    out = F.when(length > D.LIMITS["bytes"], "limit_exceeded").when(format_for(mime).isNull(), "unsupported_media_type")
    return out if pixels is None else out.when(pixels > D.LIMITS["pixels"], "limit_exceeded")


def credential_status(present: Column, valid: Column, trusted: Column) -> Column:
    return F.when(~present, "absent").when(~valid, "present_invalid").when(~trusted, "valid_untrusted").otherwise("valid_trusted")


def source_slug(uri: Column) -> Column:
    return F.when(F.startswith(uri, F.lit(D.SOURCE_PREFIX)), F.substring(uri, len(D.SOURCE_PREFIX) + 1, 100_000)).otherwise(F.substring_index(uri, "/", -1))


def category_of(uri: Column) -> Column:
    """Category of a source-type URI, null where it isn't known."""
    return D.lookup(D.CATEGORY_OF_TYPE, source_slug(uri))


def category_rank(category: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in D.CATEGORY_RANK.items() for x in (F.lit(k), F.lit(v))]), category)


def declared_source(uris: Column) -> Column:
    """(category, digital_source_type) of an array of URIs in order: the strongest category, the last known URI."""
    known = F.filter(uris, lambda u: category_of(u).isNotNull())
    best = F.aggregate(known, F.lit("unknown"), lambda a, u: F.when(category_rank(category_of(u)) > category_rank(a), category_of(u)).otherwise(a))
    return F.struct(best.alias("category"), F.get(known, F.size(known) - 1).alias("digital_source_type"))


def made_by_ai(generator: Column, names: tuple[str, ...] = D.AI_GENERATORS) -> Column:
    """Whether a generator's name holds one of the names, in any case."""
    lower = F.lower(generator)
    found = F.lit(False)
    for name in names:
        found = found | F.contains(lower, F.lit(name))
    return F.coalesce(found, F.lit(False))


def explanation_key(code: Column) -> Column:
    return F.concat(F.lit("validation."), F.replace(code, F.lit("."), F.lit("_")))


def documentation_url(code: Column, base: str) -> Column:
    """Where a code is explained, under the address of a documentation."""
    return F.concat(F.lit(base + "#"), F.replace(code, F.lit("."), F.lit("-")))


def coverage_flag(status: Column, origin: Column, metric: Column) -> Column:
    """Whether a report counts for a metric: trusted, valid (trusted or not) or traced."""
    counted = F.when(metric == "valid", status.isin("valid_trusted", "valid_untrusted")).when(metric == "traced", (status == "valid_trusted") | ((origin == "traced") & (status == "valid_untrusted"))).otherwise(status == "valid_trusted")
    return F.coalesce(counted, F.lit(False))


def expectation_met(status: Column, expect: Column) -> Column:
    """Whether a status is as expected; an unreadable target (null) never is."""
    met = F.when(expect == "present", status.isin("valid_trusted", "valid_untrusted")).when(expect == "trusted", status == "valid_trusted").when(expect == "absent", status == "absent").otherwise(F.lit(True))
    return F.coalesce(met, F.lit(False))


def status_rank(status: Column) -> Column:
    return F.when(status == "valid_trusted", 2).when(status == "valid_untrusted", 1).otherwise(0)


def carry_actions(source_mime: Column, derived_mime: Column, source_size: Column, derived_size: Column) -> Column:
    """Actions between a source and what was derived from it: opened, then transcoded and resized where they apply. Sizes are structs of width and height."""
    both = source_size["width"].isNotNull() & derived_size["width"].isNotNull()
    resized = both & ((source_size["width"] != derived_size["width"]) | (source_size["height"] != derived_size["height"]))
    return F.array_compact(F.array(F.lit("c2pa.opened"), F.when(base_type(source_mime) != base_type(derived_mime), "c2pa.transcoded"), F.when(resized, "c2pa.resized")))
