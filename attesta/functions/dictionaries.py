"""Fixed values that results must agree with: vocabularies, ranks, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_PREFIX = "http://cv.iptc.org/newscodes/digitalsourcetype/"
CATEGORY_OF_TYPE = {
    "trainedAlgorithmicMedia": "ai_generated",
    "compositeWithTrainedAlgorithmicMedia": "ai_composite",
    "algorithmicallyEnhanced": "ai_enhanced",
    "algorithmicMedia": "algorithmic",
    "digitalCapture": "camera",
    "negativeFilm": "camera",
    "positiveFilm": "camera",
    "print": "camera",
    "softwareImage": "software",
    "composite": "software",
    "compositeCapture": "software",
    "minorHumanEdits": "software",
    "humanEdits": "software",
}
CATEGORY_RANK = {"unknown": 0, "camera": 1, "software": 2, "algorithmic": 3, "ai_enhanced": 4, "ai_composite": 5, "ai_generated": 6}
CATEGORY_LABEL = {"ai_generated": "AI generated", "ai_composite": "AI composite", "ai_enhanced": "AI enhanced", "algorithmic": "algorithmic", "software": "software", "camera": "camera capture", "unknown": "not declared"}
AI_CATEGORIES = ("ai_generated", "ai_composite", "ai_enhanced")
AI_GENERATORS = ("openai", "dall-e", "dalle", "sora", "chatgpt", "firefly", "midjourney", "imagen", "gemini", "nano banana", "stable diffusion", "stability", "flux", "ideogram", "leonardo", "runway", "grok", "xai", "luma", "kling", "veo")
INFORMATIONAL_CODES = ("claimSignature.validated", "signingCredential.trusted", "timeStamp.trusted", "timeStamp.validated", "assertion.hashedURI.match", "assertion.dataHash.match", "assertion.bmffHash.match", "assertion.boxesHash.match", "assertion.accessible", "ingredient.claimSignature.validated")
WARNING_CODES = ("signingCredential.untrusted", "timeStamp.untrusted", "timeStamp.mismatch", "signingCredential.expired", "assertion.dataHash.unknown")
UNTRUSTED_CODE = "signingCredential.untrusted"
FORMAT_OF_MIME = {
    "image/jpeg": "jpeg", "image/png": "png", "image/webp": "webp", "image/gif": "gif", "image/avif": "avif", "image/heic": "heic", "image/heif": "heif", "image/tiff": "tiff",
    "image/svg+xml": "svg", "video/mp4": "mp4", "video/quicktime": "mov", "audio/mpeg": "mp3", "audio/wav": "wav", "application/pdf": "pdf", "application/c2pa": "c2pa",
}
MIME_OF_EXTENSION = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "avif": "image/avif", "heic": "image/heic", "heif": "image/heif",
    "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime", "mp3": "audio/mpeg", "wav": "audio/wav",
    "pdf": "application/pdf", "c2pa": "application/c2pa",
}
XMP_FIELDS = {
    "dc:creator": "Creator", "dc:rights": "Copyright", "dc:description": "CaptionDescription", "photoshop:Credit": "CreditLine", "photoshop:DateCreated": "DateCreated", "dc:subject": "Keywords",
    "photoshop:Source": "Source", "dc:title": "ObjectName", "xmpRights:UsageTerms": "UsageTerms", "xmpRights:WebStatement": "WebStatement", "Iptc4xmpExt:DigitalSourceType": "DigitalSourceType",
    "Iptc4xmpExt:AISystemUsed": "AISystemUsed", "Iptc4xmpExt:AISystemVersionUsed": "AISystemVersionUsed", "Iptc4xmpExt:AIPromptInformation": "AIPromptInformation",
    "Iptc4xmpExt:AIPromptWriterName": "AIPromptWriterName", "Iptc4xmpCore:AltTextAccessibility": "AltTextAccessibility", "Iptc4xmpCore:ExtDescrAccessibility": "ExtendedDescriptionAccessibility",
    "Iptc4xmpExt:LocationCreated": "LocationCreated", "Iptc4xmpExt:LocationShown": "LocationShown", "plus:DataMining": "DataMining", "plus:LicensorName": "LicensorName",
    "plus:LicensorURL": "LicensorURL", "Iptc4xmpCore:IntellectualGenre": "Genre",
}
IIM_FIELDS = {5: "ObjectName", 25: "Keywords", 55: "DateCreated", 80: "Creator", 110: "CreditLine", 115: "Source", 116: "Copyright", 120: "CaptionDescription"}
EXIF_FIELDS = {0x013B: "Creator", 0x8298: "Copyright", 0x010E: "CaptionDescription", 0x9003: "DateCreated"}
SCORED_FIELDS = ("Creator", "Copyright", "CaptionDescription", "CreditLine")
LIMITS = {"bytes": 64 << 20, "pixels": 100_000_000, "manifest_bytes": 16 << 20, "ingredients": 256, "actions": 64, "entries": 64, "codes": 256, "depth": 8, "manifests": 512, "title": 200}


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a key in a dictionary, null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)
