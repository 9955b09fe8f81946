"""Result documents out of manifest stores (JSON), one Arrow-batched pass over them.

A store is a graph of manifests linked by ingredients. Walks over it are depth-first with a depth and an edge budget;
both are part of the result, so they are followed here edge by edge. :mod:`attesta.operators.graph` has the relational
form of origin tracing, which agrees below the budget.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.dictionaries import AI_CATEGORIES, AI_GENERATORS, CATEGORY_OF_TYPE, CATEGORY_RANK, INFORMATIONAL_CODES, LIMITS, SOURCE_PREFIX, UNTRUSTED_CODE, WARNING_CODES

SCHEMA = (
    "id long, status string, valid boolean, trusted boolean, organization string, common_name string, issuer string, on_trust_list string, generator string, title string, spec_version string, "
    "signed_at string, algorithm string, manifest_label string, category string, digital_source_type string, inherited boolean, origin string, origin_signer string, origin_relationship string, origin_depth int, "
    "actions array<struct<action:string,when:string,software:string>>, ingredients array<struct<title:string,relationship:string,credential_status:string,signer_name:string,manifest_label:string>>, "
    "errors array<string>, warnings array<string>"
)


def _dict(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def _list(value: Any) -> list:
    return value if isinstance(value, list) else []


def text(value: Any) -> str | None:
    """A non-empty string, or a number as it prints; nothing else."""
    if isinstance(value, bool):
        return None
    return (value or None) if isinstance(value, str) else json.dumps(value) if isinstance(value, (int, float)) else None


def organization(subject: str) -> str:
    return next((p.strip()[2:] for p in subject.split(",") if p.strip().startswith("O=")), subject)


def _signer_name(manifest: dict) -> str | None:
    info = _dict(manifest.get("signature_info"))
    issuer = text(info.get("issuer"))
    return organization(issuer) if issuer else text(info.get("common_name"))


def ingredient_status(item: dict) -> str:
    if not item.keys() & {"active_manifest", "c2pa_manifest", "manifest_data"}:
        return "absent"
    return "present_invalid" if any(_dict(e).get("code") != UNTRUSTED_CODE for e in _list(item.get("validation_status"))) else "valid_untrusted"


class Store:
    """A manifest store and the walks over it."""

    def __init__(self, raw: dict):
        self.raw = raw
        self.manifests = {k: _dict(v) for k, v in _dict(raw.get("manifests")).items()}
        self.trusted = {x for x in _list(raw.get("trusted_manifests")) if isinstance(x, str)}
        wanted = raw.get("active_manifest")
        self.label = wanted if isinstance(wanted, str) and wanted in self.manifests else next(iter(self.manifests), None)
        self.active = self.manifests.get(self.label) if self.label is not None else None

    @staticmethod
    def items(manifest: dict) -> list[dict]:
        return [_dict(x) for x in _list(manifest.get("ingredients"))]

    def follow(self, item: dict) -> str | None:
        label = item.get("active_manifest")
        return label if isinstance(label, str) and label in self.manifests else None

    @staticmethod
    def assertions(manifest: dict, prefix: str) -> Iterator[dict]:
        for a in _list(manifest.get("assertions")):
            label = _dict(a).get("label")
            if isinstance(label, str) and label.startswith(prefix):
                yield _dict(a["data"] if "data" in a else None)

    def actions(self, manifest: dict) -> Iterator[dict]:
        for data in self.assertions(manifest, "c2pa.actions"):
            yield from (_dict(e) for e in _list(data.get("actions")))

    def declared(self, manifest: dict) -> tuple[str, str | None]:
        """(category, source type) that a manifest itself declares: the strongest of one, the last of the other."""
        uris = [e.get("digitalSourceType") for e in self.actions(manifest)]
        uris += [d["digitalSourceType"] if "digitalSourceType" in d else d.get("Iptc4xmpExt:DigitalSourceType") for d in self.assertions(manifest, "stds.iptc")]
        known = [(u, c) for u in uris if isinstance(u, str) and (c := CATEGORY_OF_TYPE.get(_slug(u)))]
        return max((c for _, c in known), key=CATEGORY_RANK.__getitem__, default="unknown"), known[-1][0] if known else None

    def generator(self, manifest: dict) -> str | None:
        infos = _list(manifest.get("claim_generator_info"))
        return (text(_dict(infos[0]).get("name")) if infos else None) or text(manifest.get("claim_generator"))

    def source(self) -> tuple[str, str | None, bool]:
        """(category, source type, inherited) of the active manifest."""
        budget = [LIMITS["manifests"]]

        def strongest(manifest: dict, relation: str, depth: int) -> tuple[str, str | None, bool]:
            best: tuple[str, str | None, bool] = ("unknown", None, False)
            for item in self.items(manifest) if depth else ():
                if not budget[0]:
                    break
                label = self.follow(item)
                if label is None or item.get("relationship") != relation or ingredient_status(item) != "valid_untrusted":
                    continue
                budget[0] -= 1
                found = resolve(self.manifests[label], depth - 1)
                if CATEGORY_RANK[found[0]] > CATEGORY_RANK[best[0]]:
                    best = found
            return best

        def resolve(manifest: dict, depth: int) -> tuple[str, str | None, bool]:
            category, kind = self.declared(manifest)
            parent, component = strongest(manifest, "parentOf", depth), strongest(manifest, "componentOf", depth)
            open_to_parts = category == "unknown" or (kind is not None and _slug(kind) == "composite")
            inherited = False
            if category == "unknown" and parent[0] != "unknown":
                category, kind, inherited = parent[0], parent[1], True
            if open_to_parts and component[0] in AI_CATEGORIES and CATEGORY_RANK["ai_composite"] > CATEGORY_RANK[category]:
                category, inherited = "ai_composite", True
            name = self.generator(manifest)
            if category == "unknown" and name and any(n in name.lower() for n in AI_GENERATORS):
                category = "ai_generated"
            return category, kind, inherited

        return resolve(self.active, LIMITS["depth"]) if self.active is not None else ("unknown", None, False)

    def nearest_listed(self) -> tuple[int, str | None, str] | None:
        """(depth, signer, relationship) of the nearest ancestor on the trust list; parents win ties, then the earlier."""
        budget = [LIMITS["manifests"]]

        def walk(manifest: dict, depth: int) -> tuple[int, str | None, str] | None:
            best: dict[str, tuple[int, str | None, str]] = {}
            broken = False
            for item in self.items(manifest) if depth else ():
                relation, status, label = item.get("relationship"), ingredient_status(item), self.follow(item)
                if relation not in ("parentOf", "componentOf"):
                    continue
                broken |= relation == "componentOf" and status == "present_invalid"
                if status != "valid_untrusted" or label is None or not budget[0]:
                    continue
                budget[0] -= 1
                if label in self.trusted:
                    hit = (1, _signer_name(self.manifests[label]), relation)
                else:
                    deeper = walk(self.manifests[label], depth - 1)
                    hit = deeper and (deeper[0] + 1, deeper[1], deeper[2])
                if hit and (relation not in best or hit[0] < best[relation][0]):
                    best[relation] = hit
            hits = [best[r] for r in ("parentOf", "componentOf") if r in best and not (broken and r == "componentOf")]
            return min(hits, key=lambda h: h[0], default=None)

        return walk(self.active, LIMITS["depth"]) if self.active is not None else None

    def validation(self) -> tuple[list[str], list[str]]:
        """Distinct (errors, warnings) in order, success and informational entries left out."""
        entries = []
        for scope in _dict(self.raw.get("validation_results")).values():
            for bucket, listed in _dict(scope).items():
                if bucket != "success":
                    entries += [e for e in map(_dict, _list(listed)) if bucket != "informational" or e.get("code") in WARNING_CODES]
        entries += map(_dict, _list(self.raw.get("validation_status")))
        codes = list(dict.fromkeys(c for e in entries if isinstance(c := e.get("code"), str)))[: LIMITS["codes"]]
        told = [c for c in codes if c not in INFORMATIONAL_CODES]
        return [c for c in told if c not in WARNING_CODES][: LIMITS["entries"]], [c for c in told if c in WARNING_CODES][: LIMITS["entries"]]


def _slug(uri: str) -> str:
    return uri[len(SOURCE_PREFIX) :] if uri.startswith(SOURCE_PREFIX) else uri.rsplit("/", 1)[-1]


def report(raw: dict, selector: str = "official") -> dict:
    """The result document of a store, as a row of SCHEMA without its id."""
    store = Store(raw)
    state = text(raw.get("validation_state")) or ""
    valid, trusted = state != "Invalid", state == "Trusted"
    active = store.active or {}
    info = _dict(active.get("signature_info")) if "signature_info" in active else None
    issuer = text(info.get("issuer")) if info is not None else None
    signer = organization(issuer) if issuer else None
    common = ((text(info.get("common_name")) or issuer) if info is not None else None)
    category, kind, inherited = store.source()
    hit = None
    if valid and trusted:
        hit = (0, signer or common, None)
    elif valid:
        hit = store.nearest_listed()
    ingredients = []
    for item in store.items(active)[: LIMITS["ingredients"]]:
        label, status = store.follow(item), ingredient_status(item)
        listed = status == "valid_untrusted" and label in store.trusted
        ingredients.append({"title": text(item.get("title")), "relationship": text(item.get("relationship")), "credential_status": "valid_trusted" if listed else status, "signer_name": _signer_name(store.manifests[label]) if label is not None else None, "manifest_label": text(item.get("active_manifest"))})
    actions = []
    for entry in store.actions(active):
        if isinstance(entry.get("action"), str) and len(actions) < LIMITS["actions"]:
            agent = entry.get("softwareAgent")
            actions.append({"action": entry["action"], "when": text(entry.get("when")), "software": text(agent) or text(_dict(agent).get("name"))})
    errors, warnings = store.validation()
    details = info or {}
    return {
        "status": "present_invalid" if not valid else "valid_trusted" if trusted else "valid_untrusted", "valid": valid, "trusted": trusted,
        "organization": signer, "common_name": common, "issuer": issuer,
        "on_trust_list": None if info is None else "none" if not trusted or selector == "none" else "interim" if selector == "interim" else "official",
        "generator": store.generator(active), "title": (text(active.get("title")) or "")[: LIMITS["title"]] or None, "spec_version": text(active.get("claim_version")) or text(active.get("spec_version")),
        "signed_at": text(details.get("time")), "algorithm": (text(details.get("alg")) or "").lower() or None, "manifest_label": store.label or None,
        "category": category, "digital_source_type": kind, "inherited": inherited,
        "origin": "none" if not valid else "traced" if hit else "untraced", "origin_signer": hit[1] if hit else None, "origin_relationship": hit[2] if hit else None, "origin_depth": hit[0] if hit else None,
        "actions": actions, "ingredients": ingredients, "errors": errors, "warnings": warnings,
    }


def extract_reports(df: DataFrame, record: Column, store_json: Column, selector: str = "official") -> DataFrame:
    """A result document per manifest store; a null store is ``absent``, one that is no JSON object ``error``.

    Null records are kept; repeated rows give repeated documents; an empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = dict.fromkeys(arrow.names) | {"id": key, "status": "absent" if raw is None else "error", "origin": "none"}
                if raw is not None:
                    try:
                        value = json.loads(raw)
                        row |= report(value, selector) if isinstance(value, dict) else {}
                    except (ValueError, RecursionError):
                        pass
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.select(record.cast("long").alias("id"), store_json.alias("store")).mapInArrow(run, schema)
