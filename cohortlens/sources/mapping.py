"""Strict mappings from source headers to canonical fields; rows that lack an identity become rejects, never vanish."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.text import strip


class HeaderDrift(ValueError):
    """The headers of a source aren't those of its mapping."""


@dataclass(frozen=True)
class Mapping:
    version: str
    #: Canonical field to source header.
    fields: dict[str, str]
    source_identity: list[str]
    applicant_identity: list[str]
    any_of: bool = True
    authoritative: list[str] = field(default_factory=list)
    #: All headers of the source, where it has more than the fields name.
    headers: list[str] | None = None
    source_type: str = ""
    #: One present field of ``source_identity`` is enough.
    source_any_of: bool = False
    #: The fields (or headers) that identify a record and its applicant.
    external_id: str | None = None
    identity: str | None = None
    authorities: list[str] | None = None
    needs_authority: bool = False

    def wanted(self) -> list[str]:
        return list(self.headers if self.headers is not None else self.fields.values())

    def check(self, headers: list[str]) -> None:
        """The order is free; anything missing, unexpected or doubled is an error that names all of it."""
        problem = drift(headers, self.wanted())
        if problem:
            raise HeaderDrift(problem)

    def header(self, name: str) -> str:
        """The header behind a field; a name that is no field is a header itself."""
        return self.fields.get(name, name)


def drift(found: list[str], wanted: list[str]) -> str:
    doubled = sorted({h for h in found if found.count(h) > 1})
    problems = {"unexpected": sorted(set(found) - set(wanted)), "missing": sorted(set(wanted) - set(found)), "duplicate": doubled}
    return "; ".join(f"{k}: {', '.join(v)}" for k, v in problems.items() if v)


class BadMapping(ValueError):
    """A mapping file breaks its contract."""


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise BadMapping("a key stands twice")
    return out


def _constant(name: str) -> None:
    raise BadMapping(f"{name} is no JSON number")


def _identity(raw: Any, name: str) -> tuple[list[str], bool]:
    """Fields, and whether one is enough."""
    if not isinstance(raw, dict) or not raw.get("fields") or raw.get("mode", "any") not in ("any", "all"):
        raise BadMapping(f"{name} needs fields and a mode of any or all")
    return list(raw["fields"]), raw.get("mode", "any") == "any"


def load_mapping(text: str, sha256: str | None = None) -> Mapping:
    """The mapping of a JSON text, checked; with ``sha256``, that of its canonical form must be the same as when it was registered."""
    try:
        raw = json.loads(text, object_pairs_hook=_once, parse_constant=_constant)
    except json.JSONDecodeError as e:
        raise BadMapping(f"no JSON: {e}") from e
    canonical = json.dumps(raw, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    if sha256 is not None and hashlib.sha256(canonical).hexdigest() != sha256:
        raise BadMapping("the mapping changed after it was registered")
    needed = {"source_type", "version", "expected_headers", "field_map", "source_identity", "applicant_identity", "external_id_field", "applicant_identity_field", "metadata"}
    if not isinstance(raw, dict) or needed - raw.keys():
        raise BadMapping(f"missing: {', '.join(sorted(needed - set(raw)))}")
    headers, fields, metadata = raw["expected_headers"], raw["field_map"], raw["metadata"]
    texts: Callable[[Any], bool] = lambda values: all(isinstance(v, str) for v in values)
    if not isinstance(headers, list) or not headers or not texts(headers) or len(set(headers)) < len(headers):
        raise BadMapping("expected_headers must be distinct texts, one at least")
    if not isinstance(fields, dict) or not texts(fields.values()) or not isinstance(metadata, dict):
        raise BadMapping("field_map must map fields to headers, metadata must be an object")
    ids = raw["external_id_field"], raw["applicant_identity_field"]
    unknown = {*fields.values(), *(fields.get(i, i) for i in ids)} - set(headers)
    if unknown:
        raise BadMapping(f"unknown headers: {', '.join(sorted(unknown))}")
    authoritative, only = list(metadata.get("authoritative_fields", [])), set(metadata.get("identity_only_fields", []))
    needs = bool(metadata.get("requires_explicit_authority"))
    if needs and (not authoritative or only & set(authoritative) or only | set(authoritative) != set(fields)):
        raise BadMapping("each field of a supplement is either authoritative or for identity only, one at least authoritative")
    (source, source_any), (applicant, any_of) = _identity(raw["source_identity"], "source_identity"), _identity(raw["applicant_identity"], "applicant_identity")
    return Mapping(raw["version"], dict(fields), source, applicant, any_of, authoritative, headers, raw["source_type"], source_any, *ids, metadata.get("allowed_authorities"), needs)


def authority_of(mapping: Mapping, authority: str | None) -> str | None:
    """The authority that rows of a source carry: a supplement must name one, and an allowed one."""
    if mapping.needs_authority and not authority:
        raise BadMapping(f"mapping {mapping.version} needs an authority")
    if authority and mapping.authorities and authority not in mapping.authorities:
        raise BadMapping(f"authority {authority!r} is not allowed for mapping {mapping.version}")
    return authority


def _value(header: str) -> Column:
    return strip(F.coalesce(F.try_element_at("values", F.lit(header)), F.lit("")))


def _present(mapping: Mapping, fields: list[str], any_of: bool) -> Column:
    tests = [_value(mapping.header(f)) != "" for f in fields]
    out = tests[0]
    for t in tests[1:]:
        out = out | t if any_of else out & t
    return out


def coded(rows: DataFrame, mapping: Mapping, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row as its fields with a ``reject_code``, null where the row is mapped; the columns of ``keep`` stay as they are."""
    code = F.when(~_present(mapping, mapping.source_identity, mapping.source_any_of), "missing_source_identity").when(~_present(mapping, mapping.applicant_identity, mapping.any_of), "missing_applicant_identity")
    ids = {"external_record_id": mapping.external_id, "applicant_identity": mapping.identity}
    found = {"external_record_id": lambda c: c, "applicant_identity": F.lower}
    extra = [found[n](_value(mapping.header(f))).alias(n) for n, f in ids.items() if f]
    return rows.select(*keep, "row_number", "source_partition", *[_value(h).alias(c) for c, h in mapping.fields.items()], *extra, F.lit(mapping.version).alias("mapping_version"), code.alias("reject_code"))


def parted(found: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(mapped, rejects)`` of coded rows; rejects hold no raw content."""
    rejects = found.where("reject_code is not null").select(*keep, "row_number", "source_partition", "mapping_version", "reject_code")
    return found.where("reject_code is null").drop("reject_code"), rejects


def mapped(rows: DataFrame, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """``(mapped, rejects)`` of rows ``(row_number, source_partition, values map)``."""
    return parted(coded(rows, mapping))


def authoritative(rows: DataFrame, mapping: Mapping) -> DataFrame:
    return rows.select(*mapping.source_identity, *mapping.authoritative)
