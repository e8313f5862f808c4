"""The vault's configuration as small tables (S9, V7, X3): entity types, edge types with symmetry, weight and signature, thresholds.

A configuration is checked as a whole: every rule looks at its own part and yields what is wrong there, so all faults are told at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cairn.sources.vault import parse_front_matter

#: The keys of a configuration, of an edge type and of the thresholds, with the defaults of optional ones.
KEYS = ("schema_version", "entity_types", "edge_types", "thresholds", "embedder")
EDGE_KEYS = ("directed", "cluster_weight", "domain", "range")
THRESHOLDS = ("cluster_activation_entities", "abstain_bm25_floor", "abstain_cosine_floor", "community_lineage_jaccard")
DEFAULTS = {"duplicate_cosine_floor": 0.92}
VERSIONS = (1,)


class ConfigError(ValueError):
    """All that is wrong with a configuration."""


def _keys(where: str, data: dict, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> Iterator[str]:
    if gone := sorted(set(required) - set(data)):
        yield f"{where} misses {', '.join(gone)}"
    if odd := sorted(map(str, set(data) - {*required, *optional})):
        yield f"{where} has unknown {', '.join(odd)}"


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _edge_type(name: str, spec: object, entity_types: list) -> Iterator[str]:
    where = f"edge type {name}"
    if not isinstance(spec, dict):
        yield f"{where} is no mapping"
        return
    yield from _keys(where, spec, EDGE_KEYS[:2], EDGE_KEYS[2:])
    if "directed" in spec and not isinstance(spec["directed"], bool):
        yield f"{where}: directed is no boolean"
    if "cluster_weight" in spec and not _number(spec["cluster_weight"]):
        yield f"{where}: cluster_weight is no number"
    for end in EDGE_KEYS[2:]:
        names = spec.get(end)
        if names is not None and not (isinstance(names, list) and all(isinstance(t, str) for t in names)):
            yield f"{where}: {end} is no list of entity types"
        elif odd := [t for t in names or () if t not in entity_types]:
            yield f"{where}: {end} names unknown {', '.join(odd)}"
    if spec.get("directed") is False and spec.get("range") is not None:
        yield f"{where} is symmetric and may not declare a range"


def faults(data: dict) -> Iterator[str]:
    """What is wrong with a configuration, if anything."""
    yield from _keys("configuration", data, KEYS)
    if data.get("schema_version") not in VERSIONS:
        yield f"schema_version {data.get('schema_version')} is unsupported"
    types, edges, limits = (data.get(k) for k in KEYS[1:4])
    if not isinstance(types, list):
        yield "entity_types is no list"
        types = []
    if not isinstance(edges, dict) or not isinstance(limits, dict):
        yield "edge_types and thresholds must be mappings"
        return
    for name, spec in edges.items():
        yield from _edge_type(name, spec, types)
    yield from _keys("thresholds", limits, THRESHOLDS, tuple(DEFAULTS))
    yield from (f"threshold {k} is no number" for k, v in limits.items() if not _number(v))


@dataclass(frozen=True)
class Config:
    entity_types: list[str]
    edge_types: list[tuple]
    thresholds: dict[str, float]
    embedder: dict
    templates: str

    def edges(self, spark: SparkSession) -> DataFrame:
        """type, symmetric, weight, domain, range: what the fold and the lints join."""
        return spark.createDataFrame(self.edge_types, "type string, symmetric boolean, weight double, domain array<string>, range array<string>")


def parse(text: str) -> Config:
    """A configuration from its file's text; its body holds the prompt templates."""
    data, body = parse_front_matter(text)
    if wrong := list(faults(data)):
        raise ConfigError("; ".join(wrong))
    edges = [(n, not s["directed"], float(s["cluster_weight"]), s.get("domain"), s.get("range")) for n, s in data["edge_types"].items()]
    return Config(data["entity_types"], edges, DEFAULTS | {k: float(v) for k, v in data["thresholds"].items()}, data["embedder"], body)
