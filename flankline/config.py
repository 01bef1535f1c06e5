"""Configuration files: strict keys, two ways of composition, a resolved dump."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import yaml

SECTIONS = {
    "scoring": {"locus_score_weights", "candidate_score_weights", "confidence_thresholds", "enrichment", "windows", "robustness"},
    "regulator_families": {"family", "class", "pfam_required", "pfam_optional", "sensor_role_default", "notes"},
    "sensory_domains": {"domain", "pfam_id", "role", "chemistry", "notes"},
    "analyte": {"analyte", "display_name", "anchor_families", "window_genes", "known_organisms_table", "expected_sensory_chemistry"},
}


class ConfigError(ValueError):
    """A configuration has unknown, missing or malformed entries."""


def strict(entry: dict, section: str, where: str) -> dict:
    if not isinstance(entry, dict):
        raise ConfigError(f"{where}: not a mapping")
    if unknown := sorted(set(entry) - SECTIONS[section]):
        raise ConfigError(f"{where}: unknown keys {unknown}")
    return entry


def _load(path: Path) -> dict:
    if not path.exists():
        raise ConfigError(f"{path} does not exist")
    return yaml.safe_load(path.read_text()) or {}


def load_directory(folder: str) -> dict:
    """analytes/*.yaml, scoring.yaml, regulator_families.yaml and sensory_domains.yaml of a folder."""
    root = Path(folder)
    domains = _load(root / "sensory_domains.yaml")
    return {
        "analytes": [strict(_load(p), "analyte", str(p)) for p in sorted((root / "analytes").glob("*.yaml"))],
        "scoring": strict(_load(root / "scoring.yaml"), "scoring", "scoring"),
        "regulator_families": [strict(e, "regulator_families", f"regulator_families[{k}]") for k, e in enumerate(_load(root / "regulator_families.yaml").get("regulator_families", []))],
        "sensory_domains": [strict(e, "sensory_domains", f"sensory_domains[{k}]") for k, e in enumerate(domains.get("sensory_domains", []))],
        "paired_evidence": [rule | {"chemistry": rule["rescore"]["chemistry"]} for rule in domains.get("paired_evidence", [])],
    }


def load(path: str) -> dict:
    """A folder, or a headline file that names the other files relative to the working folder or to itself."""
    p = Path(path)
    if p.is_dir():
        return load_directory(path)
    head = _load(p)

    def find(name: str) -> Path:
        return Path(name) if Path(name).exists() else p.parent / name

    out = {"analytes": [strict(_load(find(a)), "analyte", a) for a in head.get("analytes", [])]}
    for section in ("scoring", "regulator_families", "sensory_domains"):
        if section in head:
            body = _load(find(head[section]))
            out[section] = strict(body, section, section) if section == "scoring" else [strict(e, section, f"{section}[{k}]") for k, e in enumerate(body.get(section, []))]
            if section == "sensory_domains":
                out["paired_evidence"] = [rule | {"chemistry": rule["rescore"]["chemistry"]} for rule in body.get("paired_evidence", [])]
    return out


def scan_targets(path: str) -> list[tuple[str, str]]:
    """(analyte, term) of a term scan's configuration, in the file's order."""
    out = []
    for k, entry in enumerate(_entries(path, "targets")):
        analyte, terms = str(entry.get("analyte") or "").strip(), [str(t).strip() for t in entry.get("terms") or []]
        if not analyte or not any(terms):
            raise ConfigError(f"targets[{k}]: an analyte and at least one term are required")
        out += [(analyte, t) for t in terms if t]
    return out


def catalog_manifest(path: str) -> list[dict]:
    """Datasets to index: dataset_name, protein_faa, gff (relative ones from the manifest's folder) and taxonomy."""
    out = []
    for k, entry in enumerate(_entries(path, "catalogs")):
        if missing := [c for c in ("dataset_name", "protein_faa", "gff") if not entry.get(c)]:
            raise ConfigError(f"catalogs[{k}]: missing {missing}")
        files = {c: entry[c] if ":" in entry[c] or Path(entry[c]).exists() else str(Path(path).parent / entry[c]) for c in ("protein_faa", "gff")}
        out.append({"dataset_name": entry["dataset_name"], "taxonomy": dict(entry.get("taxonomy") or {})} | files)
    return out


def _entries(path: str, section: str) -> list[dict]:
    body = _load(Path(path))
    entries = body.get(section) if isinstance(body, dict) else None
    if not isinstance(entries, list) or not entries or not all(isinstance(e, dict) for e in entries):
        raise ConfigError(f"{path}: {section} must be a list of mappings")
    return entries


def dump(config: dict, path: str) -> None:
    Path(path).write_text(yaml.safe_dump(config, sort_keys=True))


def manifest(config: dict, inputs: dict[str, str]) -> dict:
    """Hashes that name a run: of the configuration, of small local inputs, and of both together."""
    text = json.dumps(config, sort_keys=True)
    hashes = {name: hashlib.sha256(Path(p).read_bytes()).hexdigest() for name, p in sorted(inputs.items())}
    body = {"config_hash": hashlib.sha256(text.encode()).hexdigest(), "input_hashes": hashes}
    return body | {"run_hash": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}
