"""The frozen feature spec, its JSON form with a content hash, and the replay bundle."""

from __future__ import annotations

import hashlib
import json
import math
import platform
import subprocess
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.expr import Compiled, interaction
from tallyforge.operators.binning import WoeMap, apply_woe
from tallyforge.operators.clean import CleaningSpec
from tallyforge.operators.encode import apply_labels, apply_onehot, unseen_rates
from tallyforge.operators.nulls import NullPolicy


def content_hash(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def as_text(x: float) -> float | str:
    return x if math.isfinite(x) else str(x)


@dataclass(frozen=True)
class Interaction:
    name: str
    text: str
    fill: float | None = None
    stats: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class FeatureSpec:
    step_order: tuple[str, ...] = ()
    interactions: tuple[Interaction, ...] = ()
    label_encoders: dict[str, list[str]] = field(default_factory=dict)
    onehot_columns: dict[str, list[str]] = field(default_factory=dict)
    woe_maps: dict[str, WoeMap] = field(default_factory=dict)
    selected: tuple[str, ...] = ()
    target: str | None = None

    def apply(self, df: DataFrame, strict: bool = False, max_unseen: float | None = None) -> tuple[DataFrame, list[str]]:
        """All steps in recorded order as projections, and the diagnostics. A job runs only for ``max_unseen``."""
        notes: list[str] = []
        if max_unseen is not None and self.label_encoders:
            for r in unseen_rates(df, self.label_encoders).collect():
                if r.unseen_rate > max_unseen:
                    notes.append(f"{r.column}: {r.unseen_rate} of the rows are unseen")
            if notes and strict:
                raise ValueError("; ".join(notes))
        by_name = {i.name: i for i in self.interactions}
        for step in self.step_order:
            kind, _, name = step.partition(":")
            if kind == "label":
                df = apply_labels(df, {name: self.label_encoders[name]})
            elif kind == "onehot":
                df = apply_onehot(df, {name: self.onehot_columns[name]})
            elif kind == "woe" and name in df.columns:
                df = apply_woe(df, {name: self.woe_maps[name]})
            elif kind == "interaction":
                i = by_name[name]
                try:
                    df = df.withColumn(name, interaction(df, Compiled(i.text, i.stats), i.fill))
                except KeyError as e:
                    if strict:
                        raise
                    notes.append(f"{name}: {e.args[0]}; every row gets {i.fill}")
                    df = df.withColumn(name, F.lit(i.fill).cast("double"))
        if self.selected:
            keep = [c for c in self.selected if c in df.columns]
            if lost := [c for c in self.selected if c not in df.columns]:
                if strict:
                    raise ValueError(f"selected columns are missing: {lost}")
                notes.append(f"selected columns are missing: {lost}")
            df = df.select(*keep, *([self.target] if self.target in df.columns and self.target not in keep else []))
        return df, notes

    def to_dict(self) -> dict:
        return {
            "step_order": list(self.step_order), "interactions": [[i.name, i.text, i.fill, i.stats] for i in self.interactions], "label_encoders": self.label_encoders, "onehot_columns": self.onehot_columns,
            "woe_maps": {c: {"edges": [as_text(e) for e in m.edges], "woe": list(m.woe), "iv": m.iv} for c, m in self.woe_maps.items()}, "selected_features": list(self.selected), "target": self.target,
        }

    @classmethod
    def from_dict(cls, d: dict) -> FeatureSpec:
        return cls(tuple(d["step_order"]), tuple(Interaction(*x) for x in d["interactions"]), d["label_encoders"], d["onehot_columns"], {c: WoeMap(tuple(float(e) for e in m["edges"]), tuple(m["woe"]), m["iv"]) for c, m in d["woe_maps"].items()}, tuple(d["selected_features"]), d["target"])


@dataclass(frozen=True)
class Replay:
    """Cleaning, row operations (training only), nulls, features."""

    cleaning: CleaningSpec
    nulls: NullPolicy | None
    features: FeatureSpec

    def apply(self, df: DataFrame, is_train: bool = False, order: Sequence[str] = (), strict: bool = False) -> tuple[DataFrame, list[str]]:
        notes: list[str] = []
        df = self.cleaning.apply(df)
        if is_train:
            df, more = self.cleaning.apply_rows(df, order)
            notes += more
        if self.nulls:
            df = self.nulls.apply(df, strict)
        out, more = self.features.apply(df, strict)
        return out, notes + more

    def to_dict(self) -> dict:
        return {"cleaning": self.cleaning.to_dict(), "nulls": self.nulls.to_dict() if self.nulls else None, "features": self.features.to_dict()}

    @classmethod
    def from_dict(cls, d: dict) -> Replay:
        return cls(CleaningSpec.from_dict(d["cleaning"]), NullPolicy.from_dict(d["nulls"]) if d["nulls"] else None, FeatureSpec.from_dict(d["features"]))


def save(body: dict, path: str) -> str:
    """Write JSON with its content hash; the hash comes back."""
    sha = content_hash(body)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"sha256": sha, "content": body}, indent=1, sort_keys=True, default=str))
    return sha


def read(path: str) -> dict:
    """Read what ``save`` wrote; a changed file is an error."""
    got = json.loads(Path(path).read_text())
    if content_hash(got["content"]) != got["sha256"]:
        raise ValueError(f"{path} was changed after it was written")
    return got["content"]


def provenance(inputs: dict[str, str] | None = None, config: dict | None = None) -> dict:
    """Git state, a fingerprint of this package, configuration, inputs and versions."""
    import pyspark

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", *args], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10).stdout.strip() or None
        except OSError:
            return None

    code = hashlib.sha256()
    root = Path(__file__).resolve().parents[1]
    for p in sorted(root.rglob("*.py")):
        code.update(str(p.relative_to(root)).encode() + p.read_bytes())
    return {"git_commit": git("rev-parse", "HEAD"), "git_dirty": bool(git("status", "--porcelain")), "code_sha256": code.hexdigest(), "config": config or {}, "inputs": {k: file_hash(v) for k, v in (inputs or {}).items()}, "python": platform.python_version(), "pyspark": pyspark.__version__}


def file_hash(path: str) -> str | None:
    """Of a local file, or of all files of a local folder; None for what only Spark can read."""
    p = Path(path.removeprefix("file://"))
    if not p.exists():
        return None
    h = hashlib.sha256()
    for f in sorted(x for x in p.rglob("*") if x.is_file()) if p.is_dir() else [p]:
        with f.open("rb") as src:
            while block := src.read(1 << 20):
                h.update(block)
    return h.hexdigest()


def write_manifest(folder: str, files: dict[str, str], facts: dict) -> dict:
    """manifest.json: the hash of each file of the bundle, and facts."""
    body = {"files": {k: {"path": v, "sha256": file_hash(f"{folder}/{v}")} for k, v in files.items()}, **facts}
    save(body, f"{folder}/manifest.json")
    return body


def verify_bundle(folder: str) -> list[str]:
    """What is wrong with a bundle: missing and changed files, other versions."""
    import pyspark

    body = read(f"{folder}/manifest.json")
    out = []
    for name, f in body["files"].items():
        now = file_hash(f"{folder}/{f['path']}")
        if now is None:
            out.append(f"{name} is missing")
        elif now != f["sha256"]:
            out.append(f"{name} was changed")
    if (v := body.get("provenance", {}).get("pyspark")) and v != pyspark.__version__:
        out.append(f"pyspark {pyspark.__version__}, not {v}")
    return out


def diagnose(expected: dict[str, int], actual: dict[str, int]) -> str | None:
    """The earliest stage whose row count differs."""
    return next((k for k in expected if expected[k] != actual.get(k)), None)


def compare_runs(a: dict, b: dict, exact: float = 1e-9, close: float = 1e-3) -> str:
    """identical, close or different: structures must be equal, scores within the tolerances."""
    if {k: v for k, v in a.items() if not isinstance(v, float)} != {k: v for k, v in b.items() if not isinstance(v, float)}:
        return "different"
    gap = max((abs(v - b[k]) for k, v in a.items() if isinstance(v, float)), default=0.0)
    return "identical" if gap < exact else "close" if gap < close else "different"
