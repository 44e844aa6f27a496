"""Decisions: rules by default, or the JSON actions of a callable, both behind the same guards."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import roles as role_names
from tallyforge.functions import expr
from tallyforge.operators import binning, clean, encode, profile, select
from tallyforge.operators.profile import quoted
from tallyforge.plans.spec import FeatureSpec, Interaction

# Thresholds of the default rules.
NULL_DROP, DUPLICATES, OUTLIERS, VIOLATIONS, SOFT, REPEATED = 90.0, 1.0, 3.0, 1.0, 0.5, 10.0
IMBALANCE, AMBIGUOUS, ORPHANS = 20.0, 5.0, 5.0
ORDER = {"drop_column": 0, "fix_column_dtype": 1, "drop_duplicates": 2, "deduplicate_by_key": 2, "clip_outliers": 3}
NOTES = frozenset({"note", "flag", "none", "comment", "skip"})

Policy = Callable[[dict], str | dict]


def find_json(text: str) -> dict:
    """The largest JSON object in free text, past reasoning tags and code fences; empty if there is none."""
    text = re.sub(r"<(think|reasoning)>.*?</\1>", " ", text, flags=re.S)
    decoder, best, at = json.JSONDecoder(), ({}, 0), 0
    while (at := text.find("{", at)) >= 0:
        try:
            obj, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        if isinstance(obj, dict) and end - at > best[1]:
            best = (obj, end - at)
        at = end
    return best[0]


def actions_of(answer: str | dict, known: Sequence[str]) -> tuple[list[dict], list[str]]:
    """(actions, warnings): entries that aren't objects or name no known action are warned about, notes are left out."""
    body = find_json(answer) if isinstance(answer, str) else answer
    out, warnings = [], []
    for a in body.get("actions", []) if isinstance(body.get("actions", []), list) else []:
        kind = a.get("action") if isinstance(a, dict) else None
        if kind in NOTES:
            continue
        if kind in known:
            out.append(a)
        else:
            warnings.append(f"unknown action {kind}")
    return out, warnings


@dataclass
class Findings:
    """What profiling saw, as plain values that a policy may read."""

    columns: list[dict]
    duplicate_pct: float
    outliers: dict[str, dict]
    formats: list[dict]
    keys: dict
    imbalance: float | None
    flags: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return self.__dict__


def inspect(df: DataFrame, r: role_names.Roles) -> Findings:
    """A bounded number of wide jobs over the training rows."""
    columns = [x.asDict() for x in profile.column_metadata(df).collect()]
    dup = profile.n_duplicates(df).first().duplicate_pct
    numeric = [c for c in profile.numeric_columns(df, r.protected)][:10]
    outliers = {x.column: x.asDict() for x in profile.detect_outliers(df, numeric).collect()} if numeric else {}
    formats = [x.asDict() for x in profile.column_formats(df).collect()]
    keys: dict = {}
    if r.keys:
        keys = profile.key_violations(df, r.keys, r.target).first().asDict()
        keys["soft_pct"] = profile.soft_duplicates(df, r.keys).first().pct
    if r.entity:
        keys["repeated_pct"] = profile.rows_per_entity(df, r.entity).first().over_pct
    flags, imbalance = [], None
    if r.target:
        first = profile.label_quality(df, r.target).where("class is not null").first()
        imbalance = first.imbalance if first else None
        if imbalance and imbalance > IMBALANCE:
            flags.append(f"imbalance {imbalance}")
    if r.entity and r.identities:
        o = profile.orphans(df, r.entity, r.identities).first()
        if o.n_entities and 100 * o.n_orphans / o.n_entities > ORPHANS:
            flags.append(f"{o.n_orphans} entities have rows without an identity")
    flags += [f"{c} may leak the target" for c in role_names.leaks_by_name(df.columns, r.target)]
    return Findings(columns, dup, outliers, formats, keys, imbalance, flags)


def cleaning_rules(f: dict, r: role_names.Roles) -> dict:
    """The default cleaning decisions as actions."""
    acts = []
    for c in f["columns"]:
        all_unique = c["n_rows"] > 1 and c["n_unique"] == c["n_rows"] and c["nulls"] == 0
        numeric_id = c["column"] in f["outliers"]
        if c["column"] not in r.protected and (c["null_pct"] > NULL_DROP or c["is_constant"] or all_unique and not numeric_id and c["column"] != r.entity):
            acts.append({"action": "drop_column", "column": c["column"]})
    gone = {a["column"] for a in acts}
    kinds = {"numeric_as_string": "to_numeric", "date_as_string": "to_datetime", "whitespace": "strip_whitespace", "mixed_case": "standardize_case"}
    acts += [{"action": "fix_column_dtype", "column": x["column"], "fix_type": kinds[x["issue"]]} for x in f["formats"] if x["issue"] in kinds and x["column"] not in gone]
    if f["duplicate_pct"] > DUPLICATES:
        acts.append({"action": "drop_duplicates"})
    k = f["keys"]
    if r.keys and (k.get("contaminated") or k.get("n_keys") and 100 * k["violations"] / k["n_keys"] > VIOLATIONS or k.get("soft_pct", 0) > SOFT):
        acts.append({"action": "deduplicate_by_key", "columns": list(r.keys), "keep": "first"})
    acts += [{"action": "clip_outliers", "column": c, "factor": 3.0} for c, o in f["outliers"].items() if c not in gone and o["outlier_pct"] > OUTLIERS and not o["zero_inflated"]]
    return {"reasoning": "default rules", "actions": acts}


def fit_cleaning(df: DataFrame, r: role_names.Roles, policy: Policy | None = None, extra_drops: Sequence[str] = ()) -> tuple[clean.CleaningSpec, dict]:
    """Profile, decide, guard, freeze. A policy whose answer has no usable action falls back to the rules."""
    found = inspect(df, r)
    facts = {c["column"]: c for c in found.columns}
    acts, warnings = actions_of(policy(found.to_dict()), ORDER) if policy else ([], [])
    if not acts:
        acts, _ = actions_of(cleaning_rules(found.to_dict(), r), ORDER)
    drops, fixes, rows, clips = list(extra_drops), [], [], []
    for a in sorted(acts, key=lambda a: ORDER[a["action"]]):
        kind, c = a["action"], a.get("column")
        if kind in ("drop_column", "fix_column_dtype", "clip_outliers") and c not in df.columns:
            warnings.append(f"{kind}: no column {c}")
        elif kind == "drop_column":
            m = facts[c]
            if c in r.protected:
                warnings.append(f"{c} is protected")
            elif m["is_constant"] or m["null_pct"] > NULL_DROP or m["n_unique"] == m["n_rows"]:
                drops.append(c)
            else:
                warnings.append(f"{c} is neither constant, nor a row id, nor mostly null: kept")
        elif kind == "fix_column_dtype":
            if c not in drops and c != r.target:
                fixes.append(clean.date_fix(df, c) if a.get("fix_type") == "to_datetime" else (c, a.get("fix_type"), None))
        elif kind == "drop_duplicates":
            rows.append({"op": "drop_duplicates"})
        elif kind == "deduplicate_by_key":
            keys = [k for k in a.get("columns", []) if k != r.target and k in df.columns]
            if keys:
                rows.append({"op": "deduplicate_by_key", "keys": keys, "keep": a.get("keep", "first")})
        elif c not in r.protected and c not in drops:
            clips.append((c, float(a.get("factor", 3.0))))
    bounds: dict[str, list[float]] = {}
    for factor in sorted({x[1] for x in clips}):
        bounds |= clean.fit_clip(df, [c for c, x in clips if x == factor], factor)
    warnings += [f"{c}: no spread between the quartiles, not clipped" for c, _ in clips if c not in bounds]
    spec = clean.CleaningSpec(tuple(drops), tuple(fixes), bounds, tuple(rows))
    return spec, {"actions": acts, "warnings": warnings, "flags": found.flags, "findings": found.to_dict()}


FEATURE_ACTIONS = ("encode_all", "label_encode", "onehot_encode", "create_interaction", "compute_iv", "apply_woe_transform", "compute_correlation", "select_top_features")


def feature_rules(columns: Sequence[str], interactions: Sequence[tuple[str, str]] = ()) -> dict:
    acts: list[dict] = [{"action": "encode_all", "method": "label"}]
    acts += [{"action": "create_interaction", "new_col": n, "expression": e} for n, e in interactions]
    acts += [{"action": "compute_iv", "bins": 10}, {"action": "compute_correlation"}, {"action": "select_top_features", "criterion": "iv", "k": select.suggested_k(len(columns))}]
    return {"reasoning": "default rules", "actions": acts}


def fit_features(df: DataFrame, target: str, protected: Sequence[str] = (), policy: Policy | None = None, interactions: Sequence[tuple[str, str]] = (), imputed: Sequence[str] = ()) -> tuple[FeatureSpec, dict]:
    """Encode, interact, score, select; every step is recorded and replayed in its order."""
    stay = {target, *protected}
    report: dict = {"warnings": []}
    acts, report["warnings"] = actions_of(policy({"columns": dict(df.dtypes), "target": target}), FEATURE_ACTIONS) if policy else ([], [])
    if not acts:
        acts, _ = actions_of(feature_rules(df.columns, interactions), FEATURE_ACTIONS)
    steps: list[str] = []
    made: list[Interaction] = []
    labels: dict[str, list[str]] = {}
    hots: dict[str, list[str]] = {}
    woes: dict[str, binning.WoeMap] = {}
    selected: list[str] = []
    now = df
    for a in acts:
        kind = a["action"]
        if kind in ("encode_all", "label_encode", "onehot_encode"):
            rest = now if kind == "encode_all" else now.select(*[c for c in a.get("columns", [a.get("column")]) if c in now.columns])
            method = a.get("method", "label") if kind == "encode_all" else "onehot" if kind == "onehot_encode" else "label"
            new_labels, new_hots = encode.fit_all(rest, list(stay), method)
            labels |= new_labels
            hots |= new_hots
            steps += [f"label:{c}" for c in new_labels] + [f"onehot:{c}" for c in new_hots]
            now = encode.apply_onehot(encode.apply_labels(now, new_labels), new_hots)
        elif kind == "create_interaction":
            name, text = a.get("new_col"), a.get("expression", "")
            used = set(re.findall(r"df\[\s*'([^']+)'", text))
            if name in now.columns or used & stay or ("isna" in text or "isnull" in text) and used & set(imputed):
                report["warnings"].append(f"{name}: skipped (existing, protected or already imputed columns)")
                continue
            try:
                compiled, fill, constant = expr.fit_interaction(now, text)
            except (expr.Unsafe, KeyError, ValueError) as e:
                report["warnings"].append(f"{name}: {e}")
                continue
            if constant:
                report["warnings"].append(f"{name}: constant")
                continue
            made.append(Interaction(name, text, fill, compiled.stats))
            steps.append(f"interaction:{name}")
            now = now.withColumn(name, expr.interaction(now, compiled, fill))
        elif kind == "compute_iv":
            report["iv"] = [r.asDict() for r in binning.compute_iv(now.drop(*protected), target, bins=int(a.get("bins", 10)), top=20).collect()]
        elif kind == "apply_woe_transform":
            columns = [c for c in profile.numeric_columns(now, stay)]
            woes = binning.fit_woe(now, target, columns, min_iv=float(a.get("min_iv", binning.USABLE)))
            steps += [f"woe:{c}" for c in woes]
            now = binning.apply_woe(now, woes)
        elif kind == "compute_correlation":
            columns = profile.numeric_columns(now, stay)
            report["correlation"] = [r.asDict() for r in select.target_correlation(now, target, columns).collect()] if columns else []
        elif kind == "select_top_features":
            selected = select.select_top(now, target, int(a.get("k") or select.suggested_k(len(now.columns))), a.get("criterion", "iv"), protected)
    keep = [c for c in (selected or now.columns) if c != target]
    return FeatureSpec(tuple(steps), tuple(made), labels, hots, woes, tuple(keep), target), report


#: What a policy may ask for, by name: each takes the frame first.
OPERATORS: dict[str, Callable] = {
    "inspect_metadata": profile.inspect_metadata, "get_column_stats": profile.numeric_stats, "value_counts": profile.value_counts, "detect_outliers": profile.detect_outliers, "check_label_quality": profile.label_quality,
    "check_temporal": profile.temporal_profile, "check_duplicates": profile.n_duplicates, "check_soft_duplicates": profile.soft_duplicates, "check_column_formats": profile.column_formats, "drop_column": clean.drop_column,
    "clip_outliers": clean.fit_clip, "prefilter": profile.prefilter, "compute_iv": binning.compute_iv, "compute_correlation": select.target_correlation, "select_top_features": select.select_top, "label_encode": encode.fit_labels,
    "onehot_encode": encode.fit_onehot, "create_interaction": expr.fit_interaction, "entity_resolution": profile.entity_resolution,
}


def run_operator(name: str, df: DataFrame, **arguments):
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name}; known: {sorted(OPERATORS)}")
    return OPERATORS[name](df, **arguments)


def ambiguous_share(df: DataFrame, entity: str, identity: str) -> float:
    r = profile.entity_resolution(df, entity, [identity]).first()
    return 100.0 * r.ambiguous_values / r.n_values if r.n_values else 0.0


def future_rows(df: DataFrame, date: str, now: str) -> int:
    return df.where(quoted(date) > F.lit(now).cast("timestamp")).count()
