"""The whole run: split, validate, clean, null policy, features, select, train, bundle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import roles as role_names
from tallyforge.operators import drift, keys, nulls, profile, select, split, train
from tallyforge.plans import policy, spec
from tallyforge.sources import writers


@dataclass
class Ledger:
    """Data quality issues, folded by check and severity."""

    issues: list[dict] = field(default_factory=list)

    def add(self, check: str, severity: str, text: str) -> None:
        self.issues.append({"check": check, "severity": severity, "text": text})

    def folded(self) -> list[dict]:
        n = Counter((i["check"], i["severity"]) for i in self.issues)
        return [{"check": c, "severity": s, "n": k, "first": next(i["text"] for i in self.issues if (i["check"], i["severity"]) == (c, s))} for (c, s), k in sorted(n.items())]


@dataclass
class Result:
    roles: role_names.Roles
    replay: spec.Replay
    parts: dict[str, DataFrame]
    scorer: train.Scorer | None
    metrics: dict
    ledger: Ledger
    reports: dict


def split_single(df: DataFrame, r: role_names.Roles, row_keys: Sequence[str]) -> tuple[dict[str, DataFrame], split.SplitPlan]:
    """One table into its parts by a frozen plan."""
    date = r.date if r.date and dict(df.dtypes)[r.date].startswith(("timestamp", "date")) else None
    plan = split.fit_split(df, date)
    marked = split.apply_split(df, plan, r.target, row_keys)
    names = ("train", "valid_temporal", "valid_random", "oot") if plan.date_col else ("train", "valid", "test")
    return {n: marked.where(F.col(keys.SPLIT) == n).drop(keys.SPLIT) for n in names}, plan


def run(parts: dict[str, DataFrame] | DataFrame, target: str, entity: str | None = None, row_keys: Sequence[str] | None = None, composite: Sequence[str] = (), clean_policy: policy.Policy | None = None, feature_policy: policy.Policy | None = None, interactions: Sequence[tuple[str, str]] = (), model: str | None = "gbt", max_psi: float = 0.35) -> Result:
    """Fit on train, freeze, replay on every other part; without ``model`` it ends with the features."""
    first = parts if isinstance(parts, DataFrame) else parts["train"]
    t = role_names.find_target(first.columns, target)
    if t is None:
        raise ValueError(f"no target column {target}")
    r = role_names.resolve(first.columns, t, entity)
    r = role_names.Roles(r.target, r.entity, tuple(composite), r.date, r.identities)
    row_keys = list(row_keys or composite or ([r.entity] if r.entity else first.columns))
    ledger, reports = Ledger(), {}
    if isinstance(parts, DataFrame):
        parts, plan = split_single(parts, r, row_keys)
        reports["split"] = plan.to_dict()
    else:
        for i in drift.validate_schemas(parts, [t, *composite, *([r.entity] if r.entity else [])]):
            ledger.add("schema", i["severity"], f"{i['part']}: {i['column']} {i['issue']}")
    base = parts["train"]
    for name, df in parts.items():
        if name != "train":
            for x in drift.drift_report(base, df, list(r.protected)).where("warn").collect():
                ledger.add("drift", "warning", f"{name}: {x.feature} has a PSI of {x.psi}")
    drops = [x.column for x in profile.prefilter(base, list(r.protected)).collect()]
    cleaning, reports["cleaning"] = policy.fit_cleaning(base.drop(*drops), r, clean_policy, drops)
    for text in reports["cleaning"]["flags"]:
        ledger.add("profile", "warning", text)
    cleaned, _ = cleaning.apply_rows(cleaning.apply(base), row_keys)
    columns = [c for c in cleaned.columns if c not in r.protected and not dict(cleaned.dtypes)[c].startswith(("timestamp", "date"))]
    null_policy = nulls.fit_nulls(cleaned.select(*columns, *([t] if t not in columns else [])), columns=columns, label=t)
    filled = null_policy.apply(cleaned)
    imputed = [c for c, v in null_policy.fills.items() if v is not None]
    keep = [c for c in r.protected if c != t]
    features, reports["features"] = policy.fit_features(filled, t, keep, feature_policy, interactions, imputed)
    replay = spec.Replay(cleaning, null_policy, features)
    ready = {}
    for name, df in parts.items():
        ready[name], notes = replay.apply(df, name == "train", row_keys)
        for n in notes:
            ledger.add("replay", "warning", f"{name}: {n}")
    if not model:
        return Result(r, replay, ready, None, {}, ledger, reports)
    numeric = [c for c in profile.numeric_columns(ready["train"], [*r.protected, t])]
    other = next((ready[n] for n in ("oot", "test", "valid", "valid_temporal") if n in ready), ready["train"])
    judged = drift.psi_filter(ready["train"], other, numeric, most=max_psi).collect()
    chosen = [x.feature for x in judged if x.decision != "DROP"]
    if not chosen:
        ledger.add("drift", "warning", f"every feature has a PSI over {max_psi}: none is dropped")
        chosen = numeric
    kept, _ = select.prune_collinear(ready["train"], {c: -k for k, c in enumerate(chosen)}, select.NEAR_COPY) if len(chosen) > 1 else (chosen, [])
    learn = ready["train"]
    for name in ("valid", "valid_temporal", "valid_random"):
        if name in ready:
            learn = learn.unionByName(ready[name], allowMissingColumns=True)
    id_keys = [k for k in row_keys if k in learn.columns] or kept
    scorer, oof = train.fit_final(learn, kept, t, id_keys, model)
    scores = train.evaluate(scorer, ready, t)
    reports["psi"] = [x.asDict() for x in judged]
    reports["oof_auc"] = train.auc(oof, "oof", t).first().auc
    return Result(r, replay, ready, scorer, scores, ledger, reports)


def write_bundle(result: Result, folder: str) -> dict:
    """Replay spec, reports, models and a manifest with the hash of each file."""
    spec.save(result.replay.to_dict(), f"{folder}/replay.json")
    writers.write_json({"metrics": result.metrics, "issues": result.ledger.folded(), **result.reports}, f"{folder}/report.json")
    Path(folder, "report.md").write_text(render(result))
    files = {"replay": "replay.json", "report": "report.json", "summary": "report.md"}
    if result.scorer:
        for k, m in enumerate(result.scorer.models):
            m.write().overwrite().save(f"file://{Path(folder).resolve()}/model_{k}")
            files[f"model_{k}"] = f"model_{k}"
        spec.save({"features": result.scorer.features, "calibrator": result.scorer.calibrator.__dict__}, f"{folder}/scorer.json")
        files["scorer"] = "scorer.json"
    return spec.write_manifest(folder, files, {"provenance": spec.provenance(), "target": result.roles.target})


def render(result: Result) -> str:
    lines = ["# Run report", "", f"Target: {result.roles.target}", "", "| part | metric | value |", "|-|-|-|"]
    lines += [f"| {p} | {m} | {v} |" for p, ms in result.metrics.items() for m, v in ms.items()]
    lines += ["", "| check | severity | n | first |", "|-|-|-|-|"]
    lines += [f"| {i['check']} | {i['severity']} | {i['n']} | {i['first']} |" for i in result.ledger.folded()]
    return "\n".join(lines) + "\n"


def load_replay(folder: str) -> spec.Replay:
    """The replay of a verified bundle."""
    if wrong := spec.verify_bundle(folder):
        raise ValueError(f"the bundle can't be trusted: {wrong}")
    return spec.Replay.from_dict(spec.read(f"{folder}/replay.json"))
