"""Null policy: rules by column, fitted values, indicators, guards and a tamper-checked artifact."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.scalars import is_numeric, to_number
from tallyforge.operators.ordered import quantiles
from tallyforge.operators.profile import as_table, melt, null_profile, quoted, wide

# Strategies and the groups they may serve, the category for nulls, version, thresholds.
STRATEGIES = {
    "none": {"numerical", "binary", "categorical"}, "zero": {"numerical", "binary"}, "mean": {"numerical"}, "median": {"numerical"},
    "constant": {"numerical", "binary", "categorical"}, "explicit_category": {"categorical"}, "missing_indicator_only": {"numerical", "binary", "categorical"},
}
MISSING, VERSION = "__MISSING__", 1
INDICATOR_RATE, MAX_INDICATORS = 0.02, 300
SCALE_FAIL, SCALE_WARN, SCALE_ROWS, RATE_DRIFT = 10.0, 3.0, 100, 0.10


@dataclass(frozen=True)
class Rule:
    strategy: str
    indicator: bool = False
    constant: float | str | None = None
    group: str = "numerical"


def check_rule(name: str, rule: Rule) -> None:
    if rule.strategy not in STRATEGIES:
        raise ValueError(f"{name}: unknown strategy {rule.strategy}")
    if rule.group not in STRATEGIES[rule.strategy]:
        raise ValueError(f"{name}: {rule.strategy} does not suit a {rule.group} column")
    if rule.strategy == "constant" and rule.constant is None:
        raise ValueError(f"{name}: constant needs a value")


def resolve_rules(groups: dict[str, str], defaults: dict[str, Rule], families: dict[str, tuple[Sequence[str], Rule]] | None = None, overrides: dict[str, Rule] | None = None) -> dict[str, Rule]:
    """A rule for each column: override, else family, else the default of its group. Two families for one column conflict."""
    by: dict[str, str] = {}
    for name, (columns, _) in (families or {}).items():
        for c in columns:
            if c in by:
                raise ValueError(f"{c} is in the families {by[c]} and {name}")
            by[c] = name
    if unknown := [c for c in (overrides or {}) if c not in groups]:
        raise ValueError(f"overrides for unknown columns {unknown}")
    out = {}
    for c, g in groups.items():
        r = (overrides or {}).get(c) or (families[by[c]][1] if c in by else defaults.get(g, Rule("none", group=g)))
        out[c] = Rule(r.strategy, r.indicator, r.constant, g)
        check_rule(c, out[c])
    return out


def heuristic_rules(profile: Sequence[dict]) -> dict[str, Rule]:
    """The default policy from rows of ``null_profile``."""
    out = {}
    for p in profile:
        g, miss = p["group"], p["missing_rate"]
        if miss >= 1:
            rule = Rule("none", group=g)
        elif g == "categorical":
            rule = Rule("explicit_category", group=g)
        elif g == "binary":
            rule = Rule("missing_indicator_only", True, group=g) if miss > 0 else Rule("none", group=g)
        else:
            rule = Rule("median", miss > INDICATOR_RATE, group=g)
        out[p["column"]] = rule
    return out


def guard_rules(rules: dict[str, Rule], profile: Sequence[dict], structural: Sequence[str] = ()) -> dict[str, Rule]:
    """Suggested rules within bounds: zero only where zeros occur and nothing is negative; indicators where nulls matter."""
    facts, out = {p["column"]: p for p in profile}, {}
    for c, r in rules.items():
        p = facts[c]
        if p["missing_rate"] >= 1:
            out[c] = Rule("none", group=p["group"])
            continue
        strategy, indicator = r.strategy, r.indicator
        if strategy == "zero" and not ((p["min"] or 0) >= 0 and p["zero_rate"] > 0 and p["min"] is not None):
            strategy, indicator = ("median" if p["group"] == "numerical" else "missing_indicator_only"), True
        if p["missing_rate"] > 0 and (c in structural or p["missing_rate"] > INDICATOR_RATE) and p["group"] != "categorical":
            indicator = True
        out[c] = Rule(strategy, indicator or strategy == "missing_indicator_only", r.constant, p["group"])
    return out


def read_suggestions(text: str) -> dict[str, dict]:
    """Column rules out of free text: whole JSON, or else each well-formed {"column": ...} object in it."""
    try:
        got = json.loads(text)
        items = got.get("rules", got) if isinstance(got, dict) else got
        return {x["column"]: x for x in items if isinstance(x, dict) and "column" in x} if isinstance(items, list) else {k: v for k, v in items.items() if isinstance(v, dict)}
    except (ValueError, AttributeError):
        out, decoder, at = {}, json.JSONDecoder(), 0
        while (at := text.find("{", at)) >= 0:
            try:
                obj, end = decoder.raw_decode(text, at)
            except ValueError:
                at += 1
                continue
            if isinstance(obj, dict) and "column" in obj:
                out[obj["column"]] = obj
            at = end
        return out


def valid_suggestions(found: dict[str, dict], groups: dict[str, str]) -> tuple[dict[str, Rule], list[str]]:
    """Rules that name known columns and suit their group; the rest as warnings."""
    rules, warnings = {}, []
    for c, x in found.items():
        rule = Rule(str(x.get("strategy")), bool(x.get("indicator", x.get("add_indicator", False))), x.get("constant"), groups.get(c, ""))
        try:
            if c not in groups:
                raise ValueError(f"{c}: unknown column")
            check_rule(c, rule)
        except ValueError as e:
            warnings.append(str(e))
        else:
            rules[c] = rule
    return rules, warnings


def clean_value(df: DataFrame, c: str, rule: Rule) -> Column:
    """The value with infinities, NaN and unparseable text as null."""
    if rule.group == "categorical":
        return quoted(c).cast("string")
    d = quoted(c).cast("double") if is_numeric(df, c) or isinstance(df.schema[c].dataType, T.BooleanType) else to_number(quoted(c))
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def magnitudes(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Finite values as doubles."""
    d = {c: quoted(c).cast("double") for c in columns}
    return {c: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for c, v in d.items()}


def statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By numeric column: missing and zero rate, min, mean, median, p95, max, and the same of non-zero magnitudes."""
    d = magnitudes(df, columns)
    want = {"n": F.count("*")}
    for c, v in d.items():
        want |= {f"{k}:{c}": g for k, g in (("c", F.count(v)), ("z", F.count(F.when(v == 0, 1))), ("lo", F.min(v)), ("avg", F.avg(v)), ("hi", F.max(v)))}
    got = wide(df, want)
    of = {f"{k}:{c}": x for c, v in d.items() for k, x in (("d", v), ("a", F.abs(v)), ("nz", F.abs(F.when(v != 0, v))))}
    q = quantiles(of, df, [0.5, 0.95])
    rows = []
    for c in columns:
        n, zeros = got[f"c:{c}"], got[f"z:{c}"]
        mids = [x for k in ("d", "a", "nz") for x in (q[f"{k}:{c}"] or [None, None])]
        rows.append((c, (got["n"] - n) / got["n"] if got["n"] else 0.0, zeros / n if n else 0.0, got[f"lo:{c}"], got[f"avg:{c}"], mids[0], mids[1], got[f"hi:{c}"], *mids[2:], n - zeros))
    names = ("missing_rate", "zero_rate", "min", "mean", "median", "p95", "max", "abs_median", "abs_p95", "nz_median", "nz_p95")
    return as_table(df, rows, "column string, " + ", ".join(f"{x} double" for x in names) + ", nz_count long")


def nonzero_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By numeric column: median, p95 and count of the magnitudes that are not zero."""
    d = {c: F.abs(F.when(v != 0, v)) for c, v in magnitudes(df, columns).items()}
    n, q = wide(df, {c: F.count(v) for c, v in d.items()}), quantiles(d, df, [0.5, 0.95])
    return as_table(df, [(c, *(q[c] or (None, None)), n[c]) for c in columns], "column string, nz_median double, nz_p95 double, nz_count long")


def missing_drift(train: DataFrame, other: DataFrame, columns: Sequence[str], most: float = RATE_DRIFT) -> DataFrame:
    """(column, train_rate, other_rate, drifted)."""
    rate = lambda c: F.coalesce(F.round(F.try_divide(F.count(F.when(quoted(c).isNull(), 1)), F.count("*")), 6), F.lit(0.0))
    side = lambda df, n: df.agg(F.array(*[F.struct(F.lit(c).alias("column"), rate(c).alias(n)) for c in columns]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    both = side(train, "train_rate").join(side(other, "other_rate"), "column")
    return both.withColumn("drifted", F.abs(F.col("other_rate") - F.col("train_rate")) > most)


def scale_guard(train: DataFrame, other: DataFrame, columns: Sequence[str], fail: float = SCALE_FAIL, warn: float = SCALE_WARN, least: int = SCALE_ROWS) -> DataFrame:
    """(column, median_ratio, p95_ratio, verdict): fail only if both magnitudes move the same way by ``fail`` or more."""
    pick = lambda df, s: nonzero_statistics(df, columns).select("column", *[F.col(c).alias(c + s) for c in ("nz_median", "nz_p95", "nz_count")])
    j = pick(train, "_t").join(pick(other, "_o"), "column")
    m, p = F.try_divide(F.col("nz_median_o"), F.col("nz_median_t")), F.try_divide(F.col("nz_p95_o"), F.col("nz_p95_t"))
    far = lambda limit: ((m >= limit) & (p >= limit)) | ((m <= 1 / limit) & (p <= 1 / limit))
    judged = (F.col("nz_count_t") >= least) & (F.col("nz_count_o") >= least)
    verdict = F.when(~judged, "not_judged").when(F.lit(fail > 0) & far(fail or 1.0), "fail").when(far(warn), "warn").otherwise("pass")
    return j.select("column", F.round(m, 6).alias("median_ratio"), F.round(p, 6).alias("p95_ratio"), verdict.alias("verdict"))


def indicator_columns(df: DataFrame, rules: dict[str, Rule], most: int = MAX_INDICATORS, label: str | None = None) -> list[str]:
    """Columns that get an indicator: not constant, one of those with equal null patterns, strongest |z| with the label.

    Where the indicator is the whole strategy it always stays.
    """
    always = [c for c, r in rules.items() if r.strategy == "missing_indicator_only" and c in df.columns]
    ask = [c for c, r in rules.items() if r.indicator and c in df.columns and c not in always]
    if not ask:
        return always
    y = quoted(label).cast("double") if label else F.lit(0.0)
    row = F.xxhash64(*[quoted(c) for c in df.columns])
    null = {c: clean_value(df, c, rules[c]).isNull() for c in ask}
    got = wide(df, {"n": F.count("*"), "y": F.avg(y), **{f"{k}:{c}": e for c in ask for k, e in (("n", F.count(F.when(null[c], 1))), ("x", F.bit_xor(F.when(null[c], row))), ("s", F.sum(F.when(null[c], F.shiftright(row, 20)).cast("decimal(38,0)"))), ("y", F.avg(F.when(null[c], y))))}})
    seen, out = set(), []
    for c in ask:
        n, pattern = got[f"n:{c}"], (got[f"n:{c}"], got[f"x:{c}"], got[f"s:{c}"])
        if 0 < n < got["n"] and pattern not in seen:
            seen.add(pattern)
            p, base, rest = got[f"y:{c}"] or 0.0, got["y"] or 0.0, got["n"] - n
            other = (base * got["n"] - p * n) / rest
            se = math.sqrt(max(base * (1 - base), 1e-12) * (1 / n + 1 / rest))
            out.append((abs(p - other) / se, c))
    keep = {c for _, c in sorted(out, key=lambda x: (-x[0], x[1]))[:most]}
    return [c for c in rules if c in keep or c in always]


@dataclass(frozen=True)
class NullPolicy:
    rules: dict[str, Rule]
    fills: dict[str, float | str | None]
    indicators: tuple[str, ...] = ()
    stats: dict[str, dict] = field(default_factory=dict)

    def apply(self, df: DataFrame, strict: bool = True) -> DataFrame:
        """Indicators first, then fills, as one projection. A missing column is an error."""
        lost = [c for c in self.rules if c not in df.columns]
        if lost and strict:
            raise ValueError(f"columns of the null policy are missing: {lost}")
        out = {}
        for c, r in self.rules.items():
            if c in df.columns:
                v = clean_value(df, c, r)
                if c in self.indicators:
                    out[f"{c}_missing"] = v.isNull().cast("tinyint")
                fill = self.fills.get(c)
                out[c] = v if fill is None else F.coalesce(v, F.lit(fill))
        return df.withColumns(out) if out else df

    def guard(self, train_like: DataFrame, batch: DataFrame, action: str = "raise", on_warning: Callable[[str], None] | None = None) -> list[str]:
        """Scale and missing-rate guards of a batch against a training sample; failures raise unless told to warn."""
        cols = [c for c, r in self.rules.items() if r.group == "numerical" and c in batch.columns and is_numeric(batch, c)]
        if not cols:
            return []
        notes = [f"{r.column}: scale {r.verdict} (median x{r.median_ratio}, p95 x{r.p95_ratio})" for r in scale_guard(train_like, batch, cols).collect() if r.verdict in ("fail", "warn")]
        bad = [n for n in notes if "scale fail" in n]
        notes += [f"{r.column}: missing rate {r.train_rate} became {r.other_rate}" for r in missing_drift(train_like, batch, cols).collect() if r.drifted]
        if bad and action == "raise":
            raise ValueError("; ".join(bad))
        for n in notes:
            (on_warning or (lambda _: None))(n)
        return notes

    def to_dict(self) -> dict:
        body = {"version": VERSION, "features": {c: {"rule": r.__dict__, "imputation_value": self.fills.get(c), "stats": self.stats.get(c, {})} for c, r in self.rules.items()}, "indicator_columns": list(self.indicators)}
        return body | {"sha256": digest(body)}

    @classmethod
    def from_dict(cls, d: dict) -> NullPolicy:
        body = {k: v for k, v in d.items() if k != "sha256"}
        if body.get("version") != VERSION:
            raise ValueError(f"null policy of version {body.get('version')}, not {VERSION}")
        if digest(body) != d.get("sha256"):
            raise ValueError("the null policy was changed after it was written")
        f = body["features"]
        return cls({c: Rule(**x["rule"]) for c, x in f.items()}, {c: x["imputation_value"] for c, x in f.items()}, tuple(body["indicator_columns"]), {c: x["stats"] for c, x in f.items()})


def digest(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def fit_nulls(df: DataFrame, rules: dict[str, Rule] | None = None, columns: Sequence[str] | None = None, label: str | None = None) -> NullPolicy:
    """Fill values of all rules in one wide aggregate; without rules, the heuristic ones."""
    columns = list(columns or [c for c in df.columns if c != label])
    if rules is None:
        rules = heuristic_rules([r.asDict() for r in null_profile(df, columns).collect()])
    for c, r in rules.items():
        check_rule(c, r)
    want = {c: (F.avg(clean_value(df, c, r)) if r.strategy == "mean" else F.percentile(clean_value(df, c, r), F.lit(0.5))) for c, r in rules.items() if r.strategy in ("mean", "median")}
    got = wide(df, want) if want else {}
    fixed = {"zero": 0.0, "explicit_category": MISSING}
    fills = {c: got.get(c, r.constant if r.strategy == "constant" else fixed.get(r.strategy)) for c, r in rules.items()}
    numeric = [c for c, r in rules.items() if r.group != "categorical" and is_numeric(df, c)]
    stats = {r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in statistics(df, numeric).collect()} if numeric else {}
    return NullPolicy(dict(rules), fills, tuple(indicator_columns(df, rules, label=label)), stats)
