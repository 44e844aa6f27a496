"""Safe expressions: Python syntax over ``df['a']`` and ``np``, checked by an allowlist and compiled to Columns.

Nothing is evaluated. Whole-frame reductions become numbers at fit time (``Compiled.stats``) and stay frozen on replay.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.scalars import clip, ieee_divide
from tallyforge.operators.ordered import quantiles
from tallyforge.operators.profile import quoted

# Limits and the names an expression may use.
MAX_CHARS, MAX_NODES, MAX_CONST, MAX_POWER = 600, 250, 1e15, 10
NUMPY = frozenset(
    "log log1p log2 log10 exp expm1 sqrt abs absolute sign floor ceil round power square tanh sin cos where select minimum maximum clip nan_to_num isnan isfinite mean median nan inf pi float64 int64 divide".split()
)
METHODS = frozenset(
    "astype isna isnull notna notnull fillna clip abs round where mask replace between isin pow div mul add sub floordiv mod eq ne lt le gt ge log sqrt exp floor ceil sign to_numpy values loc mean min max std var sum median count nunique prod any all rank cumsum diff".split()
)
REDUCTIONS = frozenset("mean min max std var sum median count nunique prod any all".split())
BUILTINS = frozenset("int float bool str abs min max round len".split())
NODES = (
    ast.Expression, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.Call, ast.Constant, ast.Name, ast.Load, ast.Attribute, ast.Subscript, ast.List, ast.Tuple, ast.IfExp, ast.keyword,
    ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow, ast.BitAnd, ast.BitOr, ast.BitXor, ast.Invert, ast.Not, ast.And, ast.Or, ast.USub, ast.UAdd,
    ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn, ast.Is, ast.IsNot,
)


class Unsafe(ValueError):
    """An expression outside the allowlist."""


def is_text(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, str | bytes)


def validate(text: str) -> ast.Expression:
    """The parsed expression, or ``Unsafe`` with the reason."""
    if len(text) > MAX_CHARS:
        raise Unsafe(f"longer than {MAX_CHARS} characters")
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError) as e:
        raise Unsafe(f"not an expression: {e}") from e
    nodes = list(ast.walk(tree))
    if len(nodes) > MAX_NODES:
        raise Unsafe(f"more than {MAX_NODES} nodes")
    for n in nodes:
        if not isinstance(n, NODES):
            raise Unsafe(f"{type(n).__name__} is not allowed")
        if isinstance(n, ast.Name) and n.id not in {"df", "np"} | BUILTINS:
            raise Unsafe(f"the name {n.id} is not allowed")
        if isinstance(n, ast.Attribute):
            if n.attr.startswith("_"):
                raise Unsafe("private attributes are not allowed")
            if isinstance(n.value, ast.Name) and n.value.id == "np":
                if n.attr not in NUMPY:
                    raise Unsafe(f"np.{n.attr} is not allowed")
            elif isinstance(n.value, ast.Name) and n.value.id == "df":
                raise Unsafe("columns are written df['name'], not as attributes")
            elif n.attr not in METHODS:
                raise Unsafe(f"the method {n.attr} is not allowed")
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id not in BUILTINS:
            raise Unsafe("only built-in functions of the allowlist may be called")
        if isinstance(n, ast.BinOp):
            if is_text(n.left) or is_text(n.right):
                raise Unsafe("arithmetic on text is not allowed")
            if isinstance(n.op, ast.Pow):
                p = n.right.operand if isinstance(n.right, ast.UnaryOp) else n.right
                if not (isinstance(p, ast.Constant) and isinstance(p.value, int | float) and abs(p.value) <= MAX_POWER):
                    raise Unsafe(f"powers need a constant exponent of {MAX_POWER} at most")
        if isinstance(n, ast.Constant):
            if isinstance(n.value, int | float) and not isinstance(n.value, bool) and abs(n.value) > MAX_CONST:
                raise Unsafe("a constant is too large")
            if isinstance(n.value, bytes | complex):
                raise Unsafe("bytes and complex constants are not allowed")
    return tree


UNARY: dict[str, Callable[[Column], Column]] = {
    "log": F.log, "log1p": F.log1p, "log2": F.log2, "log10": F.log10, "exp": F.exp, "expm1": F.expm1, "sqrt": F.sqrt, "abs": F.abs, "absolute": F.abs, "sign": F.signum,
    "floor": F.floor, "ceil": F.ceil, "tanh": F.tanh, "sin": F.sin, "cos": F.cos, "square": lambda c: c * c,
}
TYPES = {"int": "bigint", "int64": "bigint", "float": "double", "float64": "double", "bool": "boolean", "str": "string"}


@dataclass
class Compiled:
    """An expression as a Column factory, with the frozen statistics it needs."""

    text: str
    stats: dict[str, float] = field(default_factory=dict)

    def column(self, df: DataFrame) -> Column:
        return Compiler(df, self.stats).compile(validate(self.text).body)


def fit_expression(df: DataFrame, text: str) -> Compiled:
    """Compile, computing each whole-frame reduction once, in one job."""
    tree = validate(text)
    need = Compiler(df, None)
    need.compile(tree.body)
    if not need.wanted:
        return Compiled(text)
    got = df.agg(*[e.alias(k) for k, e in need.wanted.items()]).first().asDict()
    return Compiled(text, {k: None if v is None else float(v) for k, v in got.items()})


class Compiler:
    """``stats`` None: collect the reductions in ``wanted`` and use placeholders."""

    def __init__(self, df: DataFrame, stats: dict[str, float] | None):
        self.df, self.stats, self.wanted = df, stats, {}

    def number(self, key: str, agg: Column) -> Column:
        if self.stats is None:
            self.wanted[key] = agg
            return F.lit(1.0)
        return F.lit(self.stats[key]).cast("double")

    def compile(self, n: ast.AST):
        got = getattr(self, "on_" + type(n).__name__, None)
        if got is None:
            raise Unsafe(f"{type(n).__name__} has no column form")
        return got(n)

    def col(self, n: ast.AST) -> Column:
        v = self.compile(n)
        return v if isinstance(v, Column) else F.lit(v)

    def on_Constant(self, n):  # noqa: N802
        return n.value

    def on_Name(self, n):  # noqa: N802
        if n.id in TYPES:
            return n.id
        raise Unsafe(f"{n.id} alone is no value")

    def names(self, n: ast.AST) -> list[str]:
        return [e.value for e in n.elts] if isinstance(n, ast.List | ast.Tuple) else [n.value]

    def on_Subscript(self, n):  # noqa: N802
        if isinstance(n.value, ast.Name) and n.value.id == "df":
            names = self.names(n.slice)
            if lost := [c for c in names if c not in self.df.columns]:
                raise KeyError(f"no column {lost[0]}")
            cols = [self.value_of(c) for c in names]
            return cols if isinstance(n.slice, ast.List) else cols[0]
        raise Unsafe("only df can be indexed")

    def value_of(self, c: str) -> Column:
        t = self.df.schema[c].dataType
        v = quoted(c)
        return v.cast("double") if isinstance(t, T.NumericType) else v

    def on_Attribute(self, n):  # noqa: N802
        if isinstance(n.value, ast.Name) and n.value.id == "np":
            consts = {"nan": float("nan"), "inf": float("inf"), "pi": math.pi, "float64": "float64", "int64": "int64"}
            if n.attr in consts:
                return consts[n.attr]
            raise Unsafe(f"np.{n.attr} must be called")
        if n.attr == "values":
            return self.compile(n.value)
        raise Unsafe(f"{n.attr} must be called")

    def bool_(self, n: ast.AST) -> Column:
        return self.col(n).cast("boolean")

    def on_BinOp(self, n):  # noqa: N802
        a, b = self.compile(n.left), self.compile(n.right)
        if not isinstance(a, Column) and not isinstance(b, Column):
            a = F.lit(a)
        return self.binary(type(n.op).__name__, a, b)

    def binary(self, op: str, a, b) -> Column:
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
        if op in ("BitAnd", "BitOr", "BitXor"):
            p, q = F.coalesce(a.cast("boolean"), F.lit(False)), F.coalesce(b.cast("boolean"), F.lit(False))
            return p & q if op == "BitAnd" else p | q if op == "BitOr" else p != q
        a, b = a.cast("double"), b.cast("double")
        if op == "Mod":
            return F.when(b == 0, F.lit(float("nan"))).otherwise(a - F.floor(F.try_divide(a, b)) * b)
        return {"Add": lambda: a + b, "Sub": lambda: a - b, "Mult": lambda: a * b, "Div": lambda: ieee_divide(a, b), "FloorDiv": lambda: F.when(b == 0, ieee_divide(a, b)).otherwise(F.floor(F.try_divide(a, b)).cast("double")), "Pow": lambda: F.pow(a, b)}[op]()

    def on_UnaryOp(self, n):  # noqa: N802
        v = self.compile(n.operand)
        if isinstance(n.op, ast.USub):
            return -v
        if isinstance(n.op, ast.UAdd):
            return v
        return ~F.coalesce((v if isinstance(v, Column) else F.lit(v)).cast("boolean"), F.lit(False))

    def on_BoolOp(self, n):  # noqa: N802
        out = None
        for v in n.values:
            c = F.coalesce(self.bool_(v), F.lit(False))
            out = c if out is None else (out & c if isinstance(n.op, ast.And) else out | c)
        return out

    def compare(self, op: str, a, b) -> Column:
        if op in ("In", "NotIn"):
            hit = F.coalesce(a.isin(*b), F.lit(False))
            return hit if op == "In" else ~hit
        if b is None and op in ("Is", "IsNot", "Eq", "NotEq"):
            return a.isNull() if op in ("Is", "Eq") else a.isNotNull()
        b = b if isinstance(b, Column) else F.lit(b)
        got = {"Eq": a == b, "NotEq": a != b, "Lt": a < b, "LtE": a <= b, "Gt": a > b, "GtE": a >= b, "Is": a == b, "IsNot": a != b}[op]
        nan = F.lit(False)
        if isinstance(a, Column):
            got = F.coalesce(got, F.lit(op in ("NotEq", "IsNot")))
        return got | nan

    def on_Compare(self, n):  # noqa: N802
        out, left = None, n.left
        for op, right in zip(n.ops, n.comparators, strict=True):
            b = [e.value for e in right.elts] if isinstance(right, ast.List | ast.Tuple) else self.compile(right)
            c = self.compare(type(op).__name__, self.col(left), b)
            out, left = c if out is None else out & c, right
        return out

    def on_IfExp(self, n):  # noqa: N802
        return F.when(F.coalesce(self.bool_(n.test), F.lit(False)), self.col(n.body)).otherwise(self.col(n.orelse))

    def on_List(self, n):  # noqa: N802
        return [self.compile(e) for e in n.elts]

    on_Tuple = on_List

    def on_Call(self, n):  # noqa: N802
        kw = {k.arg: k.value for k in n.keywords}
        if isinstance(n.func, ast.Name):
            return self.builtin(n.func.id, n.args)
        name, owner = n.func.attr, n.func.value
        if isinstance(owner, ast.Name) and owner.id == "np":
            return self.numpy(name, n.args, kw)
        return self.method(name, owner, n.args, kw)

    def builtin(self, name: str, args: list[ast.AST]):
        if name == "len" and isinstance(args[0], ast.Name) and args[0].id == "df":
            return self.number("len", F.count("*"))
        if name in TYPES:
            return self.col(args[0]).cast(TYPES[name])
        if name == "abs":
            return F.abs(self.col(args[0]))
        if name == "round":
            return F.bround(self.col(args[0]), int(self.compile(args[1])) if len(args) > 1 else 0)
        if name in ("min", "max") and not any(isinstance(self.compile(a), Column) for a in args):
            return (min if name == "min" else max)(self.compile(a) for a in args)
        raise Unsafe(f"{name} of columns is ambiguous")

    def numpy(self, name: str, args: list[ast.AST], kw: dict):
        if name in UNARY:
            return UNARY[name](self.col(args[0]).cast("double")).cast("double")
        if name == "round":
            return F.bround(self.col(args[0]).cast("double"), int(self.compile(args[1])) if len(args) > 1 else 0)
        if name in ("power", "divide"):
            return self.binary("Pow" if name == "power" else "Div", self.col(args[0]), self.col(args[1]))
        if name == "where":
            return F.when(F.coalesce(self.bool_(args[0]), F.lit(False)), self.col(args[1])).otherwise(self.col(args[2]))
        if name == "select":
            default = kw.get("default") or (args[2] if len(args) > 2 else None)
            out = self.col(default) if default is not None else F.lit(0.0)
            for c, v in reversed(list(zip(args[0].elts, args[1].elts, strict=True))):
                out = F.when(F.coalesce(self.bool_(c), F.lit(False)), self.col(v)).otherwise(out)
            return out
        if name in ("minimum", "maximum"):
            a, b = self.col(args[0]), self.col(args[1])
            return F.when(a.isNotNull() & b.isNotNull(), (F.least if name == "minimum" else F.greatest)(a, b))
        if name == "clip":
            return clip(self.col(args[0]), self.compile(args[1]), self.compile(args[2]))
        if name == "nan_to_num":
            c = self.col(args[0]).cast("double")
            return F.when(c.isNull() | F.isnan(c), 0.0).when(c == float("inf"), 1.7976931348623157e308).when(c == float("-inf"), -1.7976931348623157e308).otherwise(c)
        if name in ("isnan", "isfinite"):
            c = self.col(args[0]).cast("double")
            nan = c.isNull() | F.isnan(c)
            return nan if name == "isnan" else ~nan & (F.abs(c) != float("inf"))
        if name in ("mean", "median"):
            return self.reduce(name, self.col(args[0]), ast.unparse(args[0]))
        if name in ("float64", "int64"):
            return self.col(args[0]).cast(TYPES[name])
        raise Unsafe(f"np.{name} can't be called")

    def reduce(self, name: str, c: Column, key: str) -> Column:
        d = c.cast("double")
        d = F.when(~F.isnan(d), d)
        agg = {
            "mean": F.avg(d), "min": F.min(d), "max": F.max(d), "std": F.stddev_samp(d), "var": F.var_samp(d), "sum": F.coalesce(F.sum(d), F.lit(0.0)), "median": F.percentile(d, F.lit(0.5)),
            "count": F.count(d), "nunique": F.countDistinct(d), "prod": F.coalesce(F.product(d), F.lit(1.0)), "any": F.coalesce(F.max(F.when(d != 0, 1).otherwise(0)), F.lit(0)), "all": F.coalesce(F.min(F.when(d != 0, 1).otherwise(0)), F.lit(1)),
        }[name]
        return self.number(f"{name}({key})", agg)

    def row_wise(self, name: str, cols: list[Column]) -> Column:
        have = F.filter(F.array(*[c.cast("double") for c in cols]), lambda x: x.isNotNull() & ~F.isnan(x))
        total = F.aggregate(have, F.lit(0.0), lambda a, x: a + x)
        n = F.size(have)
        mean = F.try_divide(total, n.cast("double"))
        spread = F.aggregate(F.transform(have, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
        var = F.when(n > 1, F.try_divide(spread, n.cast("double") - 1))
        got = {"mean": mean, "sum": total, "min": F.array_min(have), "max": F.array_max(have), "count": n, "var": var, "std": F.sqrt(var), "median": F.when(n > 0, (F.element_at(F.array_sort(have), F.floor((n + 1) / 2).cast("int")) + F.element_at(F.array_sort(have), F.floor((n + 2) / 2).cast("int"))) / 2)}
        if name not in got:
            raise Unsafe(f"{name} by row is not supported")
        return got[name]

    def method(self, name: str, owner: ast.AST, args: list[ast.AST], kw: dict):
        v = self.compile(owner)
        axis = kw.get("axis")
        if isinstance(v, list):
            if axis is not None and axis.value in (1, "columns"):
                return self.row_wise(name, v)
            raise Unsafe("several columns need axis=1")
        c = v if isinstance(v, Column) else F.lit(v)
        if name in REDUCTIONS:
            return self.reduce(name, c, ast.unparse(owner))
        if name in UNARY:
            return UNARY[name](c.cast("double")).cast("double")
        arg = lambda k: self.compile(args[k])
        lit = lambda k: self.col(args[k])
        if name in ("isna", "isnull", "notna", "notnull"):
            null = c.isNull() | (F.isnan(c.cast("double")) if name else F.lit(False)) if self.is_number(owner) else c.isNull()
            return null if name in ("isna", "isnull") else ~null
        if name == "astype":
            return c.cast(TYPES[arg(0)])
        if name == "fillna":
            return F.coalesce(F.when(~F.isnan(c), c) if self.is_number(owner) else c, lit(0))
        if name == "clip":
            low, high = (self.compile(x) if x is not None else None for x in (args[0] if args else kw.get("lower"), args[1] if len(args) > 1 else kw.get("upper")))
            return clip(c, low, high)
        if name == "round":
            return F.bround(c.cast("double"), int(arg(0)) if args else 0)
        if name in ("where", "mask"):
            test = F.coalesce(self.bool_(args[0]), F.lit(False))
            other = lit(1) if len(args) > 1 else F.lit(None)
            return F.when(test if name == "where" else ~test, c).otherwise(other)
        if name == "replace":
            return F.when(c == lit(0), lit(1)).otherwise(c)
        if name == "between":
            return F.coalesce(c.between(lit(0), lit(1)), F.lit(False))
        if name == "isin":
            return F.coalesce(c.isin(*arg(0)), F.lit(False))
        ops = {"pow": "Pow", "div": "Div", "mul": "Mult", "add": "Add", "sub": "Sub", "floordiv": "FloorDiv", "mod": "Mod"}
        if name in ops:
            return self.binary(ops[name], c, arg(0))
        tests = {"eq": "Eq", "ne": "NotEq", "lt": "Lt", "le": "LtE", "gt": "Gt", "ge": "GtE"}
        if name in tests:
            return self.compare(tests[name], c, arg(0))
        if name == "to_numpy":
            return c
        raise Unsafe(f"{name} needs a row order; use the windows of tallyforge.operators.ordered")

    def is_number(self, owner: ast.AST) -> bool:
        names = [x.slice.value for x in ast.walk(owner) if isinstance(x, ast.Subscript) and isinstance(x.slice, ast.Constant)]
        return bool(names) and all(isinstance(self.df.schema[c].dataType, T.NumericType) for c in names if c in self.df.columns)


def interaction(df: DataFrame, compiled: Compiled, fill: float | None = None) -> Column:
    """The expression as a feature: NaN and infinities become null, nulls the fill."""
    v = compiled.column(df).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return v if fill is None else F.coalesce(v, F.lit(fill))


def fit_interactions(df: DataFrame, texts: dict[str, str]) -> dict[str, tuple[Compiled, float | None, bool]]:
    """(compiled, training median, constant?) by name, in a few jobs for all: a constant feature should be rejected."""
    need = {n: Compiler(df, None) for n in texts}
    for n, text in texts.items():
        need[n].compile(validate(text).body)
    wanted = [(n, k, e) for n, c in need.items() for k, e in c.wanted.items()]
    got = df.agg(*[e.alias(f"x{j}") for j, (_, _, e) in enumerate(wanted)]).first() if wanted else ()
    stats: dict[str, dict[str, float]] = {n: {} for n in texts}
    for (n, k, _), v in zip(wanted, got, strict=True):
        stats[n][k] = None if v is None else float(v)
    done = {n: Compiled(text, stats[n]) for n, text in texts.items()}
    values = {n: interaction(df, c) for n, c in done.items()}
    mid = quantiles(values, df, [0.5])
    once = df.select(*[v.alias(f"v{j}") for j, v in enumerate(values.values())])
    ends = once.agg(*[f(f"v{j}").alias(f"x{j}_{m}") for j in range(len(values)) for m, f in enumerate((F.min, F.max))]).first() if values else ()
    return {n: (c, mid[n][0] if mid[n] else None, ends[2 * j] is None or ends[2 * j] == ends[2 * j + 1]) for j, (n, c) in enumerate(done.items())}


def fit_interaction(df: DataFrame, text: str) -> tuple[Compiled, float | None, bool]:
    return fit_interactions(df, {"x": text})["x"]
