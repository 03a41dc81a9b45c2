"""The rule language: parsing, formatting and validation of outlier rules, targets and whole summaries."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from ..functions.stats import OWN

# Comparators, the operations that a target can name, and their parameters in order of output.
COMPARATORS = ("<", "<=", ">", ">=")
DESCRIPTIVE = ("Mean", "Median", "Mode", "Count", "Standard Deviation", "Max", "Min", "Variance", "Standard Error")
FITTED = {
    "Gamma (k, θ)": ("k", "θ"),
    "Weibull (k, θ)": ("k", "θ"),
    "LogNormal (k, θ)": ("k", "θ"),
    "Wald (m, a)": ("m", "a"),
    "Ex-Wald (m, a, τ)": ("m", "a", "τ"),
    "Shifted Wald (m, a, shift)": ("m", "a", "shift"),
    "Ex-Gaussian (μ, σ, τ)": ("μ", "σ", "τ"),
    "Inv-Gaussian (μ, λ)": ("μ", "λ"),
    "Shifted Inv-Gaussian (μ, λ, shift)": ("μ", "λ", "shift"),
}
OPERATIONS = (*DESCRIPTIVE, *FITTED)
POOLING = "Pooling CDF"

#: Quirks of older scripts that change rows; all off unless named.
COMPAT = {
    "second_op": "the second clause of a compound range reads >= as > and <= as <",
    "strict_types": "an unquoted checklist number matches numeric columns only, a quoted one text columns only",
    "loose_numbers": "a cutoff's number is the first run of digits in it, so .5 reads as 5 and 1e3 as 1, and a multiplier may be negative",
    "global_mad_nulls": "a global MAD cutoff is unknown if any value is missing",
}

# How a number is found under "loose_numbers", and how the four kinds of cutoff are written.
_LOOSE = re.compile(r"-?\d+\.\d+|-?\d+")
_NUMBER = r"(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
_CUTOFFS = {
    "raw": re.compile(rf"([+-]?{_NUMBER})"),
    "sd": re.compile(rf"mean\s*[+-]\s*({_NUMBER})\s*\*\s*SD"),
    "shifting": re.compile(r"mean\s*[+-]\s*Shifting Z\s*\*\s*SD"),
    "mad": re.compile(rf"median\s*[+-]\s*({_NUMBER})\s*\*\s*MAD"),
}
_LITERAL = re.compile(r"\s*=\s*('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^\s=]+)\s*")


@dataclass(frozen=True)
class Cutoff:
    """kind: raw, sd, shifting or mad; number: the value or the multiplier."""

    op: str
    kind: str
    number: float = 0.0

    def text(self) -> str:
        sign = "-" if self.op.startswith(">") else "+"
        n = f"{self.number:.17g}" if float(f"{self.number:g}") != self.number else f"{self.number:g}"
        return f"{self.op} " + {"raw": n, "sd": f"mean {sign} {n} * SD", "shifting": f"mean {sign} Shifting Z * SD", "mad": f"median {sign} {n} * MAD"}[self.kind]


@dataclass(frozen=True)
class Rule:
    """kind: range, checklist or cdf."""

    var: str
    kind: str
    cutoffs: tuple[Cutoff, ...] = ()
    joint: str = ""
    values: tuple[str | float, ...] = ()

    def text(self) -> str:
        if self.kind == "cdf":
            return f"{self.var}:{POOLING}"
        if self.kind == "range":
            return f"{self.var}:" + f" {self.joint} ".join(c.text() for c in self.cutoffs)
        return f"{self.var}:" + "".join(f" = {v!r}" if isinstance(v, str) else f" = {v:g}" for v in self.values)


def _cutoff(text: str, weaken: bool = False, loose: bool = False) -> Cutoff:
    """A comparator and a cutoff. The sign before a multiplier is decoration: the comparator decides the side."""
    m = re.match(r"\s*(<=|>=|<|>)\s*(.*?)\s*$", text, re.S)
    if not m:
        raise ValueError(f"a range needs one of {', '.join(COMPARATORS)}: {text!r}")
    op, rest = m[1][0] if weaken else m[1], m[2]
    if loose:
        if "Shifting Z" in rest:
            return Cutoff(op, "shifting")
        number = _LOOSE.search(rest)
        if not number:
            raise ValueError(f"no number in {text!r}")
        return Cutoff(op, "mad" if "MAD" in rest else "sd" if "SD" in rest else "raw", float(number[0]))
    for kind, pattern in _CUTOFFS.items():
        read = pattern.fullmatch(rest)
        if read:
            return Cutoff(op, kind, float(read[1]) if pattern.groups else 0.0)
    raise ValueError(f"a cutoff is a number, mean +/- number * SD, mean +/- Shifting Z * SD or median +/- number * MAD, not {rest!r}")


def parse_rule(text: str, compat: frozenset[str] = frozenset()) -> Rule:
    """`var:expression` -> Rule; the expression is a range, a checklist or the pooled CDF."""
    var, colon, expression = text.partition(":")
    if not colon or not var.strip():
        raise ValueError(f"a rule reads variable:expression, not {text!r}")
    var, expression = var.strip(), expression.strip()
    if expression == POOLING:
        return Rule(var, "cdf")
    if expression[:1] in "<>" and expression:
        loose = "loose_numbers" in compat
        parts = re.split(r"\s(and|or)\s", expression)
        if len(parts) > 3:
            raise ValueError(f"at most two clauses: {text!r}")
        cutoffs = tuple(_cutoff(c, i > 0 and "second_op" in compat, loose) for i, c in enumerate(parts[::2]))
        return Rule(var, "range", cutoffs, parts[1] if len(parts) > 1 else "")
    values, at = [], 0
    while at < len(expression):
        m = _LITERAL.match(expression, at)
        if not m:
            raise ValueError(f"cannot read {expression[at:]!r} in {text!r}")
        values.append(ast.literal_eval(m[1]) if m[1][0] in "'\"" else float(m[1]))
        at = m.end()
    return Rule(var, "checklist", values=tuple(values))


_BOUNDED = re.compile(rf"(.*?)\s*\[\s*([+-]?(?:{_NUMBER}|inf))\s*,\s*([+-]?(?:{_NUMBER}|inf))\s*\]", re.S)


@dataclass(frozen=True)
class Target:
    """`variable@Operation`; a fitted family may be followed by the bounds between which values were seen: `variable@Gamma (k, θ) [0.2, 1.5]`."""

    var: str
    op: str
    bounds: tuple[float, float] | None = None

    @staticmethod
    def parse(text: str) -> Target:
        var, at, op = text.rpartition("@")
        bounds, read = None, _BOUNDED.fullmatch(op)
        if read and read[1] in FITTED:
            op, bounds = read[1], (float(read[2]), float(read[3]))
        if not at or op not in OPERATIONS and op not in OWN or bounds and not bounds[0] < bounds[1]:
            raise ValueError(f"a target reads variable@operation with an operation of {(*OPERATIONS, *OWN)}, and fits may end in [low, high], not {text!r}")
        return Target(var, op, bounds)

    def operation(self) -> str:
        return f"{self.op} [{self.bounds[0]:g}, {self.bounds[1]:g}]" if self.bounds else self.op

    def text(self) -> str:
        return f"{self.var}@{self.operation()}"

    def parameters(self) -> tuple[str, ...]:
        return FITTED.get(self.op, ("",))


def next_operation(used: list[str]) -> str:
    """The first operation of the catalogue that a variable doesn't have yet."""
    return next((op for op in OPERATIONS if op not in used), OPERATIONS[0])


@dataclass
class SummaryPlan:
    """Row and column variables, ordered rules, targets, and an omega for each rule: a number, None (skip) or "estimate"."""

    rows: list[str] = field(default_factory=list)
    cols: list[str] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    omegas: list[float | str | None] | None = None

    def validate(self) -> None:
        """A variable may stand in only one of rows, columns and targets; rules, targets and omegas have to parse."""
        roles: dict[str, set[str]] = {}
        for role, names in (("rows", self.rows), ("columns", self.cols), ("data", {Target.parse(t).var for t in self.targets})):
            for name in names:
                roles.setdefault(name, set()).add(role)
            if len(set(names)) < len(names):
                raise ValueError(f"a variable is twice in {role}: {list(names)}")
        twice = sorted(n for n, r in roles.items() if len(r) > 1)
        if twice:
            raise ValueError(f"in more than one of rows, columns and data: {twice}")
        for rule in self.rules:
            parse_rule(rule)
        if self.omegas is not None and len(self.omegas) != len(self.rules):
            raise ValueError("one omega for each rule")

    # --- editing -----------------------------------------------------------------------------------------------------
    def add_rule(self, rule: str, at: int | None = None) -> None:
        parse_rule(rule)
        self.rules.insert(len(self.rules) if at is None else at, rule)

    def move_rule(self, old: int, new: int) -> None:
        self.rules.insert(new, self.rules.pop(old))

    def drop_rule(self, at: int) -> None:
        del self.rules[at]

    def clear_rules(self) -> None:
        self.rules.clear()

    # --- texts -------------------------------------------------------------------------------------------------------
    def omega_list(self) -> list[float | str]:
        """For scripts: six decimals, -1 where a rule has none."""
        given = self.omegas or [None] * len(self.rules)
        return [-1 if o is None else o if isinstance(o, str) else float(f"{o:.6f}") for o in given]

    def to_config(self) -> str:
        return "".join(f"{k}: {v}\n" for k, v in (("rowList", self.rows), ("columnList", self.cols), ("dataList", self.targets), ("filterList", self.rules)))

    @staticmethod
    def from_config(text: str) -> SummaryPlan:
        """The four lines of a saved configuration, in their fixed order; values are literals and never evaluated."""
        lines = [line for line in text.splitlines() if line.strip()][:4]
        if len(lines) < 4:
            raise ValueError("a configuration has four lines")
        rows, cols, targets, rules = (ast.literal_eval(line.partition(": ")[2]) for line in lines)
        return SummaryPlan(list(rows), list(cols), list(rules), list(targets))

    def to_script(self, files: list[str], reader: str = "read_piped", computed: list[tuple[str, str]] | None = None) -> str:
        """A script that runs this plan with the library."""
        lines = ["from pyspark.sql import SparkSession", "", "from trialmill.engine import TrialData", "", "spark = SparkSession.builder.getOrCreate()", f"file_list = {files!r}", f"data = TrialData(spark).{reader}(file_list)"]
        lines += [f"data.compute({name!r}, {expr!r})" for name, expr in computed or []]
        lines += [f"row_list = {self.rows!r}", f"column_list = {self.cols!r}", f"filter_list = {self.rules!r}", f"data_list = {self.targets!r}", f"omegas = {self.omega_list()!r}", "result = data.summarize(row_list, column_list, filter_list, data_list, omegas)", "print(data.text(result))"]
        return "\n".join(lines) + "\n"
