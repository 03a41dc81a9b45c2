"""Arithmetic and logic over variables: a whitelisted syntax tree becomes a Column; nothing is evaluated."""

from __future__ import annotations

import ast
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..shared import materialise
from . import boxcox
from .stats import fresh, known, name

_ROOTS = re.compile(r"\b(?:aggData\.data|self\.dataFrame|self\.data)\b")


def normalise(text: str) -> str:
    """The other spellings of the table become `data`."""
    return _ROOTS.sub("data", text)


def divide(a: Column, b: Column) -> Column:
    """By zero: an infinity with the sign of a, and missing for 0/0."""
    a, b = a.cast("double"), b.cast("double")
    edge = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, edge).otherwise(a / F.nullif(b, F.lit(0.0)))


def log(x: Column) -> Column:
    """Of zero: minus infinity; of less: missing."""
    x = x.cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x > 0, F.ln(x))


class _Compiler(ast.NodeVisitor):
    def __init__(self, df: DataFrame, order: Column | None):
        self.df, self.order = df, order

    def generic_visit(self, node):
        raise ValueError(f"not allowed in an expression: {type(node).__name__}")

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Constant(self, node):
        if isinstance(node.value, (bool, int, float, str)):
            return F.lit(node.value), "bool" if isinstance(node.value, bool) else "number" if not isinstance(node.value, str) else "text", isinstance(node.value, int)
        raise ValueError(f"no such constant: {node.value!r}")

    def visit_List(self, node):
        raise ValueError("a list of variables is no value; name one variable")

    visit_Tuple = visit_List

    def visit_Subscript(self, node):
        if isinstance(node.value, ast.Name) and node.value.id == "data":
            if not isinstance(node.slice, ast.Constant) or not isinstance(node.slice.value, str):
                raise ValueError("a variable is named by a text")
            column = node.slice.value
            if column not in self.df.columns:
                raise ValueError(f"no variable {column!r}")
            kind = self.df.schema[column].dataType
            if isinstance(kind, T.BooleanType):
                return name(column), "bool", False
            return name(column), "text" if isinstance(kind, T.StringType) else "number", isinstance(kind, (T.IntegerType, T.LongType, T.ShortType))
        if isinstance(node.slice, ast.Slice):
            return self._slice(self.visit(node.value), node.slice)
        raise ValueError("only variables and slices of them have brackets")

    def _slice(self, value, cut):
        """Rows of a slice keep their value, all others are missing; rows are numbered in load order."""
        if self.order is None:
            raise ValueError("a slice needs the order of rows")
        bound = lambda x: None if x is None else ast.literal_eval(x)
        first, last, step = bound(cut.lower) or 0, bound(cut.upper), bound(cut.step) or 1
        if step < 1 or first < 0 or (last is not None and last < 0):
            raise ValueError("slices count forward from the first row")
        inside = (self.order >= first) & ((self.order - first) % step == 0)
        return F.when(inside if last is None else inside & (self.order < last), value[0]), value[1], value[2]

    def visit_UnaryOp(self, node):
        c, kind, whole = self.visit(node.operand)
        if isinstance(node.op, ast.UAdd):
            return c, kind, whole
        if isinstance(node.op, ast.USub):
            return -c, kind, whole
        if isinstance(node.op, ast.Invert):
            return (~c, "bool", False) if kind == "bool" else (F.bitwise_not(c.cast("long")), "number", True)
        return self.generic_visit(node.op)

    def visit_BinOp(self, node):
        (a, ka, wa), (b, kb, wb) = self.visit(node.left), self.visit(node.right)
        plain = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}
        if type(node.op) in plain:
            if ka == kb == "text" and isinstance(node.op, ast.Add):
                return F.concat(a, b), "text", False
            return plain[type(node.op)](a.cast("double") if not wa else a, b.cast("double") if not wb else b), "number", wa and wb
        if isinstance(node.op, ast.Div):
            return divide(a, b), "number", False
        if isinstance(node.op, ast.Pow):
            return F.pow(a.cast("double"), b.cast("double")), "number", False
        if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            both = isinstance(node.op, ast.BitAnd)
            if ka == kb == "bool":
                return (a & b) if both else (a | b), "bool", False
            return (a.cast("long").bitwiseAND(b.cast("long")) if both else a.cast("long").bitwiseOR(b.cast("long"))), "number", True
        return self.generic_visit(node.op)

    def visit_Compare(self, node):
        if len(node.ops) != 1:
            raise ValueError("compare two values at a time")
        signs = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
        if type(node.ops[0]) not in signs:
            return self.generic_visit(node.ops[0])
        a, b = self.visit(node.left)[0], self.visit(node.comparators[0])[0]
        # A missing value compares false, and unequal to everything.
        return F.coalesce(signs[type(node.ops[0])](a, b), F.lit(isinstance(node.ops[0], ast.NotEq))), "bool", False

    def visit_Call(self, node):
        if node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
            raise ValueError("functions take plain arguments")
        called = ast.unparse(node.func)
        args = [self.visit(a) for a in node.args]
        takes = {"np.log": 1, "np.exp": 1, "np.logical_and": 2, "np.logical_or": 2, "runBoxcox": 1}
        if called not in takes:
            raise ValueError(f"no function {called!r}; there are {', '.join(takes)}")
        if len(args) != takes[called]:
            raise ValueError(f"{called} takes {takes[called]} arguments")
        if called == "np.log":
            return log(args[0][0]), "number", False
        if called == "np.exp":
            return F.exp(args[0][0].cast("double")), "number", False
        if called == "runBoxcox":
            return boxcox.transform(self.df, args[0][0].cast("double")), "number", False
        # Zero is false; a missing value counts as true.
        a, b = (c if kind == "bool" else F.coalesce(c != 0, F.lit(True)) for c, kind, _ in args)
        return (a & b) if called == "np.logical_and" else (a | b), "bool", False


def compile_expression(df: DataFrame, text: str, order: Column | None = None) -> Column:
    """The Column of an expression over df."""
    column, kind, _ = _Compiler(df, order).visit(ast.parse(normalise(text), mode="eval"))
    return known(column.cast("double")) if kind == "number" else column


def compute(df: DataFrame, target: str, text: str, overwrite: bool = True) -> DataFrame:
    """df with a variable computed from others."""
    if not overwrite and target in df.columns:
        raise ValueError(f"{target!r} exists")
    if "[" in text and ":" in text:
        # Slices need positions: rows are numbered where they lie, partition after partition, by counts of each. The marks are
        # made once and stay, as a second look at a table may deal its rows otherwise; counts are few and broadcast, so rows keep their order.
        at, part, row, n, first = fresh(df, "place", "part", "row", "n", "first")
        marked = materialise(df.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()))
        begin = marked.groupBy(part).agg(F.count(F.lit(1)).alias(n)).withColumn(first, F.coalesce(F.sum(n).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        placed = marked.join(F.broadcast(begin.drop(n)), part).withColumn(at, F.col(first) + F.col(row).bitwiseAND(F.lit(2**33 - 1)))
        return placed.withColumn(target, compile_expression(df, text, F.col(at))).select(*(name(c) for c in df.columns if c != target), name(target))
    return df.withColumn(target, compile_expression(df, text))
