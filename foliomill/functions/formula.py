"""Derived metric columns from a user formula, as column expressions."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_EXPONENT = 1000


def floor_div(a: Column, b: Column) -> Column:
    """Quotient rounded down; null for a zero divisor."""
    return F.floor(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    return a - b * F.floor(F.try_divide(a, b))


def power(a: Column, b: Column) -> Column:
    """a to the power b; null where the exponent is above the limit."""
    return F.when(b <= MAX_EXPONENT, F.pow(a, b))


def log(x: Column, base: Column | None = None) -> Column:
    return F.ln(x) if base is None else F.try_divide(F.ln(x), F.ln(base))


# The operators, functions and constants a formula may use.  All reckon in doubles and give null
# where there is no value.  ``round`` is half-even; its digits are a number, not a column.
OPERATORS = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide, ast.FloorDiv: floor_div, ast.Mod: modulo, ast.Pow: power,
}
FUNCTIONS = {
    "abs": F.abs, "round": F.bround, "sqrt": F.sqrt, "log": log, "ln": F.ln, "log10": F.log10, "ceil": F.ceil,
    "floor": F.floor, "sin": F.sin, "cos": F.cos, "tan": F.tan, "pow": power, "try_divide": F.try_divide,
    "nullif": F.nullif,
}
CONSTANTS = {"pi": math.pi, "e": math.e}


def _column(node: ast.expr, names: set[str]) -> Column:
    match node:
        case ast.Constant(value=int() | float() as number) if not isinstance(number, bool):
            return F.lit(float(number))
        case ast.Name(id=name) if name in names:
            return F.col(name).try_cast("double")
        case ast.Name(id=name) | ast.Call(func=ast.Name(id=name), args=[], keywords=[]) if name in CONSTANTS:
            return F.lit(CONSTANTS[name])
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return -_column(inner, names)
        case ast.UnaryOp(op=ast.UAdd(), operand=inner):
            return _column(inner, names)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in OPERATORS:
            return OPERATORS[type(op)](_column(a, names), _column(b, names)).cast("double")
        case ast.Call(func=ast.Name(id="round"), args=[inner, digits], keywords=[]):
            return F.bround(_column(inner, names), int(ast.literal_eval(digits))).cast("double")
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
            return FUNCTIONS[name](*(_column(a, names) for a in args)).cast("double")
    raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")


def with_metric(df: DataFrame, name: str, formula: str) -> DataFrame:
    """Add the formula over the columns as ``name``, and ``name_error`` where it has no value.

    A formula holds columns, numbers, OPERATORS, FUNCTIONS and CONSTANTS.  A row without a finite value (x / 0, the
    root of -1, an exponent above the limit) is flagged; a row with a null input is null without a flag.
    """
    try:
        tree = ast.parse(formula.strip(), mode="eval").body
        value = _column(tree, set(df.columns))
    except (SyntaxError, TypeError) as wrong:
        raise ValueError(f"no formula: {formula!r}") from wrong
    inputs_known = F.lit(True)
    for column in sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} & set(df.columns)):
        inputs_known = inputs_known & F.col(column).isNotNull()
    out = df.withColumn(name, F.when(~F.isnan(value) & (F.abs(value) < F.lit(math.inf)), value))
    return out.withColumn(f"{name}_error", inputs_known & F.col(name).isNull())
