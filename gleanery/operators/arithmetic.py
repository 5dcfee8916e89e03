"""Arithmetic over 32-bit integers: lexing, parsing and evaluating expression texts.

`evaluate` computes a column of texts in Arrow batches. `compile_expression` turns one constant template into a Column, so
that Catalyst folds and generates code for it; names in the template stand for columns.

Division truncates and is 0 where it is undefined; sums and products wrap (`wrap=True`) or are null on overflow. A leading
minus before a bracket is dropped with `compat=True` and applied otherwise. A surplus closing bracket ends the expression.

Special input: null gives null without error; the empty text is an error; texts of any length are parsed whole, nesting up
to the depth of the text (the parser keeps its own stack).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LEAST, GREATEST = -(1 << 31), (1 << 31) - 1
TOKEN = re.compile(r"[0-9]+|[-+*/()]")
NAMED = re.compile(r"[A-Za-z_]\w*|[0-9]+|[-+*/()]")
RANK = {"+": 1, "-": 1, "*": 2, "/": 2}


class Failure(ValueError):
    """An expression that cannot be read; its text names the reason."""


def lex(text: str, names: bool = False) -> list[str]:
    token, out, at = NAMED if names else TOKEN, [], 0
    while at < len(text):
        if text[at] == " ":
            at += 1
            continue
        m = token.match(text, at)
        if not m:
            raise Failure("UnknownChar")
        if m[0].isdigit() and int(m[0]) > GREATEST:
            raise Failure("NumberFormatError")
        out.append(m[0])
        at = m.end()
    return out


def postfix(text: str, compat: bool = False, names: bool = False) -> list:
    """The expression in postfix order: ints, names, operators and `neg`."""
    tokens = lex(text, names)
    out: list = []
    stack: list[tuple[str, bool]] = []  # (operator or bracket, minus before the bracket)
    expect_value, at = True, 0

    def reduce(rank: int) -> None:
        while stack and stack[-1][0] != "(" and RANK[stack[-1][0]] >= rank:
            out.append(stack.pop()[0])

    while at < len(tokens):
        token = tokens[at]
        if expect_value:
            minus = token == "-"
            if minus:
                at += 1
                token = tokens[at] if at < len(tokens) else ""
            if token == "(":
                stack.append(("(", minus and not compat))
            elif token[:1].isdigit():
                out.append(-int(token) if minus else int(token))
                expect_value = False
            elif names and token[:1].isidentifier():
                out.append(token)
                if minus:
                    out.append("neg")
                expect_value = False
            else:
                raise Failure("MissingBracket" if any(s[0] == "(" for s in stack) and token != ")" else "Unmatch")
        elif token in RANK:
            reduce(RANK[token])
            stack.append((token, False))
            expect_value = True
        elif token == ")":
            reduce(0)
            if not stack:
                return out  # a surplus bracket ends the expression
            if stack.pop()[1]:
                out.append("neg")
        else:
            raise Failure("MissingBracket" if any(s[0] == "(" for s in stack) else "Unmatch")
        at += 1
    if expect_value:
        raise Failure("MissingBracket" if any(s[0] == "(" for s in stack) else "Unmatch")
    reduce(0)
    if stack:
        raise Failure("MissingBracket")
    return out


def _bounded(x: int, wrap: bool) -> int | None:
    if LEAST <= x <= GREATEST:
        return x
    return (x - LEAST) % (1 << 32) + LEAST if wrap else None


def compute(program: list, wrap: bool = True) -> int | None:
    stack: list[int | None] = []
    for step in program:
        if isinstance(step, int):
            stack.append(step)
            continue
        if step == "neg":
            a = stack.pop()
            stack.append(None if a is None else _bounded(-a, wrap))
            continue
        b, a = stack.pop(), stack.pop()
        if a is None or b is None:
            stack.append(None)
        elif step == "/":
            q = 0 if b == 0 else abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            stack.append(q if LEAST <= q <= GREATEST else 0)
        else:
            stack.append(_bounded(a + b if step == "+" else a - b if step == "-" else a * b, wrap))
    return stack[0]


def evaluate(df: DataFrame, text: str, into: str = "result", compat: bool = False, wrap: bool = True) -> DataFrame:
    """df with `into struct<value int, error string>`."""

    @F.pandas_udf("struct<value:int,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for t in texts:
            value = error = None
            if isinstance(t, str):
                try:
                    value = compute(postfix(t, compat), wrap)
                except Failure as e:
                    error = str(e)
            values.append(value)
            errors.append(error)
        return pd.DataFrame({"value": pd.array(values, dtype="Int32"), "error": errors})

    return df.withColumn(into, run(F.col(text)))


def compile_expression(template: str, columns: dict[str, Column] | None = None, compat: bool = False, wrap: bool = True) -> Column:
    """One template as a Column of int; sums and products wrap as in `evaluate`, or are null on overflow (wrap=False); 0 where
    a division is undefined. A template that cannot be read raises Failure."""
    stack: list[Column] = []
    bounded = lambda x: (F.pmod(x - F.lit(LEAST), F.lit(1 << 32)) + F.lit(LEAST)).cast("int") if wrap else x.try_cast("int")
    for step in postfix(template, compat, names=True):
        if isinstance(step, int):
            stack.append(F.lit(step).cast("int"))
        elif step == "neg":
            stack.append(bounded(-stack.pop().cast("long")))
        elif step not in RANK:
            stack.append((columns or {}).get(step, F.col(step)).cast("int"))
        else:
            b, a = stack.pop(), stack.pop()
            if step == "/":
                q = F.try_divide(a.cast("double"), b.cast("double"))
                whole = F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))
                stack.append(F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(whole.try_cast("int"), F.lit(0))))
            else:
                long = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[step](a.cast("long"), b.cast("long"))
                stack.append(bounded(long))  # 32 bits each, so 64 hold any of these
    return stack[0]
