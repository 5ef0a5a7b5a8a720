"""Expressions, formats and masks of form fields."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z_]\w*)|([-+*/%^()]))")
_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "^": 3}


def parse(text: str) -> list[str | float]:
    """Postfix form; all operators associate to the left; a unary minus is an error."""
    out: list[str | float] = []
    stack: list[str] = []
    at, operand = 0, False
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at}")
        at = m.end()
        number, name, op = m.groups()
        if number or name:
            if operand:
                raise ValueError("operator expected")
            out.append(float(number) if number else f"${name}")
            operand = True
        elif op == "(":
            if operand:
                raise ValueError("operator expected")
            stack.append(op)
        elif op == ")":
            if not operand:
                raise ValueError("operand expected")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unbalanced parenthesis")
            stack.pop()
        else:
            if not operand:
                raise ValueError("operand expected")
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = False
    if not operand or "(" in stack:
        raise ValueError("incomplete expression")
    return out + stack[::-1]


def divide(a: Column, b: Column) -> Column:
    """Division by zero is plus infinity whatever the numerator."""
    return F.when(b == 0, F.lit(math.inf)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def evaluate(text: str, fields: dict[str, Column]) -> Column:
    """The expression as a Column; identifiers are fields and nothing else is ever evaluated."""
    apply = {
        "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide,
        "%": lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b)), "^": lambda a, b: F.pow(a, b),
    }
    stack: list[Column] = []
    for x in parse(text):
        if isinstance(x, float):
            stack.append(F.lit(x))
        elif x.startswith("$"):
            if x[1:] not in fields:
                raise ValueError(f"unknown field {x[1:]}")
            stack.append(F.coalesce(fields[x[1:]].cast("double"), F.lit(0.0)))
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(apply[x](a, b))
    return stack[0]


def dependencies(formulas: dict[str, str]) -> dict[str, set[str]]:
    return {k: {x[1:] for x in parse(v) if isinstance(x, str) and x.startswith("$")} for k, v in formulas.items()}


def order(formulas: dict[str, str]) -> list[str]:
    """Calculated fields so that each follows what it depends on; an error on a cycle."""
    deps, done, open_ = dependencies(formulas), [], set()

    def visit(k: str) -> None:
        if k in done or k not in formulas:
            return
        if k in open_:
            raise ValueError(f"cycle through {k}")
        open_.add(k)
        for x in sorted(deps[k]):
            visit(x)
        done.append(k)

    for k in formulas:
        visit(k)
    return done


def depends_on(formulas: dict[str, str], a: str, b: str) -> bool:
    """Whether a is calculated from b, directly or not."""
    deps, todo, seen = dependencies(formulas), [a], set()
    while todo:
        for x in deps.get(todo.pop(), ()):
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return False


def recalculate(df, formulas: dict[str, str]):
    """All calculated fields as columns, in dependency order."""
    for k in order(formulas):
        df = df.withColumn(k, evaluate(formulas[k], {c: F.col(f"`{c}`") for c in df.columns}))
    return df


def round_half_away(x: Column, digits: int) -> Column:
    f = 10.0**digits
    return F.round(x * f) / f


def value_text(x: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    return F.when(x == F.floor(x), F.format_string("%d", F.floor(x))).otherwise(F.format_string("%.2f", x))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def phone_mask(text: Column, country: str = "US") -> Column:
    d = digits(text)
    if country == "US":
        return F.when(F.length(d) == 10, F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")).otherwise(d)
    if country == "UK":
        return F.when(F.length(d) == 11, F.regexp_replace(d, r"^(\d{5})(\d{6})$", "$1 $2")).otherwise(d)
    return d


def ssn_mask(text: Column) -> Column:
    d = digits(text)
    return F.when(F.length(d) == 9, F.regexp_replace(d, r"^(\d{3})(\d{2})(\d{4})$", "$1-$2-$3")).otherwise(d)


def zip_mask(text: Column) -> Column:
    d = digits(text)
    return F.when(F.length(d) == 9, F.regexp_replace(d, r"^(\d{5})(\d{4})$", "$1-$2")).otherwise(d)


def card_mask(text: Column) -> Column:
    return F.regexp_replace(digits(text), r"(\d{4})(?=\d)", "$1 ")


def number_mask(x: Column, decimals: int, prefix: str = "", suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.format_number(x, decimals), F.lit(suffix))


def card_valid(text: Column) -> Column:
    d = digits(text)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


RULES = {
    "required": lambda x: x.isNotNull() & (x != ""),
    "email": lambda x: x.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
    "url": lambda x: x.rlike(r"^https?://[^\s/$.?#][^\s]*$"),
    "phone_us": lambda x: x.rlike(r"^\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}$"),
}


def errors(checks: dict[str, Column]) -> Column:
    """Names of the rules that fail, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
