"""LaTeX to words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import rules
from .rules import Cases, Gate, Put, Sub, Trim

# The commands and operators that have words, and the words.
GREEK = ["alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "pi", "sigma", "phi", "omega", "Delta", "Sigma", "Omega"]
FUNCTIONS = {"sin": "sine", "cos": "cosine", "tan": "tangent", "log": "log", "ln": "natural log", "exp": "exponential"}
OPERATORS = {"+": " plus ", "-": " minus ", "*": " times ", "×": " times ", "/": " divided by ", "=": " equals ", "≠": " not equal to ", "<": " less than ", ">": " greater than ", "≤": " less than or equal to ", "≥": " greater than or equal to "}
BRACKETS = {"(": " of ", ")": " ", "[": " ", "]": " ", "{": " ", "}": " "}

_POWERS = (("2", "squared"), ("3", "cubed"), ("-1", "to the minus 1"))


def _powers(exponent: str, group: str) -> Gate:
    """A base before ^ and an exponent; group is the exponent's pattern with one group."""
    base = r"([a-zA-Z0-9]+)\^"
    one = Cases(rf"[a-zA-Z0-9]+\^{exponent}", tuple((base + group.format(v), rf"\1 {word}") for v, word in _POWERS) + ((base + group.format("(.+?)"), r"\1 to the power of \2"),), "[a-zA-Z0-9]+|[^a-zA-Z0-9]+", r"(?:[^a-zA-Z0-9]+|[a-zA-Z0-9]++(?!\^))++")
    return Gate(r"\^", (one,))


#: Fixed values too are the patterns. The order matters: each rule sees what the ones before it have left.
RULES = [
    Sub(r"\\\[|\\\]|\\\(|\\\)", ""),
    Put("$", ""),
    Gate(r"\\", (
        *(Put("\\" + g, g) for g in GREEK),
        Sub(r"\\frac\{\s*([^{}]+?)\s*\}\{\s*([^{}]+?)\s*\}", r"\1 over \2"),
        Sub(r"\\sqrt\{\s*([^{}]+?)\s*\}", r"square root of \1"),
        Sub(r"\\lim_\{\s*([^}]+?)\s*\\to\s*([^}]+?)\s*\}", r"limit as \1 approaches \2 of"),
        Sub(r"\\int_\{\s*([^}]+?)\s*\}\^\{\s*([^}]+?)\s*\}", r"integral from \1 to \2 of"),
        Sub(r"\\int\^\{[^}]+\}", "integral of"),
        Put("\\int", "integral of"),
        Sub(r"\\sum_\{\s*([^}]+?)\s*\}\^\{\s*([^}]+?)\s*\}", r"sum from \1 to \2 of"),
        Sub(r"\\sum\^\{[^}]+\}", "sum of"),
        Put("\\sum", "sum of"),
    )),
    _powers(r"\{[^}]+\}", r"\{{\s*{}\s*\}}"),
    _powers("[a-zA-Z0-9]", "{}"),
    Gate("_", (Sub(r"([a-zA-Z0-9]+)_\{([^}]+)\}", r"\1 sub \2"), Sub(r"([a-zA-Z0-9]+)_([a-zA-Z0-9])", r"\1 sub \2"))),
    Gate(r"\\", (
        *(Put("\\" + k, v) for k, v in FUNCTIONS.items()),
        Sub(r"\\(?:left|right)([(\[{)\]}])", r"\1"),
        Sub(r"\\[,;:!]", " "),
        Sub(r"\\(?:text|mathrm|mathbf)\{([^}]+)\}", r"\1"),
    )),
    *(Put(k, v) for k, v in OPERATORS.items()),
    *(Put(k, v) for k, v in BRACKETS.items()),
    Sub(r"(\d+)([a-zA-Z])", r"\1 \2"),
    Trim(),
]


def latex_to_text(c: Column) -> Column:
    """Words for LaTeX and for operators in plain text; null and empty give the empty text."""
    return rules.column(RULES, F.coalesce(c, F.lit("")))


def latex_to_text_sql(x: str) -> str:
    return rules.sql(RULES, f"coalesce({x}, '')")


def with_words(df: DataFrame, text: str, original: str, plain: str) -> DataFrame:
    """df with a text as it is and as words."""
    return df.withColumns({original: F.col(text), plain: latex_to_text(F.col(text))})
