"""Ordered text rewriting, as one Catalyst expression or as DuckDB SQL.

A chain of rules is data; column() turns it into built-in functions, so it runs
inside whole-stage code, and sql() into the same for the oracle. Templates name
groups as \\1, \\2.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


def _java(template: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", template.replace("$", r"\$"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Put:
    """Every occurrence of a literal text."""

    old: str
    new: str

    def column(self, c: Column) -> Column:
        return F.replace(c, F.lit(self.old), F.lit(self.new))

    def sql(self, x: str) -> str:
        return f"replace({x}, {_quote(self.old)}, {_quote(self.new)})"


@dataclass(frozen=True)
class Sub:
    """Every match of a pattern. unicode: white space and digits of any script count on the Spark side."""

    pattern: str
    template: str
    unicode: bool = False

    def column(self, c: Column) -> Column:
        return F.regexp_replace(c, ("(?U)" if self.unicode else "") + self.pattern, _java(self.template))

    def sql(self, x: str) -> str:
        return f"regexp_replace({x}, {_quote(self.pattern)}, {_quote(self.template)}, 'g')"


@dataclass(frozen=True)
class Cases:
    """Every match of a pattern, in one pass from the left, by the first case that fits all of the match.

    The text is cut into matches and what lies between, so what a match was
    turned into is never looked at again. `between` are patterns of stretches
    in which no match begins, tried after the match; single characters come last.
    """

    pattern: str
    cases: tuple[tuple[str, str], ...]
    between: str = "."
    stretch: str = ""  # on the Spark side: as much text as surely holds no match, possessive, so that a text is few pieces

    def column(self, c: Column) -> Column:
        def one(token: Column) -> Column:
            out = F.when(~token.rlike(f"(?s)^(?:{self.pattern})$"), token)
            for pattern, template in self.cases:
                whole = f"(?s)^(?:{pattern})$"
                out = out.when(token.rlike(whole), F.regexp_replace(token, whole, _java(template)))
            return out.otherwise(token)

        stretch = f"{self.stretch}|" if self.stretch else ""
        return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(f"(?s)({stretch}(?:{self.pattern})|{self.between}|.)"), F.lit(1)), one), "")

    def sql(self, x: str) -> str:
        whens = " ".join(f"WHEN regexp_full_match(k, {_quote('(?s)(?:' + p + ')')}) THEN regexp_replace(k, {_quote('(?s)^(?:' + p + ')$')}, {_quote(t)})" for p, t in self.cases)
        return f"array_to_string(list_transform(regexp_extract_all({x}, {_quote(f'(?s)(?:{self.pattern})|{self.between}|.')}), lambda k: CASE WHEN NOT regexp_full_match(k, {_quote('(?s)(?:' + self.pattern + ')')}) THEN k {whens} ELSE k END), '')"


@dataclass(frozen=True)
class Table:
    """Single characters and what stands for them, in one pass; nothing that stands for one may hold another."""

    words: tuple[tuple[str, str], ...]

    def column(self, c: Column) -> Column:
        some = "".join(re.escape(k) for k, _ in self.words)
        table = F.create_map(*[F.lit(x) for pair in self.words for x in pair])
        pieces = F.regexp_extract_all(c, F.lit(f"(?s)([{some}]|[^{some}]++)"), F.lit(1))
        return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.element_at(table, x), x)), "")

    def sql(self, x: str) -> str:
        return sql([Put(k, v) for k, v in self.words], x)


@dataclass(frozen=True)
class Gate:
    """Rules for texts in which the pattern `needs` is found; in others none of them would change anything."""

    needs: str
    rules: tuple

    def column(self, c: Column) -> Column:
        return F.get(F.transform(F.array(c), lambda x: F.when(x.rlike(f"(?s){self.needs}"), column(self.rules, x)).otherwise(x)), 0)

    def sql(self, x: str) -> str:
        return sql(self.rules, x)


@dataclass(frozen=True)
class Trim:
    """Runs of white space become one blank, and none stays at the ends."""

    def column(self, c: Column) -> Column:
        return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))

    def sql(self, x: str) -> str:
        return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def column(rules, c: Column) -> Column:
    for r in rules:
        c = r.column(c)
    return c


def sql(rules, x: str) -> str:
    for r in rules:
        x = r.sql(x)
    return x
