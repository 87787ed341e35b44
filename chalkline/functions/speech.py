"""Formulas as speech, and merging what was said with what stands on the board."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import rules
from .rules import Cases, Gate, Put, Sub, Table, Trim

# Symbols, names and numbers that have words, and the words, in the order of replacement.
SYMBOLS = {
    "=": " equals ", "≈": " approximately equals ", "≠": " does not equal ", "≡": " is equivalent to ",
    "+": " plus ", "-": " minus ", "−": " minus ", "×": " times ", "*": " times ", "÷": " divided by ", "/": " divided by ",
    "±": " plus or minus ", "∓": " minus or plus ", "<": " is less than ", ">": " is greater than ",
    "≤": " is less than or equal to ", "≥": " is greater than or equal to ", "≪": " is much less than ", "≫": " is much greater than ",
    "∞": " infinity ", "∑": " sum ", "∏": " product ", "∫": " integral ", "∂": " partial derivative ", "∇": " del ",
    "√": " square root of ", "∛": " cube root of ", "∈": " is in ", "∉": " is not in ", "⊂": " is a subset of ", "⊃": " is a superset of ",
    "∪": " union ", "∩": " intersection ", "∧": " and ", "∨": " or ", "¬": " not ", "⇒": " implies ", "⇔": " if and only if ",
    "∀": " for all ", "∃": " there exists ", "π": " pi ", "Δ": " delta ", "α": " alpha ", "β": " beta ", "γ": " gamma ",
    "θ": " theta ", "λ": " lambda ", "μ": " mu ", "σ": " sigma ", "φ": " phi ", "ω": " omega ",
}
DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
FRACTIONS = {"1/2": "one half", "1/3": "one third", "2/3": "two thirds", "1/4": "one quarter", "3/4": "three quarters", "1/5": "one fifth", "1/8": "one eighth"}
FUNCTIONS = {
    "sin": "sine", "cos": "cosine", "tan": "tangent", "arcsin": "arc sine", "arccos": "arc cosine", "arctan": "arc tangent",
    "sinh": "hyperbolic sine", "cosh": "hyperbolic cosine", "tanh": "hyperbolic tangent",
    "log": "logarithm", "ln": "natural logarithm", "exp": "exponential", "sqrt": "square root",
}
ARROWS = {"→": " approaches ", "←": " comes from ", "↔": " corresponds to "}
HATS = {"ŷ": "y hat", "x̂": "x hat"}
_COUNTED = [*DIGITS, "ten"]


@dataclass(frozen=True)
class Decimals:
    """0.24 as "zero point two four"; a whole part of several digits stays in digits."""

    pattern: str = r"\b\d+\.\d+\b"

    def column(self, c: Column) -> Column:
        def one(token: Column) -> Column:
            whole, part = F.substring_index(token, ".", 1), F.substring_index(token, ".", -1)
            word = whole
            for i, w in enumerate(DIGITS):
                word = F.when(whole == str(i), F.lit(w)).otherwise(word)
                part = F.replace(part, F.lit(str(i)), F.lit(" " + w))
            return F.when(token.rlike(r"^\d+\.\d+$"), F.concat(word, F.lit(" point"), part)).otherwise(token)

        return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(rf"(?s)({self.pattern}|\w+|\W+)"), F.lit(1)), one), "")

    def sql(self, x: str) -> str:
        part = "split_part(k, '.', 2)"
        for i, w in enumerate(DIGITS):
            part = f"replace({part}, '{i}', ' {w}')"
        word = "CASE split_part(k, '.', 1) " + " ".join(f"WHEN '{i}' THEN '{w}'" for i, w in enumerate(DIGITS)) + " ELSE split_part(k, '.', 1) END"
        return rf"array_to_string(list_transform(regexp_extract_all({x}, '(?s){self.pattern}|\w+|\W+'), lambda k: CASE WHEN regexp_full_match(k, '\d+\.\d+') THEN concat({word}, ' point', {part}) ELSE k END), '')"


HAT_RULES = [Gate("_hat|" + "|".join(HATS), (*(Put(k, v) for k, v in HATS.items()), Sub(r"([a-zA-Z])_hat", r"\1 hat")))]
ARROW_RULES = [Gate("[" + "".join(ARROWS) + "]", tuple(Put(k, v) for k, v in ARROWS.items()))]
FUNCTION_RULES = [Gate(r"[a-zA-Z]\(", (*(Sub(rf"(?i)\b{k}\(", f"{v} of (") for k, v in FUNCTIONS.items()), Sub(r"([a-zA-Z])\(", r"\1 of (")))]
_CARET = r"([a-zA-Z0-9\)]+)\^"
EXPONENT_RULES = [
    Gate(f"[{SUPERSCRIPTS}]", tuple(Put(s, {"²": " squared", "³": " cubed"}.get(s, f" to the power of {DIGITS[i]}")) for i, s in enumerate(SUPERSCRIPTS))),
    Gate(r"\^", (Cases(r"[a-zA-Z0-9\)]+\^[a-zA-Z0-9\-\+]+", ((_CARET + "2", r"\1 squared"), (_CARET + "3", r"\1 cubed"), (_CARET + "1", r"\1"), (_CARET + r"([a-zA-Z0-9\-\+]+)", r"\1 to the power of \2")), r"[a-zA-Z0-9\)]+|[^a-zA-Z0-9\)]+", r"(?:[^a-zA-Z0-9\)]+|[a-zA-Z0-9\)]++(?!\^))++"),)),
]
COEFFICIENT_RULES = [Gate(r"\d[a-zA-Z]", (Cases(r"[+-]?\d+[a-zA-Z]", (
    ("-1([a-zA-Z])", r"negative \1"), (r"\+?1([a-zA-Z])", r"\1"),
    *((f"-{i}([a-zA-Z])", rf"negative {w} times \1") for i, w in enumerate(_COUNTED)), *((rf"\+?{i}([a-zA-Z])", rf"{w} times \1") for i, w in enumerate(_COUNTED)),
    (r"-(\d+)([a-zA-Z])", r"negative \1 times \2"), (r"\+?(\d+)([a-zA-Z])", r"\1 times \2")), r"\d+|[^+\-\d]+"),))]
FRACTION_RULES = [Gate("/", (*(Put(k, v) for k, v in FRACTIONS.items()), Sub(r"([a-zA-Z0-9\+\-\*]+)/([a-zA-Z0-9\+\-\*]+)", r"\1 over \2")))]
SUBSCRIPT_RULES = [Sub(r"([a-zA-Z])_([a-zA-Z0-9]+)", r"\1 sub \2")]
DECIMAL_RULES = [Gate(r"\d\.\d", (Decimals(),))]
SYMBOL_RULES = [Table(tuple(SYMBOLS.items()))]
#: All of them, in the order in which they see the text.
SPEECH_RULES = [*HAT_RULES, *ARROW_RULES, *FUNCTION_RULES, *EXPONENT_RULES, *COEFFICIENT_RULES, *FRACTION_RULES, *SUBSCRIPT_RULES, *DECIMAL_RULES, *SYMBOL_RULES, Trim()]


def math_to_speech(c: Column) -> Column:
    return rules.column(SPEECH_RULES, c)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\."), _strip), lambda x: x != "")


def tells_formula(speech: Column) -> Column:
    """Whether a formula is told: f of x, something that equals with a digit, or a power."""
    low = F.lower(speech)
    return low.contains("f(x)") | low.contains("f of x") | (low.contains("equals") & speech.rlike(r"[\p{Nd}²³¹⁰⁴-⁹]")) | low.rlike("squared|cubed|power")


def merged(df: DataFrame, speech: str, board: str, out: str) -> DataFrame:
    """df with the speech and the board text merged into one text.

    In this order: a board that the speech contains adds nothing; a short label
    is mentioned after the first sentence; a formula that the first sentence
    tells is replaced by the board's; a formula that it doesn't tell is added
    after the first sentence; anything else leaves the speech as it is. Nulls
    count as empty.
    """
    s, raw = F.coalesce(F.col(speech), F.lit("")), F.coalesce(F.col(board), F.lit(""))
    stripped = _strip(raw)
    fenced = stripped.startswith("```") & stripped.endswith("```")
    names = {n: f"_{n}" for n in ("s", "raw", "b", "spoken", "all", "first", "rest")}
    df = df.withColumns({names["s"]: s, names["raw"]: raw, names["b"]: _strip(F.when(fenced, F.regexp_replace(stripped, "^[` \n]+|[` \n]+$", "")).otherwise(stripped))})
    df = df.withColumns({names["spoken"]: math_to_speech(F.col("_b")), names["all"]: _sentences(F.col("_s"))})
    df = df.withColumns({names["first"]: F.get("_all", 0), names["rest"]: F.slice("_all", 2, F.greatest(F.size("_all"), F.lit(1)))})
    s, b, first, rest, low = F.col("_s"), F.col("_b"), F.col("_first"), F.col("_rest"), F.lower("_s")
    label = (F.length(b) < 20) & ~b.rlike(r"[=+\-*/^]")
    spaced, dotted = F.array_join(rest, " "), F.array_join(rest, ". ")
    labelled = F.when(first.isNull() | (b == ""), s).otherwise(F.concat(first, F.lit(". We're focusing on "), F.lower(b), F.lit("."), F.when(F.size(rest) > 0, F.concat(F.lit(" "), spaced)).otherwise("")))
    told = tells_formula(s)
    parts, spoken = F.split(F.lower(first), " equals "), F.split(F.lower("_spoken"), " equals ")
    replaceable = told & (F.size("_all") >= 2) & (F.size(parts) == 2) & (F.size(spoken) == 2)
    formula = F.concat(F.substring(first, F.lit(1), F.locate(" equals ", F.lower(first)) + 7), _strip(F.get(spoken, 1)))
    following = F.get(rest, 0)
    later = F.array_join(F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))), ". ")
    which = F.concat(formula, F.lit(", which represents "), _strip(F.substring(following, 8, 1 << 30)), F.when(F.size(rest) > 1, F.concat(F.lit(". "), later)).otherwise(""))
    replaced = F.when(F.lower(following).startswith("this is"), which).otherwise(F.concat(formula, F.lit(". "), spaced, F.lit(".")))
    ending = F.lower(first).rlike("(?:function|equation|formula|expression)$") & (F.size(rest) == 0)
    added = F.concat(first, F.when(ending, F.lit(", ")).otherwise(F.lit(", that is, ")), F.col("_spoken"), F.lit("."), F.when(F.size(rest) > 0, F.concat(F.lit(" "), dotted, F.lit("."))).otherwise(""))
    value = (F.when((b != "") & low.contains(F.lower(b)), s).when(label, labelled).when(replaceable, replaced)
             .when(~F.col("_raw").contains("=") | first.isNull(), s).otherwise(added))
    return df.withColumn(out, value).drop(*names.values())


def tts_text(df: DataFrame, speech: str, board: str, markdown: str, out: str) -> DataFrame:
    """Like merged(), with the board's markdown preferred; if one side is empty, the other one alone (a board as speech)."""
    s = _strip(F.coalesce(F.col(speech), F.lit("")))
    b = F.coalesce(F.nullif(_strip(F.coalesce(F.col(markdown), F.lit(""))), F.lit("")), _strip(F.coalesce(F.col(board), F.lit(""))))
    df = merged(df.withColumns({"_speech": s, "_board": b}), "_speech", "_board", "_merged")
    value = F.when(F.col("_board") == "", F.col("_speech")).when(F.col("_speech") == "", math_to_speech(F.col("_board"))).otherwise(F.col("_merged"))
    return df.withColumn(out, value).drop("_speech", "_board", "_merged")


def explanation(speech: Column, board: Column, markdown: Column) -> Column:
    """The speech followed by the board's equation, unless the speech has it or it is under five characters."""
    s = _strip(F.coalesce(speech, F.lit("")))
    text = F.coalesce(board, F.lit(""))
    b = F.coalesce(F.nullif(_strip(F.coalesce(markdown, F.lit(""))), F.lit("")), _strip(text))
    return (F.when((s == "") & (b == ""), F.lit("")).when(b == "", s).when(s == "", F.concat(F.lit("On the board: "), b))
            .when(F.lower(s).contains(F.lower(text)) | (F.length(text) < 5), s).otherwise(F.concat(s, F.lit(" On the board, the equation is "), b, F.lit("."))))
