"""Text normalisation and predicates on text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
MIN_WORDS = 4
DEFAULT_LANGUAGES = ["English"]
LABEL_CHARS = 20
VIDEO_SUFFIXES = [".mp4", ".mov", ".m4v"]
#: Letters whose upper case is several letters, with what stands for each where a letter must stay one, and letters with a case only since Unicode 16, which stay as they are on any JVM.
_SPLIT = {c: "ẞ" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1}
_NEW = {c: c for c in "ƛɤᲊꟍꟛ" + "".join(map(chr, range(0x10D70, 0x10D86)))}
_FROM, _TO = ("".join(x) for x in zip(*(_SPLIT | _NEW).items()))


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_line(c: Column) -> Column:
    """The key under which board lines count as the same: no back-ticks, lower case, single blanks. Null counts as empty."""
    return squeeze(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("`"), F.lit(""))))


def clean_board(c: Column) -> Column:
    """The board text without fences, case kept."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("```"), F.lit("")))


def clean_recognised(c: Column) -> Column:
    """Recognised text without zero-width blanks and fences."""
    return F.replace(strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\u200b"), F.lit(" "))), F.lit("```"), F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def long_enough(c: Column, least: int = MIN_WORDS) -> Column:
    return F.size(words(c)) >= least


def text_lines(c: Column) -> Column:
    """The stripped lines that aren't empty; any line boundary of Unicode counts."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\R|[\x1c-\x1e]"), strip), lambda x: x != "")


def dedup_clauses(c: Column) -> Column:
    """Clauses between . ; ! ? without those that repeat the one before, joined by ". "."""
    clauses = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[.;!?]+"), strip), lambda x: x != "")
    return F.array_join(F.transform(F.array(clauses), lambda a: F.array_join(F.filter(a, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(a, i - 1)))), ". ")), "")


def upper(c: Column) -> Column:
    """Upper case letter by letter, as SQL has it; Spark's makes two letters of a sharp s or a ligature."""
    stretches = F.regexp_extract_all(c, F.lit(f"[{_FROM}]+|[^{_FROM}]+"), 0)
    each = F.transform(stretches, lambda x: F.when(x.rlike(f"^[{_FROM}]"), F.translate(x, _FROM, _TO)).otherwise(F.upper(x)))
    return F.when(c.rlike(f"[{_FROM}]"), F.array_join(each, "")).otherwise(F.upper(c))


def search_text(fused: Column, board: Column) -> Column:
    return F.when(F.coalesce(board, F.lit("")) != "", F.concat(F.coalesce(fused, F.lit("")), F.lit(" | board: "), board)).otherwise(F.coalesce(fused, F.lit("")))


def languages(c: Column) -> Column:
    """The names of a comma-separated list; without any, the default."""
    names = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")
    return F.when(F.size(names) == 0, F.array(*map(F.lit, DEFAULT_LANGUAGES))).otherwise(names)


def is_label(c: Column) -> Column:
    return (F.length(c) < LABEL_CHARS) & ~c.rlike(r"[=+\-*/^]")


def mentions(speech: Column, board: Column) -> Column:
    return F.contains(F.lower(speech), F.lower(board))


def rate_limited(message: Column) -> Column:
    return F.contains(message, F.lit("429")) | F.contains(F.lower(message), F.lit("rate_limit"))


def seconds(ms: Column) -> Column:
    return ms.cast("double") / F.lit(1000.0)


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / F.lit(2.0)


def frame_url(path: Column, base: str) -> Column:
    """The address under /files/ of a path below base, or else the empty text."""
    root = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.concat(F.lit("/files/"), F.substring(path, len(root) + 1, 1 << 30))).otherwise(F.lit(""))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
