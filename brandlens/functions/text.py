"""Column-level text functions. All are built-in Spark expressions (codegen, no Python)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FUZZY_MAX_DISTANCE, FUZZY_MIN_WORD, PUNCTUATION, STOP_WORDS

# Python's str.split() whitespace, spelled as a Java regex class. Java's \s misses
# U+00A0, U+2000.. etc., which Python treats as blanks.
WHITESPACE_RE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]+"
# The same, or an ASCII punctuation character: what stands between words.
BREAK_RE = WHITESPACE_RE[:-2] + "".join(f"\\{c}" for c in PUNCTUATION) + "]+"
# Word characters in the Unicode sense (Python's \w), for runs of letters/digits/_.
WORD_CHARS = r"[\p{L}\p{N}_]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_words(c) -> Column:
    """Lower-case, punctuation to blanks, split on Unicode whitespace, keep all tokens."""
    parts = F.split(F.lower(F.coalesce(_col(c), F.lit(""))), BREAK_RE)
    return F.filter(parts, lambda x: x != F.lit(""))


def tokenise(c, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Search tokens: split_words minus stop words and 1-character tokens.

    The stop list is an IN list, which Catalyst turns into a hash-set lookup (INSET).
    """
    parts = F.split(F.lower(F.coalesce(_col(c), F.lit(""))), BREAK_RE)
    if not stop_words:
        return F.filter(parts, lambda x: F.length(x) > 1)
    stop = list(stop_words)
    return F.filter(parts, lambda x: (F.length(x) > 1) & ~x.isin(stop))


def tokenise_py(text: str | None, stop_words: Iterable[str] = STOP_WORDS) -> list[str]:
    """The same tokeniser for a parameter string (e.g. a BM25 query) on the driver."""
    if not text:
        return []
    stop = set(stop_words)
    t = text.lower().translate(str.maketrans(PUNCTUATION, " " * len(PUNCTUATION)))
    return [w for w in t.split() if len(w) > 1 and w not in stop]


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace in Python's sense (not only blanks)."""
    ws = WHITESPACE_RE[:-1]  # the class without the trailing '+'
    return F.regexp_replace(_col(c), f"^{ws}+|{ws}+$", "")


def nullif_empty(c) -> Column:
    c = _col(c)
    return F.when(c != F.lit(""), c)


def combined_text(title="title", text="text") -> Column:
    """Title and text joined by one blank, empty or missing parts skipped."""
    return F.concat_ws(" ", nullif_empty(title), nullif_empty(text))


def sentiment_text(platform="platform", title="title", text="text") -> Column:
    """Text scored for sentiment: reddit posts use title + text, other sources text only."""
    t = F.coalesce(_col(text), F.lit(""))
    both = py_strip(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), t))
    return F.when(_col(platform) == F.lit("reddit"), both).otherwise(t)


def first_nonempty(*cols) -> Column:
    """`a or b or c` of the original code: the first value that is neither NULL nor ''."""
    return F.coalesce(*[nullif_empty(c) for c in cols])


def contains_any(c, words: Sequence[str], whole_word: bool = False) -> Column:
    """True if the lower-cased text contains any of the words.

    Substring semantics by default (so "app" matches "happy", as in the original); with
    `whole_word`, a match must not touch another letter, digit or underscore.
    """
    if not words:
        return F.lit(False)
    lc = F.lower(F.coalesce(_col(c), F.lit("")))
    if whole_word:
        import re

        alt = "|".join(re.escape(w.lower()) for w in words)
        return lc.rlike(f"(?<!{WORD_CHARS})(?:{alt})(?!{WORD_CHARS})")
    out = None
    for w in words:
        e = F.instr(lc, w.lower()) > 0
        out = e if out is None else (out | e)
    return out


def word_runs(c, min_len: int = FUZZY_MIN_WORD) -> Column:
    """All runs of >= min_len word characters in the lower-cased text."""
    pattern = f"{WORD_CHARS}{{{min_len},}}"
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(pattern), 0)


def fuzzy_contains(c, variants: Sequence[str], max_distance: int = FUZZY_MAX_DISTANCE,
                   min_len: int = FUZZY_MIN_WORD) -> Column:
    """True if some word run is within `max_distance` edits of some variant.

    Words are whole runs of >= min_len word characters; the length guard keeps the
    edit-distance call cheap and matches the original short-circuit exactly.
    """
    if not variants:
        return F.lit(False)

    def near(w):
        e = None
        for v in variants:
            v = v.lower()
            t = (F.abs(F.length(w) - F.lit(len(v))) <= max_distance) & \
                (F.levenshtein(w, F.lit(v), max_distance).between(0, max_distance))
            e = t if e is None else (e | t)
        return e

    return F.exists(word_runs(c, min_len), near)


def clamp_relevance(raw, default: int = 5) -> Column:
    """int(float(x)) clamped to 0..10; NULL, non-numeric, NaN and +-Inf give `default`.

    Clamped as a double before the cast so huge values do not overflow to NULL.
    """
    dbl = _col(raw).try_cast("double")
    bad = dbl.isNull() | F.isnan(dbl) | (F.abs(dbl) == F.lit(float("inf")))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(10.0), dbl))
    return F.when(bad, F.lit(default)).otherwise(clamped.cast("int")).cast("int")


def choose(raw, allowed: Sequence[str], default: str) -> Column:
    """trim + lower, keep if in the allowed set, else default. NULL -> default."""
    v = F.lower(py_strip(_col(raw)))
    return F.when(v.isin(list(allowed)), v).otherwise(F.lit(default))
