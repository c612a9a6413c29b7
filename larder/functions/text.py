"""Text columns: folding, cleaning, whole-phrase tests, trigram similarity.

All of it is column expressions on the JVM, without Python workers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = r"[\u0300-\u036f]"
SPACES = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
# Runs of white space that are not one plain space already.
_UNEVEN = rf"(?:[{SPACES[3:-2]}\t\n\x0B\f\r]| (?={SPACES[:-1]})){SPACES[:-1]}*"
# JavaScript's \b is an ASCII word boundary; Java's is not, so spell it out.
ASCII_START = r"(?<![A-Za-z0-9_])"
ASCII_END = r"(?![A-Za-z0-9_])"
LETTER_START = r"(?<![\p{L}\p{N}])"
LETTER_END = r"(?![\p{L}\p{N}])"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` names it.

    A filter makes a column anew wherever its condition names it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(text), f"^{SPACES}|{SPACES}$", "")


def _normalised(text: Column, form: str, compatible: bool) -> Column:
    """Spark has no normalisation function, but ships ICU, whose static methods a column may call; ASCII stays as it is."""
    made = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(form), text, F.lit(compatible))
    return F.when(text.rlike(r"[^\x00-\x7F]"), made).otherwise(text)


def nfd(text: Column | str) -> Column:
    """Canonical decomposition."""
    return _normalised(_col(text), "decompose", False)


def nfkc(text: Column | str) -> Column:
    """Compatibility decomposition, then composition."""
    return _normalised(_col(text), "compose", True)


def strip_marks(text: Column | str) -> Column:
    return F.regexp_replace(nfd(text), MARKS, "")


def fold(text: Column | str) -> Column:
    """Accent-free lower case.  The letter đ is not an accented d and stays."""
    return strip_marks(F.lower(_col(text)))


def fold_sql(expression: str) -> str:
    """`fold` as a SQL fragment, for callers that assemble SQL text."""
    low = f"lower({expression})"
    form = f"CASE WHEN {low} RLIKE '[^\\\\x00-\\\\x7F]' THEN reflect('com.ibm.icu.text.Normalizer', 'decompose', {low}, false) ELSE {low} END"
    return f"regexp_replace({form}, '[\\\\u0300-\\\\u036f]', '')"


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), _UNEVEN, " "))


def clean(text: Column | str) -> Column:
    """Compatibility form, trimmed, runs of white space collapsed."""
    return collapse(nfkc(text))


def match_key(text: Column | str) -> Column:
    """Fold that also maps đ to d and collapses spaces; NULL for blank text."""
    return folded_key(fold(nfkc(text)))


def folded_key(folded: Column) -> Column:
    """`match_key` of a text whose compatibility form is folded already."""
    key = collapse(F.translate(folded, "đ", "d"))
    return once(key, lambda k: F.when(k != "", k))


def panel_key(text: Column | str) -> Column:
    """Letters, digits and single spaces only: key for comparing two headings."""
    key = F.translate(fold(text), "º°", "oo")
    return collapse(F.regexp_replace(key, r"[^a-z0-9\s]", " "))


def ascii_phrase(words: list[str]) -> str:
    """One pattern matching any of `words` as a whole ASCII word or phrase.

    "^" anchors a phrase at the start, "$" at the end.  Plain phrases share one pair of
    boundaries, so a position is tested once and not once per phrase.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for word in words:
        start = "^" if word.startswith("^") else ASCII_START
        end = "" if word.endswith(("$", "!")) else ASCII_END
        groups.setdefault((start, end), []).append(word.removeprefix("^"))
    return "|".join(f"{first_letter(group) if start != '^' else ''}{start}(?:{'|'.join(group)}){end}" for (start, end), group in groups.items())


def first_letter(words: list[str]) -> str:
    """A test that one of the literal `words` can begin here; a position that fails it tries none of them."""
    letters = {w[0] for w in words}
    return f"(?=[{''.join(sorted(map(re.escape, letters)))}])" if all(x.isalnum() or x in "/." for x in letters) else ""


def has_phrase(text: Column, phrase: str) -> Column:
    """Whole-phrase test on Unicode letters and digits."""
    return text.rlike(LETTER_START + re.escape(phrase) + LETTER_END)


def drop_phrase(text: Column, phrase: str) -> Column:
    """Replace each whole occurrence, together with the separator before it, by a space."""
    pattern = r"(?iu)(^|[^\p{L}\p{N}])" + re.escape(phrase) + r"(?=$|[^\p{L}\p{N}])"
    return F.regexp_replace(text, pattern, " ")


def truncate(text: Column | str, limit: int) -> Column:
    text = valid_text(text)
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def valid_text(text: Column | str) -> Column:
    return F.make_valid_utf8(_col(text))


def letters_key(text: Column | str) -> Column:
    """Lower-case letters and digits only."""
    return F.lower(F.regexp_replace(_col(text), r"[^\p{L}\p{N}]+", ""))


def search_terms(text: Column | str, stop_words: list[str], limit: int = 6) -> Column:
    """Distinct words of the folded text, at least two letters, without stop words."""
    words = F.split(fold(trim(text)), r"[^a-z0-9]+")
    words = F.filter(words, lambda w: F.char_length(w) >= 2)
    stop = F.array(*[F.lit(w) for w in stop_words])
    words = F.filter(words, lambda w: ~F.array_contains(stop, w))
    return F.slice(F.array_distinct(words), 1, limit)


def trigrams(text: Column | str) -> Column:
    """Distinct padded three-letter sequences of every word."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.char_length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def gram_similarity(left: Column, right: Column) -> Column:
    """Shared over united trigrams of two precomputed trigram arrays."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    united = F.size(left) + F.size(right) - shared
    return F.when(left.isNull() | right.isNull(), None).otherwise(
        F.when(united > 0, shared / united).otherwise(F.lit(0.0))
    )


def similarity(left: Column | str, right: Column | str) -> Column:
    return gram_similarity(trigrams(left), trigrams(right))


def like_pattern(text: Column | str) -> Column:
    """`%text%` for a case-blind LIKE; a stray escape character means the letter itself."""
    body = F.regexp_replace(F.lower(_col(text)), r"\\([^%_\\])", "$1")
    return F.concat(F.lit("%"), body, F.lit("%"))


def contains_like(text: Column | str, pattern: Column) -> Column:
    """Case-blind LIKE against a pattern column made by `like_pattern`."""
    return F.call_function("like", F.lower(_col(text)), pattern)


def place_language(text: Column | str) -> Column:
    text = _col(text)
    return F.when(text.rlike("[ăâđêôơưĂÂĐÊÔƠƯ]"), F.lit("vi")).when(
        text.rlike("[a-zA-Z]"), F.lit("en")
    )


def clock(minutes: Column | str) -> Column:
    """Minutes of the day as HH:MM."""
    minutes = _col(minutes)
    return F.concat(
        F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((minutes % 60).cast("string"), 2, "0"),
    )
