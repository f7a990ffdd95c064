"""Text normalisation, Unicode script and junk-text rules as Column expressions.

Nothing here uses a repeated group in a regular expression: Java matches those by recursion and overflows its
stack on long texts. Every rule is a single character class, or works on an array of tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 white-space code points that strip() and \s of the record format know.
WS = r"\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

# Inclusive code point ranges of each script, in the order in which ties resolve.
SCRIPT_RANGES: tuple[tuple[str, tuple[tuple[int, int], ...]], ...] = (
    ("arabic", ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("cyrillic", ((0x0400, 0x04FF), (0x0500, 0x052F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("greek", ((0x0370, 0x03FF), (0x1F00, 0x1FFF))),
    ("hebrew", ((0x0590, 0x05FF),)),
    ("devanagari", ((0x0900, 0x097F),)),
    ("thai", ((0x0E00, 0x0E7F),)),
    ("cjk", ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x30FF), (0xAC00, 0xD7AF))),
    ("latin", ((0x0041, 0x007A), (0x00C0, 0x024F), (0x1E00, 0x1EFF))),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: Catalyst puts an expression wherever it is used, also inside lambdas, where it would be
    worked out for every element."""
    return F.transform(F.array(value), body)[0]


def strip_ws(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def collapse_ws(c: Column) -> Column:
    """White-space runs become one space, none at the ends; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{WS}]+", " "))


def compact(c: Column) -> Column:
    """Without any white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"[{WS}]+", "")


def is_blank(c: Column) -> Column:
    return compact(c) == ""


def _class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def script_counts(text: Column) -> dict[str, Column]:
    """Characters of each script; digits, spaces and signs count for none."""
    return {name: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_class(r))) for name, r in SCRIPT_RANGES}


def primary_script(text: Column) -> Column:
    """The script most characters are of; ties go to the earlier table entry, no letters at all to 'unknown'."""
    counts = F.array(*script_counts(text).values())
    names = F.array(*(F.lit(name) for name, _ in SCRIPT_RANGES))

    def pick(n: Column) -> Column:
        first = F.array_position(n, F.array_max(n)).cast("int")
        return F.when(F.array_max(n) > 0, F.element_at(names, F.greatest(first, F.lit(1)))).otherwise(F.lit("unknown"))

    return let(counts, pick)


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def ngrams(ws: Column, n: int) -> Column:
    """Space-joined n-grams of an array of words, empty if there are fewer than n."""
    size = F.size(ws) - (n - 1)
    return F.when(
        size >= 1, F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))
    ).otherwise(F.array().cast("array<string>"))


def longest_run(items: Column) -> Column:
    """Times the most frequent item occurs: sort, then fold over run lengths, so O(n log n)."""
    start = F.struct(F.lit("").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("top"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(acc["v"] == x, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("v"), n.alias("n"), F.greatest(acc["top"], n).alias("top"))

    return F.aggregate(F.array_sort(items), start, step, lambda acc: acc["top"])


def max_ngram_repeats(text: Column, n: int) -> Column:
    return let(words(text), lambda ws: longest_run(ngrams(ws, n)))


def token_share(tokens: Column, value: str) -> Column:
    """Share of the tokens that equal value."""
    return F.try_divide(F.size(F.filter(tokens, lambda t: t == value)).cast("double"), F.size(tokens))


# The signs that symbol-only decodes consist of.
SYMBOLS = r"#_\-=|.,:;/+*()\[\]"
# Tokens that dominate decodes of ruled lines.
ZERO_TOKENS = ("0", "00", "000", "0000")


def _symbols(c: Column) -> Column:
    return c.rlike(rf"\A[{SYMBOLS}]{{3,}}\z")


def _low_diversity(c: Column) -> Column:
    return (F.char_length(c) >= 40) & (F.size(F.array_distinct(F.split(F.lower(c), ""))) <= 3)


def _zero_groups(t: Column) -> Column:
    rest = F.substring(t, 2, 2**31 - 1)
    return (F.char_length(t) >= 30) & t.rlike(r"\A\p{Nd}[\p{Nd} ]*\z") & F.regexp_replace(rest, " ?000", "Z").rlike(r"\AZ{8,} ?\p{Nd}?\z")


def _zero_tokens(t: Column) -> Column:
    def dominant(tokens: Column) -> Column:
        return (F.size(tokens) >= 10) & reduce(lambda a, b: a | b, [F.coalesce(token_share(tokens, z) >= 0.8, F.lit(False)) for z in ZERO_TOKENS])

    # a text without a zero token is not taken apart
    return F.when(t.rlike(r"(?:\A| )0{1,4}(?: |\z)"), let(F.split(t, " "), dominant)).otherwise(False)


def _letter_soup(t: Column) -> Column:
    return ~t.rlike("[^A-Za-z ]|[^ ]{2}") & (F.size(F.split(t, " ")) >= 9)


def _repetition(text: Column) -> Column:
    return let(words(text), lambda ws: (F.size(ws) >= 12) & ((longest_run(ngrams(ws, 2)) >= 6) | (longest_run(ngrams(ws, 3)) >= 4)))


def placeholder_rules(text: Column) -> dict[str, Column]:
    """The junk-decode rules by name. Each is a boolean Column that is never null; null text is blank."""
    t, c = collapse_ws(text), compact(text)
    return {
        "blank": c == "",
        "symbols": _symbols(c),
        "low_diversity": let(c, _low_diversity),
        "zero_groups": let(t, _zero_groups),
        "zero_tokens": let(t, _zero_tokens),
        "letter_soup": let(t, _letter_soup),
        "repetition": _repetition(text),
        "zeros": c.rlike(r"\A0{8,}\z"),
        "digits": c.rlike(r"\A\p{Nd}{40,}\z"),
    }


def is_placeholder(text: Column) -> Column:
    """Whether the text is a junk decode: any of placeholder_rules, the cheap ones first, each form of the text worked out once."""
    by_compact = let(compact(text), lambda c: (c == "") | _symbols(c) | c.rlike(r"\A(?:0{8,}|\p{Nd}{40,})\z") | _low_diversity(c))
    by_line = let(collapse_ws(text), lambda t: _zero_groups(t) | _letter_soup(t) | _zero_tokens(t))
    return by_compact | by_line | _repetition(text)


def kept_text(text: Column, placeholder: Column) -> Column:
    """Whether a block's text goes into page text: not blank and not flagged."""
    return ~is_blank(text) & ~F.coalesce(placeholder, F.lit(False))
