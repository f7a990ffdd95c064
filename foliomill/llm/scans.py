"""Noise in text from scanned pages: broken words, misrecognised characters, running heads and page numbers.

Lines are labelled as body, head, page number or blank by a hidden Markov model decoded with Viterbi. Its transitions and emissions are
estimated from the labelled pages of `scan_labels`; what it observes are layout features: place on the page, length, terminator, whether
the line runs on, whether it is the printed number of this page, and whether it returns on other pages of its run, which is counted
over all blocks first. Paragraphs are then put together without heads and numbers, with words mended over line ends.

Misread words are found in the table of distinct words: a word is a misreading if undoing one confusion of characters gives a word
that is far more frequent, or if a sign stands inside it. Every distinct word is judged, however frequent, and every word of
COMMON_LEAST occurrences may be what was meant, however large the corpus; only the distinct words pass through Python, and the verdicts
are joined back.

Defined cases. Null and blank texts have no defects and come out unchanged. Heads and numbers are looked for in whole pages
(block_id is null) only; a null page has no number, a null run forms one run. Repeated rows are judged each, and don't make a line
recurrent, as pages are counted. Only the named columns are read. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import scan_labels
from .residue import joined
from .scan_labels import BLANK, BODY, HEAD, NUMBER

HEAD_PAGES = 2
#: A word must occur so often to be what was meant.
COMMON_LEAST = 8
#: Up to so many of these words, of at most WORD_CHARS characters, are sent to every worker; beyond that the readings of each word are
#: joined with the table of words instead, with the same result.
MAX_COMMON, WORD_CHARS = 200_000, 64
#: How much more frequent the word meant must be, if the misreading is all letters, or has a sign or digit inside.
RATIO_LETTERS, RATIO_SIGNS = 20, 4
#: By how much more for a reading of two letters, which is as likely a word of another language.
SHORT = 5
#: Words of this share of all occurrences, at most 1/share of them, are joined by broadcast.
HOT_SHARE = 1 / 20_000

DAGGER, SOFT, NOT_SIGN, HYPHEN = map(chr, (0x2020, 0xAD, 0xAC, 0x2010))
# What recognisers take for what, as observed in scans.
CONFUSIONS = (
    ("c", "e"), (DAGGER, "t"), ("@", "a"), ("!", "i"), ("0", "o"), ("ri", "n"), ("5", "s"), ("cl", "d"), ("1", "l"), ("1", "i"), ("ii", "u"), ("|", "l"), ("9", "g"), ("rn", "m"),
    ("b", "h"), ("m", "in"), ("m", "rn"), ("6", "b"), ("vv", "w"), ("d", "cl"), ("0", chr(0x43E)), ("8", "b"), ("3", chr(0x437)), ("6", chr(0x431)), ("|", "i"), ("!", "l"), ("li", "h"),
)
SIGNS = DAGGER + "@!|"
_SIGN_INSIDE = re.compile(rf"[^\W\d_][{re.escape(SIGNS)}][^\W\d_]|^[{DAGGER}|!][^\W\d_]{{3}}|[^\W\d_]{{3}}[{DAGGER}|@]$")
_INTRUDER = re.compile(rf"[{re.escape(SIGNS)}\d]")

# ---- words


def tokens(text: Column) -> Column:
    """Lower-case words of the mended text, signs inside them kept; without mail addresses and exclamation marks that end something."""
    t = F.regexp_replace(joined(text), r"\S*@\S*\.\p{L}\S*|<[^<>]*>|\b\S*\w+://\S*|!+(?=\s*\z|\s+[\p{Lu}\p{Nd}\"'(/]|[\"')\]])", " ")
    return F.regexp_extract_all(F.lower(t), F.lit(rf"[\p{{L}}\p{{M}}\p{{Nd}}{DAGGER}@|!]*\p{{L}}[\p{{L}}\p{{M}}\p{{Nd}}{DAGGER}@|!]*"), F.lit(0))


def readings(word: str) -> list[tuple[int, str, int]]:
    """(stage, word that may have been meant, how much more frequent it must be) of a word; an earlier stage goes first."""
    if len(word) < 3 or re.fullmatch(r"\d+(st|nd|rd|th|e|er|re|º|ª)", word):
        return []
    intruded = _INTRUDER.search(word) is not None
    ratio = RATIO_SIGNS if intruded else RATIO_LETTERS
    out: dict[tuple[int, str], int] = {}
    for wrong, right in CONFUSIONS:
        at = word.find(wrong)
        while at >= 0:
            out.setdefault((0, word[:at] + right + word[at + len(wrong) :]), ratio)
            at = word.find(wrong, at + 1)
    if intruded:  # several signs in one word, then also one confusion of letters
        for one in ("l", "i"):
            plain = word.translate(str.maketrans({DAGGER: "t", "@": "a", "!": "i", "|": one, "0": "o", "1": one, "5": "s", "6": "b", "9": "g"}))
            out.setdefault((1, plain), ratio)
            for wrong, right in CONFUSIONS:
                if wrong.isalpha() and wrong in plain:
                    out.setdefault((2, plain.replace(wrong, right, 1)), ratio)
    else:  # two confusions of letters
        for i, (w1, r1) in enumerate(CONFUSIONS):
            if w1.isalpha() and w1 in word:
                once = word.replace(w1, r1, 1)
                for w2, r2 in CONFUSIONS[i:]:
                    if w2.isalpha() and w2 in once:
                        out.setdefault((1, once.replace(w2, r2, 1)), 3 * RATIO_LETTERS)
    return [(stage, w, r if len(w) > 2 else r * SHORT) for (stage, w), r in out.items() if w != word]


def surely_misread(word: str) -> bool:
    """Whether a sign inside a word tells that it is misread, whatever was meant."""
    if len(word) < 3 or not _INTRUDER.search(word) or not _SIGN_INSIDE.search(word) or sum(map(str.isalpha, word)) < 3:
        return False
    return "|" not in word[1:-1].strip("abcdefghijklmnopqrstuvwxyz" + word)


def _meant(word: str, n: int, common: dict[str, int]) -> str | None:
    """The frequent word this one is a misreading of; '' if it surely is one of an unknown word."""
    best = min(((stage, -common[w], w) for stage, w, ratio in readings(word) if common.get(w, 0) >= ratio * n), default=None)
    return best[2] if best else "" if surely_misread(word) else None


def misread_words(df: DataFrame, max_common: int = MAX_COMMON) -> tuple[DataFrame, DataFrame]:
    """word, n, meant of every word (meant is null if it isn't misread), and how many there are in all."""
    words = materialize(df.select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "scan-words")
    plain = words.where((F.col("n") >= COMMON_LEAST) & (F.char_length("word") <= WORD_CHARS) & F.col("word").rlike(r"\A\p{L}+\z"))
    known = plain.limit(max_common + 1).collect()  # at most MAX_COMMON words of WORD_CHARS characters
    spread = words.repartition("word")
    if len(known) <= max_common:
        common = df.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in known})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = pdf[["word", "n"]].assign(meant=[_meant(w, n, common.value) for w, n in zip(pdf["word"], pdf["n"])])
                yield out[[m is not None for m in out["meant"]]]

        return materialize(spread.mapInPandas(run, "word string, n long, meant string"), "misread"), words

    def offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w, n in zip(pdf["word"], pdf["n"]):
                rows += [(w, n, stage, r, ratio * n) for stage, r, ratio in readings(w)]
                if surely_misread(w):
                    rows.append((w, n, 9, None, 0))
            yield pd.DataFrame(rows, columns=["word", "n", "stage", "reading", "least"])

    offers = spread.mapInPandas(offer, "word string, n long, stage int, reading string, least long")
    hits = offers.join(plain.select(F.col("word").alias("w"), F.col("n").alias("m")), F.col("reading") == F.col("w")).where(F.col("m") >= F.col("least"))
    sure = offers.where("stage = 9").withColumn("m", F.lit(0).cast("long")).withColumn("reading", F.lit(""))
    every = hits.select("word", "n", "stage", "m", "reading").unionByName(sure.select("word", "n", "stage", "m", "reading"))
    best = every.groupBy("word").agg(F.first("n").alias("n"), F.min_by("reading", F.struct("stage", -F.col("m"), F.col("reading"))).alias("meant"))
    return materialize(best.select("word", "n", "meant"), "misread"), words


def misreadings(df: DataFrame, max_common: int = MAX_COMMON) -> DataFrame:
    """ocr_id, fixes: the misread words of each block that has some, with what was meant."""
    misread, words = misread_words(df, max_common)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = (F.col("n") >= max(COMMON_LEAST, total * HOT_SHARE)) & (F.char_length("word") <= WORD_CHARS)
    # the verdicts of hot words, misread or not, are at most 1/HOT_SHARE rows and are broadcast; the other words are joined by a shuffle
    # in which no key can hold more than HOT_SHARE of the rows
    near = words.where(hot).select("word", F.lit(True).alias("hot")).join(misread.where(hot).select("word", "meant"), "word", "left")
    spread = df.select("ocr_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).join(F.broadcast(near), "word", "left")
    spread = spread.where(F.col("hot").isNull() | F.col("meant").isNotNull())
    far = spread.where("hot is null").select("ocr_id", "word").join(misread.where(~hot).select("word", "meant"), "word")
    both = spread.where("hot").select("ocr_id", "word", "meant").unionByName(far.select("ocr_id", "word", "meant")) if not near.where("meant is not null").isEmpty() else far
    return both.groupBy("ocr_id").agg(F.collect_set(F.struct("word", "meant")).alias("fixes"))


# ---- lines

_ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def roman(n: int) -> str:
    out = ""
    for value, sign in _ROMAN:
        while n >= value:
            out, n = out + sign, n - value
    return out


# Words for page, and between the number and the count of pages.
_PAGE_WORD = "page|pg|p|seite|s|pag|página|pagina|pág|blz|bladzijde|страница|стр|сторінка|стор|с|σελίδα|σελ|صفحة|الصفحة|folio|fol"
_OF = r"\s*(?:/|of|von|de|di|da|sur|van|out of|из|з|από|من|\|)\s*"


# Kept by page in plain dictionaries: a function in lru_cache goes to the workers by its module's name, which they may not have.
_PATTERNS: dict[int, tuple[re.Pattern, re.Pattern, re.Pattern]] = {}
KEPT_PATTERNS = 16_384


def number_patterns(page: int) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """The printed number of this page: as a whole line, at the head of one, at its end."""
    if page not in _PATTERNS:
        if len(_PATTERNS) >= KEPT_PATTERNS:
            _PATTERNS.clear()
        _PATTERNS[page] = _number_patterns(page)
    return _PATTERNS[page]


def _number_patterns(page: int) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    n = rf"(?:0*{page}|{roman(page)})" if 0 < page < 4000 else rf"0*{page}"
    open_, close = r"[\[(<*~_=.\-–—·• ]*", r"[\])>*~_=.\-–—·• ]*"
    word = rf"(?:(?:{_PAGE_WORD})\.?\s*)"
    core = rf"(?:{word}?{n}(?:{_OF}\d+)?)"
    wide = rf"第\s*{n}\s*[页頁ページ]+|{n}\s*(?:页|頁|ページ)"
    marked = rf"(?:{word}{n}(?:{_OF}\d+)?|{n}{_OF}\d+|[\[(\-–—]\s*{n}\s*[\])\-–—])"
    return (
        re.compile(rf"{open_}(?:{core}|{wide}){close}", re.I),
        re.compile(rf"(?:{open_}{core}{close}\s{{2,}}|{marked}\s+)(?=\S)", re.I),
        re.compile(rf"(?:\s{{2,}}{open_}{core}{close}|\s+{marked})$", re.I),
    )


_TERMINATED = re.compile("[.!?;:," + chr(0x3002) + chr(0x061F) + chr(0xFF0C) + "]$")
_LETTER = re.compile(r"[^\W\d_]")


def norm(line: str) -> str:
    return " ".join(line.split()).casefold()


def variants(line: str, patterns: tuple[re.Pattern, ...] | None) -> list[tuple[str, bool]]:
    """Readings of a line as a head: (normalised line, whether a page number stood beside it)."""
    if patterns is not None and patterns[0].fullmatch(line):
        return []  # the number alone
    out = [(norm(line), False)]
    if patterns is not None:
        for p in patterns[1:]:
            rest = p.sub("", line, count=1)
            if rest != line and _LETTER.search(rest):
                out.append((norm(rest), True))
        # a bare number at the end counts only beside a line that returns without it
        bare = re.sub(r"\s+[\divxlcdm]+$", "", line)
        if bare != line and patterns[0].fullmatch(line[len(bare) :].strip()):
            out.append((norm(bare), True))
    return out


_BROKEN_END = re.compile(rf"[^\W\d_][-{SOFT}{NOT_SIGN}{HYPHEN}]$")
_ENDED = re.compile("[.!?" + chr(0x3002) + "]$")


def layout(lines: list[str], patterns: tuple[re.Pattern, ...] | None) -> list[tuple | None]:
    """Of each line that isn't blank: (text, text above, text below, place, whether it runs on, whether it is this page's number). Place is
    'alone' between blank lines, 'edge' among the first or last two lines, 'between' a finished line and one that begins anew, or 'inside'.
    A page number above or below counts as blank."""
    texts = [line.strip() for line in lines]
    is_number = [bool(x) and patterns is not None and patterns[0].fullmatch(x) is not None for x in texts]
    before, n = [], 0  # lines with text before each line
    for x in texts:
        before.append(n)
        n += bool(x)
    out: list[tuple | None] = []
    for i, s in enumerate(texts):
        if not s:
            out.append(None)
            continue
        above = texts[i - 1] if i and not is_number[i - 1] else ""
        below = texts[i + 1] if i + 1 < len(texts) and not is_number[i + 1] else ""
        first = before[max(i - 1, 0)] == 0
        last = i + 2 >= len(texts) or before[i + 2] == n
        if not above and not below:
            place = "alone"
        elif first or last:
            place = "edge"
        elif _ENDED.search(above) and (not below or below[:1].isupper()):
            place = "between"
        else:
            place = "inside"
        runs_on = not is_number[i] and (below[:1].islower() or (s[0].islower() and not s.startswith("p.")) or _BROKEN_END.search(s) is not None)
        out.append((s, above, below, place, runs_on, is_number[i]))
    return out


def head_like(seen: tuple | None) -> bool:
    """Whether a line is counted as one that may be a head: it has letters, doesn't run on and doesn't stand inside a paragraph."""
    return seen is not None and not seen[5] and seen[3] != "inside" and not seen[4] and _LETTER.search(seen[0]) is not None


STATES = (BODY, HEAD, NUMBER, BLANK)


def observed(seen: tuple, returns: bool, by_head: bool) -> tuple[tuple, ...]:
    """What the model observes of a line, as independent groups: its layout as one, its length as another."""
    s, _, _, place, runs_on, is_number = seen
    finished = _TERMINATED.search(s) is not None and not s.isupper()
    return ("line", returns and not is_number, runs_on, place, is_number, by_head and is_number, finished), ("size", min(len(s) // 20, 5))


def returning(seen: tuple, patterns: tuple[re.Pattern, ...] | None, heads: set[str]) -> tuple[bool, bool]:
    """Whether a line is one of the lines that return, and whether only without a page number beside it."""
    hits = [beside for text, beside in variants(seen[0], patterns) if text in heads]
    return bool(hits), bool(hits) and all(hits)


def _observations(lines: list[str], patterns: tuple[re.Pattern, ...] | None, heads: set[str]) -> list[tuple[tuple, bool] | None]:
    """Of each line what is observed, and whether a page number stands beside a line that returns."""
    seen = layout(lines, patterns)
    back = [(False, False) if x is None or x[5] else returning(x, patterns, heads) for x in seen]
    out: list[tuple[tuple, bool] | None] = []
    for i, x in enumerate(seen):
        if x is None:
            out.append(None)
            continue
        by_head = x[5] and any(0 <= j < len(seen) and back[j][0] for j in (i - 1, i + 1))
        out.append((observed(x, back[i][0], by_head), back[i][1]))
    return out


_MODELS: dict[tuple[int, int], tuple] = {}


def line_model(runs: int = scan_labels.RUNS, seed: int = scan_labels.SEED) -> tuple[list, list, list, float]:
    """(log emissions by state and observation, log transitions, log start, log of what was never observed), estimated from the labelled
    pages by counts with half a count added to each; once a process."""
    if (runs, seed) not in _MODELS:
        _MODELS[runs, seed] = _line_model(runs, seed)
    return _MODELS[runs, seed]


def _line_model(runs: int, seed: int) -> tuple[list, list, list, float]:
    emitted: list[dict] = [{} for _ in STATES]
    total = [0] * len(STATES)
    steps = [[0.5] * len(STATES) for _ in STATES]
    start = [0.5] * len(STATES)
    values: dict[str, set] = {}
    for pages in scan_labels.table(runs, seed):
        heads = _recurrent([(page, [line for line, _ in lines]) for page, lines in enumerate(pages, 1)])
        for page, lines in enumerate(pages, 1):
            labels = [label for _, label in lines]
            for got, label in zip(_observations([line for line, _ in lines], number_patterns(page), heads), labels):
                if got is None:
                    continue
                # a head is a line that returns: one that stands on a single page can't be told from a heading
                label = BODY if label == HEAD and not got[0][0][1] else label
                total[label] += 1
                for x in got[0]:
                    values.setdefault(x[0], set()).add(x)
                    emitted[label][x] = emitted[label].get(x, 0) + 1
            if labels:
                start[labels[0]] += 1
            for a, b in zip(labels, labels[1:]):
                steps[a][b] += 1
    groups = {g: len(v) + 1 for g, v in values.items()}
    emit = [{x: math.log((emitted[k].get(x, 0) + 0.5) / (total[k] + 0.5 * groups[x[0]])) for v in values.values() for x in v} for k in STATES]
    unseen = math.log(0.5 / (max(total) + 1))
    return emit, [[math.log(x / sum(row)) for x in row] for row in steps], [math.log(x / sum(start)) for x in start], unseen


def _recurrent(pages: list[tuple[int, list[str]]]) -> set[str]:
    """The lines that may be heads and return on HEAD_PAGES pages of a run."""
    found: dict[str, set[int]] = {}
    for page, lines in pages:
        for v in _head_lines(lines, page):
            found.setdefault(v, set()).add(page)
    return {v for v, on in found.items() if len(on) >= HEAD_PAGES}


def _head_lines(lines: list[str], page: int | None) -> set[str]:
    patterns = number_patterns(page) if page is not None and page > 0 else None
    return {v for x in layout(lines, patterns) if head_like(x) for v, _ in variants(x[0], patterns)}


_NEVER = -1e9


def label_lines(lines: list[str], page: int | None, heads: set[str], model: tuple | None = None) -> tuple[list[int], bool]:
    """The most probable labels of the lines of a page, and whether a number stands beside a head."""
    emit, steps, start, unseen = model or line_model()
    patterns = number_patterns(page) if page is not None and page > 0 else None
    seen = _observations(lines, patterns, heads)
    best: list[float] = []
    back: list[list[int]] = []
    for i, got in enumerate(seen):
        if got is None:
            score = [_NEVER, _NEVER, _NEVER, 0.0]
        else:
            score = [sum(emit[k].get(x, unseen) for x in got[0]) for k in (BODY, HEAD, NUMBER)] + [_NEVER]
        if i == 0:
            best = [a + b for a, b in zip(start, score)]
            continue
        arg = [max(STATES, key=lambda a, b=b: best[a] + steps[a][b]) for b in STATES]
        best = [best[a] + steps[a][b] + score[b] for b, a in enumerate(arg)]
        back.append(arg)
    path = [max(STATES, key=lambda a: best[a])]
    for arg in reversed(back):
        path.append(arg[path[-1]])
    path.reverse()
    return path, any(got is not None and got[1] and k == HEAD for got, k in zip(seen, path))


_BROKEN = re.compile(rf"(?<=[^\W\d_])[-{SOFT}{NOT_SIGN}{HYPHEN}‑][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_TOKEN = re.compile(rf"[\w{DAGGER}@|!]*[^\W\d_][\w{DAGGER}@|!]*")


def repair(text: str, page: int | None, whole: bool, heads: set[str], fixes: dict[str, str], model: tuple | None = None) -> tuple[str, list[str]]:
    """The repaired text and the defects it had."""
    if "\n" not in text and not fixes:
        return " ".join(text.split()), []
    lines = text.replace("\r\n", "\n").split("\n")
    defects = []
    if whole and len(lines) > 1:
        labels, beside = label_lines(lines, page, heads, model)
        if HEAD in labels:
            defects.append("header")
        if NUMBER in labels or beside:
            defects.append("page_number")
        kept, last = [], None
        for line, s in zip(lines, labels):
            if s in (HEAD, NUMBER):
                # a head between the halves of a sentence is no paragraph break
                while kept and not kept[-1].strip() and last is not None and not _TERMINATED.search(last):
                    kept.pop()
                continue
            if s == BLANK and (not kept or not kept[-1].strip()):
                continue
            kept.append(line)
            last = line.strip() or last
        lines = kept
    body = "\n".join(lines).strip("\n")
    mended, n = _BROKEN.subn(lambda m: "-" if _compound(body, m) else "", body)
    if n:
        defects.append("hyphen")
    if fixes:
        defects.append("misread")
        mended = _TOKEN.sub(lambda m: _cased(m[0], fixes.get(m[0].lower()) or m[0]), mended)
    out = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", mended) if p.strip())
    return out, defects


def _compound(body: str, m: re.Match) -> bool:
    """A written hyphen before a capital letter stays."""
    return m[0][0] == "-" and body[m.end() : m.end() + 1].isupper()


def _cased(old: str, new: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


# ---- over the table


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for ocr_id, run, page, text in zip(pdf["ocr_id"], pdf["run_id"], pdf["page"], pdf["text"]):
            page = None if page is None or page != page else int(page)
            rows += [(ocr_id, run, page, v) for v in sorted(_head_lines(text.replace("\r\n", "\n").split("\n"), page))]
        yield pd.DataFrame(rows, columns=["ocr_id", "run_id", "page", "line"]).astype({"page": "Int32"})


def heads_of(df: DataFrame) -> DataFrame:
    """ocr_id, heads: the lines of each page that return on other pages of its run. Pages are counted over all blocks."""
    pages = df.where(F.col("block_id").isNull() & F.contains("text", F.lit("\n"))).select("ocr_id", "run_id", "page", "text")
    lines = materialize(pages.mapInPandas(_candidates, "ocr_id long, run_id string, page int, line string"), "head-lines")
    counted = lines.select("run_id", "line", "page").distinct().groupBy("run_id", "line").agg(F.count(F.lit(1)).alias("pages"))
    again = counted.where(F.col("pages") >= HEAD_PAGES).select(F.col("run_id").alias("r"), F.col("line").alias("l"))
    return lines.join(again, F.col("run_id").eqNullSafe(F.col("r")) & (F.col("line") == F.col("l")), "left_semi").groupBy("ocr_id").agg(F.collect_set("line").alias("heads"))


def _with_evidence(df: DataFrame) -> DataFrame:
    """The blocks with the lines that return and the misread words of each."""
    rows = df.select("ocr_id", "run_id", "page", "block_id", "text")
    both = rows.select("ocr_id", "page", F.col("block_id").isNull().alias("whole"), "text")
    return both.join(heads_of(rows), "ocr_id", "left").join(misreadings(rows), "ocr_id", "left")


def _repaired(both: DataFrame) -> DataFrame:
    model = line_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ocr_id, page, whole, text, heads, fixes in zip(pdf["ocr_id"], pdf["page"], pdf["whole"], pdf["text"], pdf["heads"], pdf["fixes"]):
                if text is None or not text.strip():
                    out.append((ocr_id, text, []))
                    continue
                page = None if page is None or page != page else int(page)
                pairs = {f["word"]: f["meant"] for f in fixes} if fixes is not None else {}
                out.append((ocr_id, *repair(text, page, bool(whole), set(heads) if heads is not None else set(), pairs, model)))
            yield pd.DataFrame(out, columns=["ocr_id", "text", "defects"])

    return both.mapInPandas(run, "ocr_id long, text string, defects array<string>")


def repaired(df: DataFrame) -> DataFrame:
    """ocr_id, text, defects of every block: the text in continuous paragraphs and the defects it had."""
    return _repaired(_with_evidence(df))


def found(df: DataFrame) -> DataFrame:
    """ocr_id, defect. A text of one line without a misread word has none, so only the others go to Python."""
    both = _with_evidence(df).where(F.contains("text", F.lit("\n")) | F.col("fixes").isNotNull())
    return _repaired(both).select("ocr_id", F.explode("defects").alias("defect")).distinct()
