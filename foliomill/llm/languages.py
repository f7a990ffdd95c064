"""Languages of documents and of the segments of mixed ones, by prediction by partial matching.

Per language a variable-order byte context tree with escape probabilities (method C) is fitted to labelled sentences and then
frozen. A sentence costs each language an exact code length in bits: from the longest context known to the language it pays an
escape for each order it must give up, then the symbol; the last resort is a uniform byte. The cheapest language wins; the
posterior under equal priors is its confidence. The trees of all languages are one table of n-grams with a vector of costs, so that a batch of
texts is scored by a few array look-ups an order, whatever the number of languages.

A sentence stays with the text's main language unless another one explains it in SWITCH_BITS less and in SWITCH_SHARE of the bits,
or in SURE_BITS less.
Addresses of mail, numbers and capitalised words that no sample has (names) count alike for all languages.

Defined cases. Null and blank texts, and texts without a whole sentence (labels, codes, tables, headings), have no segments, unless
every text is asked for: then the paragraphs of texts without a whole sentence are the segments, and texts without letters are 'und'
with confidence 0. Of texts with whole sentences only these are segments.
Sentences that no language explains in UNKNOWN_BITS a byte are 'und'. Ties go to the language first in alphabetical order. Repeated
rows are labelled each. Only the named columns are read. Empty tables give empty results; without samples every segment is 'und'.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
#: The models are fitted on at most so many labelled sentences (a fixed table of 520 here); more are refused, not sampled.
MAX_SAMPLES = 50_000
#: Further sentences come from a sample of so many labelled blocks, of each so many characters, and at most so many of a language.
SAMPLE_BLOCKS, SAMPLE_CHARS, MORE_SENTENCES = 6_000, 4_000, 500
SWITCH_BITS = 14.0
SWITCH_SHARE = 0.8
SURE_BITS = 30.0
UNKNOWN_BITS = 7.5
LEAST_LETTERS, LEAST_WORDS, LEAST_WIDE = 12, 3, 6

_BREAK = re.compile("(?<=[^\\W\\d_])[-" + chr(0xAD) + chr(0x2010) + chr(0xAC) + "][ \t]*\r?\n[ \t]*(?=[^\\W\\d_])")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_WIDE = "[" + chr(0x3040) + "-" + chr(0x30FF) + chr(0x3400) + "-" + chr(0x9FFF) + "]"
_WIDE_GAP = re.compile("(?<=" + _WIDE[:-1] + chr(0x3001) + chr(0x3002) + "])[ \t]*\n[ \t]*(?=[" + _WIDE[1:-1] + chr(0x3001) + chr(0x3002) + "])")
_ENDS = ".!?" + chr(0x3002) + chr(0xFF01) + chr(0xFF1F) + chr(0x061F)
# Abbreviations after which a full stop ends no sentence.
_ABBREVIATIONS = "ref|no|nr|tel|fig|vol|st|rd|ave|apt|ext|mr|mrs|ms|dr|prof|sr|sra|dott|hr|fr|art|avda|av|pza|blvd|sq|ln|ct|art|cf|etc|approx|incl|bzw|str|num|pag|p|pp|bd|abs|ing|c|z|b|d|h|e|g|i"
_SENTENCE = re.compile(
    rf"(?<=[.!?{chr(0x061F)}])(?<!\b[A-Z]\.)(?:{''.join(rf'(?<!\b[{a[0]}{a[0].upper()}]{a[1:]}\.)' for a in _ABBREVIATIONS.split('|'))})[\"')\]]*\s+(?=[^a-z\s])|(?<=[{_ENDS[3:6]}])\s*"
)
_LETTERS = re.compile(r"[^\W\d_]")
_WIDE_CHAR = re.compile(_WIDE)
_FIELD = re.compile(r"(?m)^[^\n.!?]{1,28}:\s")


def sentences_of(text: str) -> list[str]:
    """The whole sentences of a text: words broken over lines are mended, lines joined inside paragraphs; what has no terminator, or
    too few words to be a sentence, is left out."""
    out: list[str] = []
    text = _without_heads(text)
    for part in _PARAGRAPH.split(text.replace("\r\n", "\n")):
        part = _WIDE_GAP.sub("", _BREAK.sub("", part))
        for s in _SENTENCE.split(" ".join(part.split())):
            s = s.strip()
            core = s.rstrip("\"')]" + chr(0xBB) + chr(0x201D))
            if not core or core[-1] not in _ENDS:
                continue
            letters, wide = len(_LETTERS.findall(s)), len(_WIDE_CHAR.findall(s))
            if wide >= LEAST_WIDE or (letters >= LEAST_LETTERS and len(s.split()) >= LEAST_WORDS):
                out.append(s)
    return out


def fragments_of(text: str) -> list[str]:
    """The paragraphs of a text without whole sentences that hold a letter, words and lines joined as in sentences_of."""
    parts = [" ".join(_WIDE_GAP.sub("", _BREAK.sub("", p)).split()) for p in _PARAGRAPH.split(text.replace("\r\n", "\n"))]
    return [p for p in parts if _LETTERS.search(p)]


_COUNT = re.compile(r"[\W\d]*(?:[^\W\d_]{1,8}\.? )?[\W\d]+")
#: A title, a full stop, then a word and a number: how the heads of volumes are printed. No sentence goes on after it.
_VOLUME = re.compile(r"[^.!?]{3,60}\.\s+[^\W\d_]{1,12}\.?\s+(?:\d+|[ivxlc]+)\b[^.!?]{0,12}", re.I)
HEAD_WORDS = 12
_PAGE_LINE = re.compile(r"[\W\d]*(?:[^\W\d_]{1,10}\.?\s*)?(?:\d+|[ivxlc]+)(?:\s*(?:/|[^\W\d_]{1,6})\s*\d+)?\W*", re.I)


def _is_head(lines: list[str], i: int) -> bool:
    """Whether line i is a running head by its layout: a short line of its own after a finished one, which either ends like a sentence
    or names a volume and isn't gone on with in the next line."""
    x = lines[i].strip()
    if not x or _WIDE_CHAR.search(x):
        return False
    words = len(x.split())
    above = lines[i - 1].strip() if i else ""
    if above and above[-1] not in _ENDS and not _COUNT.fullmatch(above):
        return False
    if len(x) <= 40 and words <= 6 and x[-1] in _ENDS:
        return True
    below = lines[i + 1].strip() if i + 1 < len(lines) else ""
    goes_on = below[:1].islower() and _PAGE_LINE.fullmatch(below) is None
    return words <= HEAD_WORDS and _VOLUME.search(x) is not None and not goes_on


def _without_heads(text: str) -> str:
    """The text without running heads and the page numbers beside them, unless there is nothing else."""
    lines = text.split("\n")
    if len(lines) < 3:
        return text
    heads = {i for i in range(len(lines)) if _is_head(lines, i)}
    beside = {i for h in heads for i in (h - 1, h + 1) if 0 <= i < len(lines) and _PAGE_LINE.fullmatch(lines[i].strip())}
    kept = [x for i, x in enumerate(lines) if i not in heads and i not in beside]
    return "\n".join(kept) if any(len(x.split()) > 3 for x in kept) else text


_DIGIT = re.compile(r"\S*@\S*|\d+(?:[.,]\d+)*")
_NAME = re.compile(r"(?<=[\s(])[A-Z]\w+")
_WORD = re.compile(r"\w+")


def _bytes(s: str, words: frozenset[str] | None = None) -> bytes:
    """Lower case, numbers and unknown names alike: what the models see."""
    if words is not None:
        s = _NAME.sub(lambda m: m[0] if m[0].lower() in words else "0", s)
    return b"\n" * ORDER + _DIGIT.sub("0", s.lower()).encode("utf-8", "replace")


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """The packed n-gram of this length that ends at each position, positions before length - 1 excluded."""
    n = len(data) - length + 1
    key = np.zeros(n, np.uint64)
    for i in range(length):
        key = (key << np.uint64(8)) | data[i : i + n].astype(np.uint64)
    return key


class Models:
    """Frozen statistics: for each n-gram length the sorted n-grams, what their last byte costs each language after the bytes before
    it, and what an escape from them as a context costs."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        self.langs = sorted({lang for lang, _ in samples})
        m = len(self.langs)
        self.words = frozenset(w for _, t in samples for w in _WORD.findall(t.lower()))
        per = [[np.frombuffer(_bytes(t), np.uint8) for l2, t in samples if l2 == lang] for lang in self.langs]
        self.keys, self.cost, self.escape = [], [], []
        follow = []  # of each length: how often each n-gram occurs in each language
        every = []
        for length in range(1, ORDER + 2):
            counted = []
            for texts in per:
                # grams that end at a real byte, not in the padding
                grams = [_grams(t, length)[ORDER - length + 1 :] for t in texts]
                counted.append(np.unique(np.concatenate(grams) if grams else np.zeros(0, np.uint64), return_counts=True))
            every.append(counted)
        for length, counted in enumerate(every, 1):
            # also what only occurs as a context, at the beginning of a text
            longer = [k >> np.uint64(8) for k, _ in every[length]] if length <= ORDER else []
            keys = np.unique(np.concatenate([*(k for k, _ in counted), *longer])) if m else np.zeros(0, np.uint64)
            counts = np.zeros((len(keys), m))
            for j, (k, c) in enumerate(counted):
                counts[np.searchsorted(keys, k), j] = c
            self.keys.append(keys)
            follow.append(counts)
        for length in range(1, ORDER + 2):
            keys, counts = self.keys[length - 1], follow[length - 1]
            context = keys >> np.uint64(8)
            if length == 1:
                at, size = np.zeros(len(keys), int), 1
                lower = np.full((len(keys), m), 8.0)
            else:
                size, at = 0, np.zeros(0, int)
                contexts, at = np.unique(context, return_inverse=True)
                size = len(contexts)
                mask = np.uint64((1 << (8 * (length - 1))) - 1)
                below = np.searchsorted(self.keys[length - 2], keys & mask)
                lower = self.cost[length - 2][below]
            total, kinds = np.zeros((size, m)), np.zeros((size, m))
            np.add.at(total, at, counts)
            np.add.at(kinds, at, counts > 0)
            n, t = total[at], kinds[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.log2((n + t) / counts)
                esc = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            self.cost.append(np.where(counts > 0, seen, np.where(n > 0, esc[at] + lower, lower)))
            if length == 1:
                self.root_escape = esc[0] if len(esc) else np.zeros(m)
            else:
                full = np.zeros((len(self.keys[length - 2]) + 1, m), np.float32)
                full[np.searchsorted(self.keys[length - 2], contexts)] = esc
                self.escape.append(full)
        self.cost = [c.astype(np.float32) for c in self.cost]

    def arrays(self) -> dict:
        """All of it as plain arrays, which a worker without this package can unpickle."""
        return dict(vars(self))

    @classmethod
    def of(cls, arrays: dict) -> Models:
        models = cls.__new__(cls)
        vars(models).update(arrays)
        return models

    def code_lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text under each language, and the bytes of each text."""
        m = len(self.langs)
        parts = [_bytes(t, self.words) for t in texts]
        sizes = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8)
        n = len(data)
        bits = np.zeros((n, m), np.float32)
        index, found = [], []
        for length in range(1, ORDER + 2):
            key = np.zeros(n, np.uint64)
            key[length - 1 :] = _grams(data, length)
            keys = self.keys[length - 1]
            # each distinct n-gram of the batch is looked up once
            distinct, back = np.unique(key, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
            hit = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
            index.append(np.where(hit, at, len(keys))[back])
            found.append(hit[back])
        open_ = np.ones(n, bool)
        for length in range(ORDER + 1, 0, -1):
            here = open_ & found[length - 1]
            bits[here] += self.cost[length - 1][index[length - 1][here]]
            open_ &= ~here
            rest = np.flatnonzero(open_)
            if length > 1:
                before = index[length - 2][np.maximum(rest - 1, 0)]  # the context is the shorter n-gram one byte earlier
                bits[rest] += self.escape[length - 2][before]
            else:
                bits[rest] += self.root_escape.astype(np.float32) + 8.0
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pad = (np.arange(n) - np.repeat(starts, sizes)) < ORDER
        bits[pad] = 0
        return np.add.reduceat(bits, starts, axis=0), sizes - ORDER


def label(models: Models, texts: list[str | None], fragments: bool = False) -> list[list[tuple[str, str, float, float]]]:
    """Of each text its sentences, or its fragments, with language, confidence and bits."""
    split = [(fragments_of(t) if fragments else sentences_of(t)) if t else [] for t in texts]
    flat = [s for parts in split for s in parts]
    if not flat:
        return [[] for _ in texts]
    if not models.langs:
        return [[(s, "und", 0.0, 0.0) for s in parts] for parts in split]
    bits, sizes = models.code_lengths(flat)
    out, at = [], 0
    for parts in split:
        b = bits[at : at + len(parts)].astype(float)
        size = sizes[at : at + len(parts)]
        at += len(parts)
        if not parts:
            out.append([])
            continue
        best = b.argmin(axis=1)
        weight = np.bincount(best, weights=size, minlength=len(models.langs))
        main = int(b.sum(axis=0).argmin() if fragments else weight.argmax())  # fragments are too short to vote one by one
        least = b.min(axis=1)
        def other(cost: np.ndarray) -> np.ndarray:
            gain = b[:, main] - cost
            return (gain >= SURE_BITS) | (gain >= SWITCH_BITS) & (cost < SWITCH_SHARE * b[:, main])

        # the languages that some sentence is surely in; each sentence then takes the cheapest of them
        sure = np.unique(np.concatenate([[main], best[other(least)]]))
        near = sure[b[:, sure].argmin(axis=1)]
        pick = np.where(other(b[np.arange(len(parts)), near]), near, main)
        odds = np.exp2(np.minimum(b[np.arange(len(parts)), pick][:, None] - b, 60)).sum(axis=1)
        cost = b[np.arange(len(parts)), pick]
        out.append(
            [(s, models.langs[p] if c <= UNKNOWN_BITS * max(k, 1) else "und", float(1 / o), float(c)) for s, p, o, c, k in zip(parts, pick, odds, cost, size)]
        )
    return out


def refit(samples: list[tuple[str, str]], models: Models, labelled: list[tuple[str, str]]) -> Models:
    """Models of the samples and of those labelled texts whose label the first models agree with in every sentence."""
    more: dict[str, set[str]] = {lang: set() for lang in models.langs}
    for (lang, _), found in zip(labelled, label(models, [t for _, t in labelled])):
        if lang in more and found and all(x[1] == lang for x in found):
            more[lang].update(x[0] for x in found)
    kept = [(lang, s) for lang, texts in more.items() for s in sorted(texts, key=lambda t: zlib.crc32(t.encode()))[:MORE_SENTENCES]]
    return Models(sorted(samples + kept))


def fit(samples: DataFrame, blocks: DataFrame | None = None, codes: DataFrame | None = None) -> Models:
    """Models of the labelled sentences (lang, text); with blocks, also of a bounded sample of these, of which only texts count whose
    label, named by codes, agrees with what the samples say. The sample is that of the smallest hashes, the same on every run."""
    rows = samples.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").limit(MAX_SAMPLES + 1).collect()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} labelled sentences")
    pairs = sorted((r[0], r[1]) for r in rows)
    models = Models(pairs)
    if blocks is None or codes is None or not pairs:
        return models
    names = _code_maps(codes)[0]
    some = blocks.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.left("text", F.lit(SAMPLE_CHARS)).alias("text"), F.xxhash64("ocr_id").alias("h"))
    taken = some.orderBy("h").limit(SAMPLE_BLOCKS).collect()
    return refit(pairs, models, [(names.get(r[0].strip().lower(), ""), r[1]) for r in taken])


#: Texts that are scored at once; bounds the memory of a Python worker.
CHUNK = 256


def label_every(models: Models, texts: list[str | None]) -> list[list[tuple[str, str, float, float, bool]]]:
    """The same, and whether it is a whole sentence, with at least one segment of every text."""
    out = [[(*x, True) for x in found] for found in label(models, texts)]
    rest = [i for i, found in enumerate(out) if not found]
    for i, found in zip(rest, label(models, [texts[i] for i in rest], fragments=True)):
        out[i] = [(*x, False) for x in found] or [(texts[i], "und", 0.0, 0.0, False)]
    return out


def segments(df: DataFrame, models: Models, every: bool = False) -> DataFrame:
    """ocr_id, segment (1, 2, ...), text, lang, confidence, bits: one row per whole sentence; with every, also whole and the segments of
    texts without one."""
    shared = df.sparkSession.sparkContext.broadcast(models.arrays())  # some MB, bounded by MAX_SAMPLES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Models.of(shared.value)
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK):
                part = pdf.iloc[i : i + CHUNK]
                texts = part["text"].tolist()
                labels = label_every(known, texts) if every else label(known, texts)
                rows = [(ocr_id, k, *x) for ocr_id, found in zip(part["ocr_id"], labels) for k, x in enumerate(found, 1)]
                yield pd.DataFrame(rows, columns=columns)

    columns = ["ocr_id", "segment", "text", "lang", "confidence", "bits", *(["whole"] if every else [])]
    schema = "ocr_id long, segment int, text string, lang string, confidence double, bits double" + (", whole boolean" if every else "")
    return df.select("ocr_id", "text").mapInPandas(run, schema)


def named_language(lang: Column) -> Column:
    """A label without outer blanks and case."""
    return F.lower(F.trim(F.coalesce(lang, F.lit(""))))


#: Languages of the table of codes, which is read by the driver and becomes part of the plan; a larger one is refused.
MAX_LANGUAGES = 1_000


def _code_maps(codes: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """(label in lower case -> language, language -> script in lower case) of the fixed table of codes."""
    rows = codes.select("lang", "script", "aliases").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: r[0] or ""):
        for a in (r[0], *(r[2] or [])):
            if r[0] and a:
                names.setdefault(a.strip(" ").lower(), r[0])
    return names, {r[0]: r[1].lower() for r in rows if r[0] and r[1]}


def _literal_map(pairs: dict[str, str]) -> Column:
    if not pairs:
        return F.lit(None).cast("map<string,string>")
    return F.create_map(*(F.lit(x) for kv in sorted(pairs.items()) for x in kv))


def _summary(found: list[tuple]) -> list[tuple]:
    """(lang, sentences, confidence) of each language of a block's segments; sentences counts the whole ones."""
    by: dict[str, list] = {}
    for x in found:
        n = by.setdefault(x[1], [0, 0, 0.0])
        n[0] += x[4]
        n[1] += 1
        n[2] += x[2]
    return [(lang, whole, total / n) for lang, (whole, n, total) in sorted(by.items())]


def blocks(df: DataFrame, models: Models, codes: DataFrame, every: bool = False) -> DataFrame:
    """ocr_id, lang, sentences, confidence, script: one row for each language of a block's sentences; and whether the block's labels
    need to be mended. The texts pass through Python once and come back as one row a block, so nothing is shuffled. With every, blocks
    without whole sentences come out too, with no sentences and nothing to mend, as only whole sentences tell that a label is wrong."""
    names, scripts = _code_maps(codes)
    shared = df.sparkSession.sparkContext.broadcast(models.arrays())  # some MB, bounded by MAX_SAMPLES
    columns = ["ocr_id", "label", "script_label", "langs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Models.of(shared.value)
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK):
                part = pdf.iloc[i : i + CHUNK]
                texts = part["text"].tolist()
                labels = label_every(known, texts) if every else [[(*x, True) for x in found] for found in label(known, texts)]
                out = part[["ocr_id", "label", "script_label"]].assign(langs=[_summary(found) for found in labels])
                yield out[columns]

    rows = df.select("ocr_id", "text", named_language(F.col("lang")).alias("label"), named_language(F.col("script")).alias("script_label"))
    found = rows.mapInPandas(run, "ocr_id long, label string, script_label string, langs array<struct<lang: string, sentences: int, confidence: double>>")
    known_langs = F.filter(F.transform("langs", lambda x: x["lang"]), lambda x: x != "und")
    label_lang = F.try_element_at(_literal_map(names), F.col("label"))
    script_of = _literal_map(scripts)
    of_langs = F.transform(known_langs, lambda x: F.try_element_at(script_of, x))
    wrong_lang = label_lang.isNull() | ~F.array_contains(known_langs, label_lang)
    wrong_script = ~F.coalesce(F.array_contains(of_langs, F.col("script_label")), F.lit(False))
    mend = wrong_lang | wrong_script | (F.size(known_langs) > 1)
    flat = found.select("ocr_id", mend.alias("mend"), F.explode("langs").alias("x"))
    return flat.select("ocr_id", "x.lang", "x.sentences", "x.confidence", F.try_element_at(script_of, F.col("x.lang")).alias("script"), ((F.col("x.sentences") > 0) & F.coalesce("mend", F.lit(True))).alias("mend"))
