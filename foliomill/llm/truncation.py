"""Text cut off by field limits or in transfer.

A structural completeness check of each whole text: a stack automaton over its brackets, quotes and markup (reset at each
paragraph), broken byte sequences and escapes at the end, marks of omission inside a sentence, and a missing terminator. What a
missing terminator is worth is learnt from the data: per source from how its running last lines usually end, and
over the corpus from last lines that recur (signatures, end marks) and from the closing formulas that recur above them. Lengths at which the suspects of a source pile up are its field limits.

Defined cases. Null and blank texts are no cases. Texts whose last line is a list item, table row, reference, end mark,
sign, closed bracket or signature are complete. Rows of a null source form one source. Repeated rows of a doc_id give it once.
Only doc_id, text and source are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: A source whose running last lines end in a terminator less often than this gives no evidence by a missing one.
LEAST_TERMINATED = 0.3
#: So many finished texts are assumed of a source of which little is known.
PRIOR = 5
#: A last line that so large a share of all texts has in common is a form, not a fragment.
RECURRENT_SHARE = 0.005
RECURRENT_LEAST = 3
#: A signature is a line of at most so many words below a closing formula: a customary one, or one that recurs like a last line.
SIGNATURE_WORDS, CLOSING_WORDS = 8, 6
#: Up to so many sources, what is known of them is broadcast; beyond that it is joined by a shuffle, whose hot keys are split.
MAX_SOURCES = 100_000
#: A length counts as a field limit if so many of a source's suspects have it.
LIMIT_SHARE, LIMIT_LEAST = 0.08, 3

_points = lambda *ps: "".join(map(chr, ps))
# White space, line ends, sentence terminators of the scripts at hand, and what may close a sentence after them.
SPACES = _points(*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
LINE_ENDS = _points(0x0D, 0x0B, 0x0C, 0x85, 0x2028, 0x2029)
TERMINATORS = ".!?" + _points(0x3002, 0xFF0E, 0xFF01, 0xFF1F, 0x061F, 0x06D4, 0x0964, 0x203D)
CLOSERS = "\"')\\]}*_" + _points(0xBB, 0x201D, 0x2019, 0x203A, 0x300D, 0x300F, 0xFF09)
ELLIPSIS, BROKEN = chr(0x2026), chr(0xFFFD)
# Customary closing formulas of letters, words that no signature ends in, and words of notes that say that text was left out.
CLOSINGS = (
    r"(?:yours (?:faithfully|sincerely|truly)|(?:best |kind |with )*regards|sincerely|mit freundlichen grüßen|hochachtungsvoll|salutations distinguées|cordialement|atentamente|cordialmente|"
    r"distinti saluti|cordiali saluti|atenciosamente|com os melhores cumprimentos|hoogachtend|met vriendelijke groet|с уважением|з повагою|με εκτίμηση|مع التحية|此致|敬具)\W*"
)
FUNCTION_WORDS = (
    "a an the of to in on at by for from with and or but that which as is was be been has had not it its if so no than then without into over under near after before during "
    "der die das den dem des ein eine einer und oder mit von vom zu zum zur im in am an auf für nicht ist war wurde le la les l un une des du de et ou à au aux en sur pour par avec dans est que qui "
    "el los las una y o del al con por para se que es il lo gli uno e di da nel nella sul sulla che è os as um uma do das dos ao na no em het een van met op te dat"
).split()
OMITTED = (
    r"truncat|cut off|cut short|remainder|rest of|continue|\bmore\b|omitted|snip|abgeschnitten|gekürzt|fortsetzung|tronqu|\bsuite\b|coupé|cortad|truncad|continú|continua|troncat|afgebroken|vervolg|"
    r"обрез|продолж|обріз|продовж|截断|省略|続く|مقتطع|συνέχεια"
)
PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">", chr(0xAB): chr(0xBB), chr(0x201C): chr(0x201D), chr(0x300C): chr(0x300D), chr(0xFF08): chr(0xFF09)}


def left_open(text: Column) -> Column:
    """The stack automaton: what is still open at the end of the last paragraph. Straight double quotes open and close in turn, a
    closing sign that matches nothing is passed over, '<' counts only before a letter or '/'."""
    signs = "".join(PAIRS) + "".join(PAIRS.values())
    marked = F.regexp_replace(text, r"<(?![A-Za-z/!])|\n[ \t]*\n", chr(1))
    kept = F.regexp_replace(marked, "[^\"\\x01" + "".join("\\" + c for c in signs) + "]+", "")

    def step(stack: Column, c: Column) -> Column:
        top = F.right(stack, F.lit(1))
        less = F.substring(stack, F.lit(1), F.char_length(stack) - 1)
        out = F.when(c == chr(1), F.lit("")).when(c == '"', F.when(top == '"', less).otherwise(F.concat(stack, c)))
        for a, b in PAIRS.items():
            out = out.when(c == a, F.concat(stack, c)).when(c == b, F.when(top == a, less).otherwise(stack))
        return out.otherwise(stack)

    return F.when(kept == "", F.lit("")).otherwise(F.aggregate(F.split(kept, ""), F.lit(""), step))


def features(df: DataFrame) -> DataFrame:
    """One row per text that is not blank: what its end looks like."""
    flat = F.translate("text", LINE_ENDS, "\n" * len(LINE_ENDS))
    body = F.rtrim(flat, F.lit(SPACES))
    # the last two lines without marks of omission: dots, a word or two in brackets, a longer note in brackets that says so, broken characters
    note = rf"\p{{L}}[\p{{L}}. ]{{0,14}}|(?=[^\[\]()<>]*(?:{OMITTED}))[^\[\]()<>]*[^\[\]()<>{TERMINATORS}\s]"
    marks = F.regexp_replace("two", rf"(?iu)[\s{BROKEN}]*+(?:(?:\.\.+|{ELLIPSIS}|[\[(<]\s*(?:\.\.+|{ELLIPSIS}|{note})\s*[\])>])[\s{BROKEN}]*+)+\z|[\s{BROKEN}]++\z", "")
    df = df.select("doc_id", "source", F.col("text"), body.alias("body")).where(F.col("body") != "")
    df = df.withColumn("two", F.substring_index("body", "\n", -2)).withColumn("line", F.trim(F.substring_index("body", "\n", -1))).withColumn("tail", marks)
    prev = F.when(F.instr("two", "\n") > 0, F.trim(F.substring_index("two", "\n", 1))).otherwise("")
    ended = rf"[{TERMINATORS}][{CLOSERS}]*\z"
    line, tail = F.col("line"), F.col("tail")
    terminated = line.rlike(ended)
    listed = line.rlike(r"\A([-*" + _points(0x2022, 0xB7, 0x2013, 0x2023) + r"]|\p{Nd}{1,3}[.)]|\p{L}\))\s+\S") & (F.size(F.split(line, " ")) <= 6)
    row = line.rlike(r"\S\s*\|\s*\S|\t|\S\s*;\s*\S+\s*;")
    reference = line.rlike(r"\A\p{L}{1,12}[.:#]\s*(\p{L}+[.:]?\s*)?[\p{L}-]*\p{Nd}\S*\z")
    end_mark = line.rlike(r"\A[\p{P}\p{S}]{2,}.*[\p{P}\p{S}]{2,}\z|\A[\p{P}\p{S}\s]+\z")
    sign = line.rlike(r"[\p{So}\p{Sk}\x{FE0F}]\z")
    closed = line.rlike(rf"[)\]}}{chr(0xFF09)}]\z")
    closing = (F.col("prev") != "") & ~F.col("prev").rlike(ended) & (F.size(F.split("prev", " ")) <= CLOSING_WORDS)
    last_word = F.lower(F.regexp_extract(line, r"([\p{L}\p{M}]+)\P{L}*\z", 1))
    signing = closing & (F.size(F.split(line, " ")) <= SIGNATURE_WORDS) & ~line.rlike(r"\A\p{Ll}") & ~last_word.isin(*FUNCTION_WORDS)
    normal = lambda c: F.regexp_replace(F.lower(c), r"\p{Nd}+", "9")
    hashed = lambda c: F.struct(F.xxhash64(normal(c)).alias("a"), F.hash(normal(c)).alias("b"))
    return (
        df.withColumn("prev", prev)
        .select(
            "doc_id",
            "source",
            F.char_length("text").alias("chars"),
            F.octet_length("text").alias("bytes"),
            hashed(line).alias("last_line"),
            F.when(signing, hashed(F.col("prev"))).alias("above"),
            terminated.alias("terminated"),
            (listed | row | reference | end_mark | sign | closed).alias("formed"),
            (signing & F.col("prev").rlike(r"(?iu)\A" + CLOSINGS + r"\z")).alias("signature"),
            (tail != F.col("two")).alias("marked"),
            tail.rlike(ended).alias("terminated_before"),
            F.right("body", F.lit(1)).isin(BROKEN).alias("broken"),
            F.col("two").rlike(r"(\\(u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(#[0-9xA-Fa-f]{0,6}|[a-z]{2,8}))\z").alias("escape"),
            left_open(F.col("body")).alias("open"),
        )
    )


def _of_source(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """rows with what is known of their source, a column of one row a source."""
    other = known.select(F.col("source").alias("__source"), name)
    few = known.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    return rows.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def judge(df: DataFrame) -> DataFrame:
    """doc_id, source, cut, and the evidence: of every text that is not blank."""
    rows = materialize(features(df.select("doc_id", "text", "source")), "text-ends")
    total = rows.count()
    least = max(RECURRENT_LEAST, total * RECURRENT_SHARE)
    # lines that recur, as last ones or as closing formulas: at most 1/RECURRENT_SHARE hashes each
    recurs = lambda c: rows.where(~F.col("terminated") & F.col(c).isNotNull()).groupBy(F.col(c).alias("h")).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= least).select("h")
    rows = rows.join(F.broadcast(recurs("last_line").select(F.col("h").alias("l"), F.lit(True).alias("form"))), F.col("last_line") == F.col("l"), "left").drop("l")
    rows = rows.join(F.broadcast(recurs("above").select(F.col("h").alias("l"), F.lit(True).alias("closing"))), F.col("above") == F.col("l"), "left").drop("l")
    rows = rows.withColumn("signature", F.col("signature") | F.col("closing").isNotNull()).withColumn("form", F.col("form").isNotNull())
    running = ~F.col("formed") & ~F.col("signature") & ~F.col("marked")
    per_source = rows.groupBy("source").agg(
        ((F.count_if(running & F.col("terminated")) + PRIOR) / (F.count_if(running) + PRIOR)).alias("usual")
    )
    suspects = rows.where(~F.col("terminated") & ~F.col("formed") & ~F.col("form") & ~F.col("signature") | F.col("marked"))
    s = _of_source(_of_source(rows, per_source, "usual"), field_limits(suspects), "limits")
    at_limit = F.coalesce(F.array_contains("limits", F.col("chars")) | F.array_contains("limits", F.col("bytes")), F.lit(False))
    form = F.col("formed") | F.col("form") | (F.col("signature") & ~at_limit)
    unfinished = ~F.col("terminated") & ~form & ((F.col("usual") >= LEAST_TERMINATED) | at_limit)
    omitted = F.col("marked") & (F.col("broken") | ~F.col("terminated_before"))
    opened = (F.col("open") != "") & (~F.col("formed") | at_limit)
    cut = omitted | F.col("escape") | unfinished | opened
    return s.select("doc_id", "source", "chars", cut.alias("cut"), at_limit.alias("at_limit"), F.col("open"), "marked", "broken", "terminated")


def field_limits(suspects: DataFrame) -> DataFrame:
    """source, limits: the lengths, in characters or bytes, at which the suspects of a source pile up. At most 2/LIMIT_SHARE a source."""
    n = suspects.groupBy("source").agg(F.count(F.lit(1)).alias("all"))
    lengths = suspects.select("source", F.explode(F.array_distinct(F.array("chars", "bytes"))).alias("length")).groupBy("source", "length").agg(F.count(F.lit(1)).alias("c"))
    both = lengths.alias("a").join(n.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    piled = both.where((F.col("c") >= LIMIT_LEAST) & (F.col("c") >= F.col("all") * LIMIT_SHARE))
    return piled.groupBy(F.col("a.source").alias("source")).agg(F.sort_array(F.collect_set("length")).alias("limits"))


def found(df: DataFrame) -> DataFrame:
    """doc_id of each cut text."""
    return judge(df).where("cut").select("doc_id").distinct()


def rates(df: DataFrame) -> DataFrame:
    """Per source: texts, how many are cut, the rate, and how many of the cut ones stand at a field limit."""
    return judge(df).groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if("cut").alias("cut"),
        F.try_divide(F.count_if("cut"), F.count(F.lit(1))).alias("rate"),
        F.count_if(F.col("cut") & F.col("at_limit")).alias("at_limit"),
    )
