"""Text functions as Column expressions. White space is that of Unicode (`str.isspace`), not Java's ASCII."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space class.
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0  -     　]"
#: The same for RE2, as the SQL oracles use it.
WS_SQL = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The character classes of the reference's checks.
TAIL_PUNCT = r"[。\.！!？\?…։؛、，,;:]+$"
CJK_CLASS = r"[一-鿿㐀-䶿　-〿＀-￯]"
NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:%|％)?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body uses it (lambda bodies don't share common parts)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def longest_run(words: Column) -> Column:
    """Length of the longest run of equal neighbours; 0 of an empty array. Over a sorted array: the count of the most frequent element."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when((acc["run"] > 0) & (acc["last"] == x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(words, start, step, lambda acc: acc["best"])


def strip(c: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def reading_chars(c: Column) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.regexp_replace(c, WS, "")).cast("bigint")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def lines(c: Column) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(c, "\n"), lambda x: strip(x) != "")


def collapse(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(strip(c), f"{WS}+", " "))


def normalize_repair(c: Column) -> Column:
    """The form in which repair compares texts: trimmed, tight hyphens, single spaces, no closing punctuation, lower case."""
    t = F.regexp_replace(strip(c), f"{WS}*-{WS}*", "-")
    t = F.regexp_replace(t, f"{WS}+", " ")
    return F.lower(strip(F.regexp_replace(t, TAIL_PUNCT, "")))


def word_count(c: Column) -> Column:
    """Tokens between white space."""
    return F.size(F.filter(F.split(c, f"{WS}+"), lambda x: x != "")).cast("bigint")


def letter_count(c: Column) -> Column:
    """Letters of any script."""
    return F.length(F.regexp_replace(c, r"\P{L}", "")).cast("bigint")


def number_count(c: Column) -> Column:
    """Numbers, with thousands groups, decimals and percent signs counted as one."""
    return F.regexp_count(c, F.lit(NUMBER)).cast("bigint")


def looks_cjk(c: Column) -> Column:
    """At least four CJK characters or full-width marks, and not fewer than ASCII letters."""
    cjk = F.length(F.regexp_replace(c, f"[^{CJK_CLASS[1:]}", ""))
    return (cjk >= 4) & (cjk >= F.length(F.regexp_replace(c, "[^A-Za-z]", "")))


def high_risk(text: Column, confidence: Column, targets: Sequence[str] = ()) -> Column:
    """Low confidence, several numbers, a term, or signs of stiff translation in the text without white space at its ends; a null text is empty."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.coalesce(confidence < 0.35, F.lit(False)) | (number_count(t) >= 2) | (glossary_hits(t, targets) >= 1) | mt_stiff(t)


def mt_stiff(c: Column) -> Column:
    """Signs of stiff machine translation: gaps between CJK characters, doubled blanks, blanks behind marks, long texts without marks."""
    gap = c.rlike(rf"[一-鿿]{WS}+[一-鿿]")
    double = c.rlike(rf"{WS}{{2,}}")
    mark = c.contains("， ") | c.contains("。 ") | c.contains("！ ") | c.contains("？ ")
    return gap | double | mark | ((F.length(c) >= 40) & ~c.rlike("[，。！？；：]"))


def glossary_hits(c: Column, targets: Sequence[str]) -> Column:
    """How many of the targets occur; a target listed twice counts twice, empty ones never."""
    return sum((c.contains(t).cast("bigint") for t in targets if t), F.lit(0).cast("bigint"))


def apply_glossary(c: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """Literal replacement term by term, in order: a later term sees what earlier ones have made. Empty terms are refused."""
    for source, target in terms:
        if not source:
            raise ValueError("an empty glossary term would match everywhere")
        c = F.replace(c, F.lit(source), F.lit(target))
    return c


def normalize_zh(c: Column) -> Column:
    """Chinese typography: single spaces, none around full-width marks, none before ASCII marks."""
    t = F.regexp_replace(strip(c), f"{WS}+", " ")
    t = F.regexp_replace(t, r" *([，。！？；：、]) *", "$1")
    return F.regexp_replace(t, r" +([,.!?;:])", "$1")


def sentence_pieces(c: Column) -> Column:
    """Pieces that end with a strong mark, trimmed; a run of marks makes a piece of each further mark."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^。！？!?；;…]*[。！？!?；;…]|[^。！？!?；;…]+$"), F.lit(0)), strip), lambda x: x != "")


def timecode(ms: Column) -> Column:
    """HH:MM:SS,mmm of milliseconds; negative ones are 0; hours may exceed two digits."""
    m = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    part = lambda x, n: F.when(F.length(x.cast("string")) >= n, x.cast("string")).otherwise(F.lpad(x.cast("string"), n, "0"))
    whole = lambda x, by: F.floor(x / by).cast("bigint")
    hours, rest = whole(m, 3600000), m % 3600000
    return F.concat(part(hours, 2), F.lit(":"), part(whole(rest, 60000), 2), F.lit(":"), part(whole(rest % 60000, 1000), 2), F.lit(","), part(rest % 1000, 3))


def seconds_to_ms(c: Column) -> Column:
    """Half-even rounding, as the exporters round."""
    return F.bround(c * 1000).cast("bigint")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings: a binary search, 30 comparisons of prefixes at most."""
    n = F.least(F.length(a), F.length(b))
    # 30 halvings cover every string length; each keeps the longest prefix known to be common
    steps = F.array(*(F.lit(1 << k) for k in range(29, -1, -1)))
    grow = lambda acc, w: F.when((acc + w <= n) & (F.substr(a, F.lit(1), acc + w) == F.substr(b, F.lit(1), acc + w)), acc + w).otherwise(acc)
    return F.aggregate(steps, F.lit(0), grow).cast("bigint")


def repair_similarity(a: Column, b: Column) -> Column:
    """0 if either is empty, 1 if equal, the share of the shorter one if contained, else the common prefix over the shorter length."""
    la, lb = F.length(a).cast("double"), F.length(b).cast("double")
    inside = a.contains(b) | b.contains(a)
    return F.when((la == 0) | (lb == 0), 0.0).when(a == b, 1.0).when(inside, F.least(la, lb) / F.greatest(la, lb)).otherwise(common_prefix(a, b) / F.least(la, lb))


def naturalize_zh(c: Column) -> Column:
    """Light clean-up of Chinese: single spaces, none between CJK characters or around full-width marks, no doubled marks."""
    t = F.regexp_replace(strip(c), f"{WS}+", " ")
    t = F.regexp_replace(t, r"(?<=[一-鿿]) (?=[一-鿿])", "")
    t = F.regexp_replace(t, r"([。！？])\1+", "$1")
    t = F.regexp_replace(t, r"[,，]{2,}", "，")
    return F.regexp_replace(t, r" *([，。！？；：]) *", "$1")
