"""Sentence units across languages and scripts (problem 2).

Rules are pairs of regular expressions, one for the text before a position and one for the text after it, with the
verdict break or no break. They stand in tables (RULES); a position is judged by a cascade of tables: dialogue lines,
protected stretches, what holds everywhere, the language, the script, and what is left. The first rule that matches decides
a position. A cascade is compiled, so that the ordered search runs within the regex engine and only at candidate
positions: behind end marks with their closing marks, at line breaks, and behind particles in scripts without marks. A
text of several scripts has a cascade for each candidate, chosen by the words of the sentence that would end there. The
language of a Latin text is that of its small words (LANGUAGES); a text without any has the table of all of them. The
table of protected stretches (ENCLOSED: quotations, brackets, titles) is evaluated by an index of the stretches of a
text, since a pair of expressions would read the whole text at each position.

The rules see a folded view of the text (no invisible characters, common widths and blanks, look-alike letters as one),
so that noise does not hide an abbreviation; spans are code points of the text as stored.

Defined results: null, empty and blank texts have no sentences; a text without any end mark is one; repeated
deliveries of a row count once; an unpaired quotation mark protects nothing; tables may be empty or have more columns.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .lookalike import _table as look_table
from .records import spread

# Abbreviations by what may follow them. `title`: a name; `number`: a number; `never`: nothing ends here;
# `middle`: the sentence goes on only if no capital follows.
ABBREVIATIONS = {
    "latin": {
        "title": "Mr Mrs Ms Mx Dr Prof Sgt Capt Lt Col Gen Maj Rev Fr Sr Sra Srta Dra Dña St Hon Gov Sen Rep Mme Mlle MM Hr Fr Frl Ing Dipl Mag Jr Messrs Pres Sig Mgr Me",
        "number": "no No nos Nos Nr nr núm Núm fig Fig figs Figs p P pp Pp vol Vol ch Ch sec Sec art Art cf pág Pág págs ca Ca env Env approx Approx aprox Aprox Abb Kap Bd Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Tel tel ext Ext al ed Ed Art Str Ziff Anm",
        "never": "e.g i.e vs viz z.B d.h u.a z.T i.d.R bzw Bzw c.-à-d p.ej p. p.ex v.a o.ä s.o s.u u.U vgl Vgl ggf Ggf inkl Inkl zzgl evtl Evtl sog éd ex ej",
        "middle": "etc usw a.m p.m A.M P.M U.S U.K Inc Ltd Co Corp kg km cm mm m min Min h Std Mio Mrd EE.UU Ud Uds",
    },
    "cyrillic": {"title": "г-н г-жа проф доц акад", "number": "рис Рис стр Стр см См гл Гл им ул д кв т", "never": "т.е т.к напр ок", "middle": "мин тыс млн млрд руб коп г гг в вв сек ч км кг др пр т.д т.п и.о"},
    "greek": {"title": "κ κα κκ Κ δρ Δρ καθ", "number": "σελ Σελ αρ Αρ εικ", "never": "π.χ δηλ βλ", "middle": "κ.λπ κλπ κ.ά εκατ χιλ δισ μ.μ π.μ"},
    "devanagari": {"title": "डॉ श्री प्रो पं श्रीमती कु", "number": "नं सं पृ", "never": "", "middle": ""},
    "thai": {"title": "ดร นาย", "number": "พ.ศ ค.ศ", "never": "น ก.ม กม", "middle": ""},
    "arabic": {"title": "د أ م", "number": "ص رقم", "never": "", "middle": ""},
}
# Abbreviations of single languages of the Latin script; `common` has those of all.
LATIN = {
    "common": {"title": "Dr Prof St Ing Mag", "number": "Tel tel ca Ca cf art Art vol Vol fig Fig pp", "never": "vs", "middle": "etc Inc Ltd Co Corp kg km cm mm m min Min h"},
    "english": {
        "title": "Mr Mrs Ms Mx Sgt Capt Lt Col Gen Maj Rev Fr Hon Gov Sen Rep Jr Messrs Pres", "number": "no No nos Nos figs Figs p P Pp ch Ch sec Sec approx Approx Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec ext Ext al ed Ed", "never": "e.g i.e viz",
        "middle": "a.m p.m A.M P.M U.S U.K",
    },
    "german": {"title": "Hr Fr Frl Dipl", "number": "Nr nr Abb Kap Bd Str Ziff Anm Jan Feb Apr Jun Jul Aug Sept Nov", "never": "z.B d.h u.a z.T i.d.R bzw Bzw v.a o.ä s.o s.u u.U vgl Vgl ggf Ggf inkl Inkl zzgl evtl Evtl sog", "middle": "usw Std Mio Mrd"},
    "french": {"title": "MM Mme Mlle Me Mgr", "number": "no nos p env Env ed", "never": "c.-à-d éd ex p.ex", "middle": ""},
    "spanish": {"title": "Sr Sra Srta Dra Dña", "number": "pág Pág págs núm Núm aprox Aprox p", "never": "p.ej ej p.", "middle": "EE.UU Ud Uds"},
}
# Small words that tell the languages of the Latin script apart.
LANGUAGES = {
    "english": "the and was were that this with you they have from what not are his her its who said there which when would will of to he she then had been but is it in an on for as at by we our one people left",
    "german": "der das und nicht ist ein eine mit auf für den dem wir sie auch sich war im zu von wer noch es in an aus bei nach wird haben kann uns ich die des man so was hat als ob am er oder",
    "french": "le les des une est et dans pas pour que qui vous nous il elle du au avec sur ne je la de un en se par plus sont mais ce cette ils on été où était a l",
    "spanish": "el los las una y no es en que por con del al se su para como pero está lo la de un a más fue ya este esta son qué dónde ella después",
}
#: So many small words of a language tell it.
_TELLING = 2
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
END = "[.!?…‽。！？｡؟۔।॥]"
GREEK_END = "[.!?…;]"
CLOSE = r"[\"'”’»›“」』）)\]】》〉]"
OPEN = r"[\"'“‘«‹„»「『（(\[【《〈¿¡♪]"
#: Protected stretches: quotations, titles and remarks, by their marks.
ENCLOSED = regex.compile(r"“[^“”„]*”|„[^“”„]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|《[^《》]*》|（[^（）]*）|\([^()]*\)|\[[^\[\]]*\]|【[^【】]*】|(?<![\p{L}\p{N}])\"[^\"]*\"(?![\p{L}\p{N}])")


def _alternatives(words: str) -> str:
    return "|".join(sorted((regex.escape(w).replace(r"\.", r"\.\s?") for w in words.split()), key=len, reverse=True))


def _abbreviation_rules(a: dict[str, str]) -> list[tuple[bool, str, str]]:
    start = r"(?<![\p{L}\p{M}\p{N}])"
    rules = []
    for whole in (w for kind in a.values() for w in kind.split() if "." in w):  # inside an abbreviation of several parts
        parts = whole.split(".")
        rules += [(False, start + r"\.\s?".join(map(regex.escape, parts[:i])) + r"\.", r"\s?" + r"\.\s?".join(map(regex.escape, parts[i:])) + r"\.") for i in range(1, len(parts))]
    if a["title"]:
        rules.append((False, rf"{start}(?:{_alternatives(a['title'])})\.", r"\s*\S"))
    if a["number"]:
        rules.append((False, rf"{start}(?:{_alternatives(a['number'])})\.", r"\s*[\p{N}№#]"))
    if a["never"]:
        rules.append((False, rf"{start}(?:{_alternatives(a['never'])})\.", r"\s*\S"))
    if a["middle"]:
        rules.append((False, rf"{start}(?:{_alternatives(a['middle'])})\.", rf"\s*(?:{OPEN}*[\p{{Ll}}\p{{N}}]|[,;:%–—-])"))
    return rules


CLOSES = rf"(?:[\xa0 ]?{CLOSE})"
_HALT = rf"(?:{END}){CLOSES}*"
#: A line that opens with a dialogue dash starts a sentence, but for the first.
DIALOGUE = [(True, r"\S\s*\n[^\S\n]*", r"[-‐‑–—]\s*\S")]
#: Rules of all scripts that come first, and those that come last.
FIRST = [
    (True, r"\n[^\S\n]*\n\s*", r"\S"),  # an empty line
    (False, r"\.", r"[\p{L}\p{N}_@/.-]"),  # inside numbers, addresses, versions
    (False, rf"{END}", rf"{END}"),
    (False, r"", r"\s*$"),
]
CASED = [
    (False, r"(?:^|[^\p{L}\p{N}.])\p{Lu}\.", r"\s*[\p{Lu}\p{Ll}]"),  # initials
    (False, r"(?:\p{Lu}\.){2,}", r"\s*[\p{Ll}\p{N},;:]"),
    (False, r"(?:\.{2,}|…)" + CLOSES + "*", rf"\s*{OPEN}*\s*[^\p{{Lu}}\p{{Lt}}\s\"'“‘«‹„»「『（(\[【《〈¿¡♪]"),
    (False, _HALT, rf"\s*{OPEN}*\p{{Ll}}"),
    (False, _HALT, r"\s*[,;:%)\]»”’…]"),
    (False, rf"{END}{CLOSES}+", r"\s*[—–-]\s"),  # speech, then who speaks
    (True, _HALT, r"\s*\S"),
]
CASELESS = [
    (False, r"(?:\.{2,}|…)" + CLOSES + "*", r"\s*\S"),
    (False, rf"[!?！？؟]{CLOSES}+", r"\s*\S"),  # a question or call is quoted inside the sentence
    (False, rf"{END}{CLOSES}+", r"\s*(?:と|って|という|하고|라고|고\s|이라고)"),
    (False, _HALT, r"\s*[,;:،，、；：%)\]»”’」』》…]"),
    (True, _HALT, r"\s*\S"),
]
_ORDINALS = [(False, rf"(?<!\p{{N}})\p{{N}}{{1,2}}\.", rf"\s*(?:{MONTHS})\b"), (False, r"\b(?i:der|die|das|dem|den|des|am|im|zum|zur|vom) \p{N}{1,3}\.", r"\s\p{Lu}")]
#: "no." is the word where somebody says it.
_SAYS_NO = [(True, r"\b(?:say|says|said|answer|answers|answered|replied|told (?:me|us|him|her|them)|meant|means|is|was|a|oh|plain|clear) [Nn]o\.", r"\s+\S")]
RULES = {
    "dialogue": DIALOGUE,
    "first": FIRST,
    "english": [*_SAYS_NO, *_abbreviation_rules(LATIN["english"])],
    "german": [*_ORDINALS, *_abbreviation_rules(LATIN["german"])],
    "french": _abbreviation_rules(LATIN["french"]),
    "spanish": _abbreviation_rules(LATIN["spanish"]),
    "common": _abbreviation_rules(LATIN["common"]),
    "latin": [*_ORDINALS, *_abbreviation_rules(ABBREVIATIONS["latin"])],
    "cyrillic": _abbreviation_rules(ABBREVIATIONS["cyrillic"]),
    "greek": [*_abbreviation_rules(ABBREVIATIONS["greek"]), (True, r"[;;]" + CLOSES + "*", r"\s*\S")],
    "devanagari": [*_abbreviation_rules(ABBREVIATIONS["devanagari"]), *CASELESS],
    "arabic": [*_abbreviation_rules(ABBREVIATIONS["arabic"]), *CASELESS],
    "thai": [*_abbreviation_rules(ABBREVIATIONS["thai"]), (True, r"(?:ครับผม|ครับ|ค่ะ|คะ|จ้ะ|จ้า)", r"\s+\S"), (False, r"\.", r"\s*\S"), *CASELESS],
    "caseless": CASELESS,
    "cased": CASED,
}
#: Which tables judge a position in a language or script, in their order.
_ALL = ("dialogue", "enclosed", "first")
CASCADES = {
    **{name: (*_ALL, name, "common", "cased") for name in LANGUAGES},
    "latin": (*_ALL, "latin", "cased"),
    "cyrillic": (*_ALL, "cyrillic", "latin", "cased"),
    "greek": (*_ALL, "greek", "latin", "cased"),
    "devanagari": (*_ALL, "devanagari"),
    "arabic": (*_ALL, "arabic"),
    "thai": (*_ALL, "thai"),
    "caseless": (*_ALL, "caseless"),
}
_SCRIPTS = [("thai", regex.compile(r"\p{Thai}")), ("devanagari", regex.compile(r"\p{Devanagari}")), ("arabic", regex.compile(r"\p{Arabic}")), ("caseless", regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")), ("greek", regex.compile(r"\p{Greek}")), ("cyrillic", regex.compile(r"\p{Cyrillic}"))]
_LATIN = regex.compile(r"\p{Latin}")


class _Fold(dict):
    """One code point for one: what the rules see. Deleted ones become U+2060, which is taken out with its position."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = unicodedata.normalize("NFC", look_table[code]) if c != "\r" else "\n"
        if out == "":
            out = "⁠"
        elif len(out) != 1:
            plain = unicodedata.normalize("NFC", out)
            out = plain if len(plain) == 1 else c
        if c == "…" or c in "！？。":
            out = c
        if c.isspace() and c not in "\n\r":
            out = " "
        if c in "\v\f\x85\u2028\u2029":
            out = "\n"
        self[code] = out
        return out


_fold = _Fold()


def _folded_pattern(pattern: str) -> str:
    """The letters of a rule as the folded view has them."""
    return "".join(c if c.isascii() or not c.isalpha() else _fold[ord(c)] for c in pattern)


def _compiled(tables: tuple[str, ...]) -> regex.Pattern:
    """All rules of tables in one expression; the alternatives are tried in order, so the first match decides. A group tells a break."""
    parts = []
    for table in tables:
        for breaks, before, after in RULES[table]:
            sides = [f"(?<={before})" if before else "", f"(?={after})" if after else ""]
            look = "".join(reversed(sides) if table == "dialogue" else sides)  # dashes are rarer than line breaks
            parts.append(f"(?:{look}{'()' if breaks else ''})")
    return regex.compile(_folded_pattern("|".join(parts)))


@lru_cache(maxsize=None)
def _cascade(name: str) -> tuple[regex.Pattern, regex.Pattern]:
    """The tables of a cascade before and behind that of protected stretches."""
    tables = CASCADES[name]
    at = tables.index("enclosed")
    return _compiled(tables[:at]), _compiled(tables[at + 1 :])


def _breaks(view: str, at: int, name: str, enclosed: list[tuple[int, int]]) -> bool:
    """The verdict of a cascade; protected stretches don't overlap and are sorted: only the last that opens before the position can hold it."""
    before, behind = _cascade(name)
    verdict = before.match(view, at)
    if verdict is None:
        k = bisect_left(enclosed, (at, -1)) - 1
        if k >= 0 and enclosed[k][0] < at < enclosed[k][1]:
            return False
        verdict = behind.match(view, at)
    return verdict is not None and verdict.lastindex is not None


_SMALL = {word: name for name, words in LANGUAGES.items() for word in words.split() if sum(word in w.split() for w in LANGUAGES.values()) == 1}


def language_of(text: str) -> str:
    """The cascade of a Latin text: the language of its small words if they are of one; all languages where they are too few or of several, and where no dot stands within the text."""
    if text.find(".", 0, len(text.rstrip()) - 1) < 0:
        return "latin"
    found = [name for w in text.lower().split() if (name := _SMALL.get(w)) is not None]
    return found[0] if len(found) >= _TELLING and found.count(found[0]) == len(found) else "latin"


#: Candidate positions: behind runs of end marks (and particles, where there are no marks), and at line breaks that
#: open a dialogue line or an empty one.
_MARKS = {"greek": re.compile(f"{GREEK_END}+"), "thai": re.compile(rf"(?:ครับผม|ครับ|ค่ะ|คะ|จ้ะ|จ้า)(?=\s)|{END}+")}
_MARK = re.compile(f"{END}+")
#: Candidates of a text of several scripts: those of all scripts.
_ANY_MARK = re.compile(rf"(?P<particle>ครับผม|ครับ|ค่ะ|คะ|จ้ะ|จ้า)(?=\s)|[;{END[1:-1]}]+")
_BREAK = re.compile(r"\n[^\S\n]*(?:(?P<dash>[-‐‑–—])\s*\S|\n\s*)")


#: Marks that only close, and marks that open elsewhere.
SURE, EITHER = "”’›」』）)]】》〉", "\"'“»«"
_SIMPLE = regex.compile(r"^[^\n\r\v\f\x85\u2028\u2029.!?…‽。！？｡؟۔।॥;\u037e\p{Thai}]*$")


_CONTROL = regex.compile(r"[\t\v\f\r]")
_OPENING = regex.compile(r"[“„«「『《（(\[【\"]")


def _enclosed(view: str) -> list[tuple[int, int]]:
    return [x.span() for x in ENCLOSED.finditer(view)] if _OPENING.search(view) is not None else []


def script_of(text: str) -> str:
    """The cascade of a text: its most frequent script; Latin if it has none."""
    if text.isascii():
        return "latin"
    best, most = "latin", -1
    for name, pattern in _SCRIPTS:
        if pattern.search(text) is None:
            continue
        most = len(_LATIN.findall(text)) if most < 0 else most
        n = len(pattern.findall(text))
        if n > (most if name in ("greek", "cyrillic") else most // 2):
            best, most = name, n
    return best


#: Words of a text of several scripts: runs of letters; runs of scripts written without blanks are taken out of them.
_WORD = regex.compile(r"(?P<thai>\p{Thai}+)|(?P<caseless>[\p{Han}\p{Hiragana}\p{Katakana}ー々〆]+)|(?:(?![\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}ー々〆])[\p{L}\p{M}])+")
#: Letters that count as one word in scripts written without blanks, and the most words that one run counts as.
_RUN, _MOST = {"thai": 5, "caseless": 2}, 8


_LETTERS = {**dict(_SCRIPTS), "latin": _LATIN}


class _Words:
    """The words of a text by script: counts in any stretch of it by prefix sums."""

    def __init__(self, text: str) -> None:
        self.starts: list[int] = []
        self.sums: dict[str, list[int]] = {name: [0] for name in _LETTERS}
        for m in _WORD.finditer(text):
            n, script = m.end() - m.start(), m.lastgroup
            if script is None:
                script = max(_LETTERS, key=lambda name: len(_LETTERS[name].findall(m.group())))  # Latin, the last, only without a tie
                n = int(script != "greek" or n > 1)  # a single Greek letter is a sign of formulas in any script
            else:
                n = min(-(-n // _RUN[script]), _MOST)
            self.starts.append(m.start())
            for name, sums in self.sums.items():
                sums.append(sums[-1] + (n if name == script else 0))

    def script(self, *stretches: tuple[int, int]) -> str | None:
        """The script of most words that begin in the stretches; Latin only if it has more than any other; None if there are no words."""
        parts = [(bisect_left(self.starts, a), bisect_left(self.starts, b)) for a, b in stretches]
        count = {name: n for name, sums in self.sums.items() if (n := sum(sums[j] - sums[i] for i, j in parts if i < j))}
        return max(count, key=lambda name: (count[name], name != "latin")) if count else None

    def has(self, script: str, a: int, b: int) -> bool:
        sums = self.sums[script]
        return sums[bisect_left(self.starts, b)] > sums[bisect_left(self.starts, a)]


def _view(text: str) -> tuple[str, list[int] | None]:
    """The folded text and the stored position of each of its code points (None: the same)."""
    if text.isascii() and _CONTROL.search(text) is None:
        return text, None
    view = text.translate(_fold)
    if "⁠" not in view:
        if text.isascii():
            return view, None
        if unicodedata.is_normalized("NFC", view):
            return view, None
    out, at, n = [], [], len(view)
    i = 0
    while i < n:
        c = view[i]
        if c == "⁠":
            i += 1
            continue
        j = i + 1
        # marks and invisible characters behind a letter belong to it
        while j < n and (view[j] == "⁠" or unicodedata.combining(view[j])):
            j += 1
        if j > i + 1:
            whole = unicodedata.normalize("NFC", view[i:j].replace("⁠", ""))
            out.append(whole)
            at.extend([i] * len(whole))
        else:
            out.append(c)
            at.append(i)
        i = j
    return "".join(out), at


def spans(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of a text."""
    if not text or text.isspace():
        return []
    if _SIMPLE.match(text) is not None:
        a, b = _trim(text, 0, len(text))
        return [(a, b)] if a < b else []
    # a stored script is judged on the stored letters: the folded view has Latin prototypes
    script = script_of(text)
    view, at = _view(text)
    cuts = _mixed_cuts(text, view, at, script) if _mixed(text) else _cuts(view, language_of(view) if script == "latin" else script)
    if at is not None:
        cuts = [at[c] if c < len(at) else len(text) for c in cuts]
    out, start = [], 0
    for cut in [*cuts, len(text)]:
        a, b = _trim(text, start, cut)
        if a < b:
            out.append((a, b))
        start = cut
    return out


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def _ends(enclosed: list[tuple[int, int]], at: int) -> bool:
    """Whether a protected stretch ends at a position."""
    k = bisect_left(enclosed, (at, -1)) - 1
    return k >= 0 and enclosed[k][1] == at


def _close(view: str, end: int, enclosed: list[tuple[int, int]]) -> int:
    """The position behind the closing marks that follow an end mark. Marks that can also open close here if they end a
    protected stretch, or stand right at the end mark with no letter behind them."""
    while end < len(view):
        q = end + 1 if view[end] in " \xa0" and end + 1 < len(view) else end
        c = view[q]
        if c in SURE and (q == end or c == "»"):
            end = q + 1
        elif c in EITHER and (_ends(enclosed, q + 1) or (q == end and not view[q + 1 : q + 2].isalnum())):
            end = q + 1
        else:
            break
    return end


def _cuts(view: str, script: str) -> list[int]:
    enclosed: list[tuple[int, int]] | None = None
    cuts = []
    marks = [(m.end(), True) for m in _MARKS.get(script, _MARK).finditer(view)]
    if "\n" in view:
        marks += [(m.end(), True) if m.group("dash") is None else (m.start("dash"), False) for m in _BREAK.finditer(view)]
    for end, closes in marks:
        if end >= len(view):
            continue
        if enclosed is None:
            enclosed = _enclosed(view)
        end = _close(view, end, enclosed) if closes else end
        if end < len(view) and _breaks(view, end, script, enclosed):
            cuts.append(end)
    return sorted(set(cuts)) if "\n" in view else cuts


def _mixed(text: str) -> bool:
    """Whether a text has letters of several scripts."""
    if text.isascii():
        return False
    return (_LATIN.search(text) is not None) + sum(pattern.search(text) is not None for _, pattern in _SCRIPTS) > 1


def _mixed_cuts(text: str, view: str, at: list[int] | None, whole: str) -> list[int]:
    """The cuts of a text of several scripts: candidates of all of them, each judged by the cascade of its sentence.

    The script is that of most words between the last cut and the candidate. Behind a quotation, words around it count
    if there are any, as it is their sentence that ends or goes on. A particle on a Thai word is Thai, a semicolon is a
    question mark in a sentence of Greek, and a stretch without words is judged as the whole text.
    """
    words, enclosed, language = _Words(text), _enclosed(view), language_of(view)
    stored = lambda i: i if at is None else at[i] if i < len(at) else len(text)
    marks: list[tuple[int, int, str]] = [(m.start(), m.end(), "particle" if m.group("particle") else "mark") for m in _ANY_MARK.finditer(view)]
    cuts: list[int] = []
    if "\n" in view:
        for m in _BREAK.finditer(view):
            at_dash = m.group("dash") is not None
            marks.append((m.start("dash"), m.start("dash"), "dash") if at_dash else (m.end(), m.end(), "line"))
        marks.sort()
    last = 0
    for k, (a, b, kind) in enumerate(marks):
        if b >= len(view):
            continue
        if kind == "dash":
            if _breaks(view, b, whole, enclosed):
                cuts.append(b)
                last = b
            continue
        before = words.script((stored(last), stored(a if kind != "particle" else b))) or whole
        ends = [b]
        if kind == "particle":
            if whole != "thai" and before != "thai" and not (a and "\u0e00" <= view[a - 1] <= "\u0e7f"):
                continue
            before = "thai"
        elif kind == "mark" and ";" in view[a:b]:
            if whole == "greek" and words.has("greek", stored(last), stored(a)):
                before = "greek"
            if before != "greek":
                ends = [m.end() for m in _MARK.finditer(view, a, b)]
        for end in ends:
            end = _close(view, end, enclosed)
            if end >= len(view):
                continue
            i, script = bisect_left(enclosed, (end, -1)) - 1, before
            if i >= 0 and enclosed[i][1] == end and ";" not in view[a:b]:
                follows = marks[k + 1][0] if k + 1 < len(marks) else len(view)
                script = words.script((stored(last), stored(max(last, enclosed[i][0]))), (stored(end), stored(max(end, follows)))) or before
            if _breaks(view, end, script if script != "latin" else language, enclosed):
                cuts.append(end)
                last = end
    return sorted(set(cuts))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str | None, list[tuple[int, int]]] = {}
    for batch in batches:
        if len(memo) > 200_000:
            memo.clear()
        rows, starts, ends = [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            own = memo.get(t)
            if own is None:
                own = memo[t] = spans(t)
            for a, b in own:
                rows.append(i)
                starts.append(a)
                ends.append(b)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("record_kind", "media_id", "record_idx")), pa.array(np.array(starts, "i4")), pa.array(np.array(ends, "i4"))], names=["record_kind", "media_id", "record_idx", "span_start", "span_end"])


SPANS = T.StructType([T.StructField("record_kind", T.StringType()), T.StructField("media_id", T.StringType()), T.StructField("record_idx", T.IntegerType()), T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType())])


def sentence_spans(records: DataFrame) -> DataFrame:
    """record_kind, media_id, record_idx, span_start, span_end of every sentence. The one shuffle takes out repeated deliveries; it moves spans, not texts."""
    return spread(records.select("record_kind", "media_id", "record_idx", "text")).mapInArrow(_split, SPANS).distinct()
