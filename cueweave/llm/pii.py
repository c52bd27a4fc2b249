"""Personal information inside free text (problem 8).

A linear-chain conditional random field labels tokens (begin, inside, outside of five types). Its features are word
shapes, affixes, words and kinds of words (titles, parts of streets, labels of phone numbers, ...) in a window of seven
tokens, the shapes of the digit groups, codes and addresses of mails a token lies in, the form of its line, and whether
names are on the crew list. Weights are trained by gradient ascent on the likelihood over the labelled table of
`pii_labels` (a fixed size, on the driver), stored as a table in the shared folder under the hash of the labels, the
crew list and the settings, and sent to the tasks, where whole batches of paragraphs are decoded by Viterbi in numpy: the
score of a token is a sum of rows of a table by token type, so that Python works once per type of token, not per token.

All spans are labelled stretches. What follows the model only trims blanks and marks at their edges and drops what by
definition is no datum of its type (an address without a house number, a phone number of three digits, a name with digits).

Defined results: null and empty texts have no spans and stay as they are; whole texts are decoded; overlapping spans
don't occur; people (the crew list) may be empty or have nulls; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.runtime import shared_folder
from . import pii_labels
from .records import spread

TYPES = ["email", "phone", "id_number", "street_address", "person_name"]
LABELS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
#: The crew list is a fixed table; more people than this are refused.
MAX_PEOPLE = 100_000

_IGNORED = "\u00ad\u200b-\u200f\u2060\ufeff"
_LATIN = rf"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u02af\u0300-\u052f\u1e00-\u1fff{_IGNORED}"
#: Runs of letters of one script, digits, single marks, each with the blank before it if there is one. Scripts written without blanks fall into characters; Thai into what stands before and behind names.
_THAI = "คุณ|นางสาว|นาย|นาง|ชื่อ|ครับผม|ครับ|ค่ะ|คะ"
_TOKEN = re.compile(rf"\n|\x00| ?(?:[{_LATIN}]+|[0-9]+|[\u3005\u3006\u3040-\u309f\u30f6\u30b1\u4e00-\u9fff\uac00-\ud7a3]|[\u30a0-\u30ff]+|[\u0900-\u097f]+|{_THAI}|[\u0e00-\u0e7f]+?(?={_THAI}|[^\u0e00-\u0e7f]|$)|[^\W\d_]+|[^\s\x00])|[^\S\n]+", re.S)
_WIDTHS = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0: 0xFFFD, 0x3000: 0x20, 0xA0: 0x20, 0x202F: 0x20, 0x2007: 0x20, 0x2005: 0x20, 0x2009: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0xFF0D: 0x2D, 0x212A: 0x4B}
_WIDE = re.compile("[\x00\u2005\u2007\u2009-\u2011\u202f\u3000\xa0\u212a\uff01-\uff5e]")
_DROP = re.compile(f"[{_IGNORED}]")
#: Digit groups with what joins them, code groups of capitals and digits, and addresses of mails.
_GROUPS = re.compile(r"[0-9][ 0-9()./-]{2,}[0-9]")
_CODES = re.compile(r"\b[A-Z0-9]+(?:[ .-][A-Z0-9]+)*\b(?<=[A-Z0-9 .-]{6})", re.A)
_DOT = r"\s?(?:\[dot\]|\(dot\)|\bdot\b)\s?"
_AT = r"\s?(?:\[at\]|\(at\)|\bat\b)\s?"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?: @ |[{_IGNORED}]*@[{_IGNORED}]*)[A-Za-z0-9{_IGNORED}-]+(?:\.[A-Za-z0-9{_IGNORED}-]+)*\.[A-Za-z]{{2,}}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)*(?:{_DOT}|\.)[A-Za-z]{{2,}}", re.I)
_PIVOT = re.compile(r"@|[\[( ]at[\]) ]", re.I)
_LOCAL = re.compile(rf"[A-Za-z0-9._%+-]+[ {_IGNORED}]*$")
_URL = re.compile(r"\w+://\S+")
_HEX = re.compile(r"[0-9a-f]{6,}")
_PATH = re.compile(r"(?:/[\w.-]+){2,}")
_TIMECODE = re.compile(r"\d\d:\d\d:\d\d[,.]\d{2,3} --> \d\d:\d\d:\d\d[,.]\d{2,3}")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")

# Kinds of words that stand in, before or behind personal data.
CUES = {
    "title": "mr mrs ms mx miss dr prof professor capt captain sgt lt col rev sir dame frau herr herrn mme mlle m monsieur madame sr sra srta señor señora don doña dott sig signora κ κα डॉ श्री श्रीमती คุณ นาย นาง นางสาว",
    "phone": "phone tel tél telephone telefon teléfono mobile mobil cell cellphone fax call ring dial reach text sms whatsapp hotline rückruf durchwahl llame móvil appelez joindre portable телефон тел звоните τηλ τηλέφωνο هاتف โทร फ़ोन",
    "id": "id passport ssn tax social security national identity licence license insurance dni nie nif ausweis personalausweis reisepass steuer passeport sécurité sociale pasaporte identidad паспорт инн снилс ταυτότητα हिसाब",
    "ext": "ext x extension poste int ext durchwahl",
    "street": "street st road rd avenue ave av lane ln drive court ct row close terrace way place square sq boulevard blvd bd crescent highway parkway alley str rue impasse chemin quai allée calle avda avenida plaza paseo camino via viale piazza corso rua travessa улица ул проспект переулок οδός laan straat plein",
    "unit": "flat apt apartment unit suite floor piso bajo izq dcha bis ter étage room wohnung stock stiege tür кв корп",
    "sign": "regards thanks cheers sincerely yours wishes grüße grüßen gruß cordialement saludos atentamente signed contact attn from to cc",
    "said": "said asked replied wrote says shouted answered told whispered named called met by with",
    "particle": "af al av bin binti bint da das de dei del della den der des di do dos du el ibn la las le los ten ter van vom von zu zum zur",
    "month": "january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août enero febrero marzo abril mayo junio julio agosto",
    "surname": "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 马 朱 胡 林 郭 何 高 罗 김 이 박 최 정 강 조 윤 장 임",
}
_KINDS: dict[str, list[str]] = {}
for _name, _words in CUES.items():
    for _word in _words.split():
        _KINDS.setdefault(_word, []).append(f"k={_name}")
#: Ends of words that name a street.
_STREET_ENDS = ("straße", "strasse", "str", "weg", "gasse", "allee", "platz", "ufer", "damm", "gatan", "vägen", "straat", "laan", "gracht")


def _view(text: str) -> str:
    """The text with common widths and blanks, one character for one."""
    return text if text.isascii() and "\x00" not in text else _WIDE.sub(lambda m: m.group().translate(_WIDTHS), text)


def _shape(word: str) -> str:
    s = re.sub(r"[a-zß-öø-ÿ]", "x", re.sub(r"[A-ZÀ-ÖØ-Þ]", "X", re.sub(r"\d", "9", word)))
    return re.sub(r"(x)\1+", r"\1+", re.sub(r"(X)\1+", r"\1+", s))[:12]


def _script(c: str) -> str:
    """A coarse script of a letter by its block."""
    code = ord(c)
    return "latin" if code < 0x370 or 0x1E00 <= code < 0x1F00 else "greek" if code < 0x400 or 0x1F00 <= code < 0x2000 else "cyrillic" if code < 0x530 else f"b{code >> 7}" if code < 0x3000 else "dense"


def type_features(word: str, given: set[str], family: set[str], seen: bool = True) -> tuple[list[str], list[str]]:
    """Features of a token by its characters alone: those that tokens up to three away look at, and those of the nearest.
    Without `seen`, as if the word had never been met."""
    low = word.lower()
    far, near = [f"s={_shape(word) if word.isascii() or _script(word[0]) == 'latin' else _script(word[0])}"], []
    if seen:
        far.append(f"w={low}")
    if word[:1].isalpha():  # marks within words of other scripts are no letters
        far += _KINDS.get(low, ())
        if len(low) > 5 and low.endswith(_STREET_ENDS):
            far.append("k=street")
        if seen:
            near += [f"z={low[-3:]}", f"a={low[:2]}"]
        near.append(f"l={min(len(word), 8)}")
        name = word if word[:1].isupper() and not word.isupper() else word.title()
        if name in given:
            near.append("given")
        if name in family:
            near.append("family")
        if word[:1].isupper():
            near.append("capital")
            if len(word) == 1:
                near.append("initial")
        elif word[:1].islower():
            near.append("small")
    elif word.isdigit():
        near += [f"d={len(word)}", f"h={word[:2]}"]
    return far, near


def _group_features(g: str) -> list[str]:
    """Shape of digits with what joins them."""
    n = sum(c.isdigit() for c in g)
    groups = "-".join(str(len(x)) for x in re.findall(r"\d+", g))
    return [f"gn={min(n, 20)}", f"gg={groups[:16]}", f"gs={''.join(sorted(set(re.sub(r'[0-9]', '', g))))}", f"g0={g[:1] if not g[:1].isdigit() else g[:2]}", f"gd={min(n, 20)}:{groups[:16]}", f"gr={n // 3}{'+' if '+' in g else ''}"]


def _code_features(g: str) -> list[str]:
    """Shape of capitals and digits."""
    if len(g) <= 5 or not any(map(str.isdigit, g)):
        return []
    mask = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", g))
    n = sum(c.isdigit() for c in g)
    return [f"cm={mask[:24]}", f"cl={re.sub(r'(.)\1+', r'\1+', mask)[:16]}", f"cn={min(n, 20)}", "c-mixed" if "A" in mask else "c-digits", f"ca={mask.count('A') if mask.count('A') < 4 else 4}:{n // 3}"]


def _mail_features(g: str) -> list[str]:
    return ["mail", "mail-plain" if "@" in g else "mail-words"]


#: Channels of place features: name -> features of a match.
CHANNELS = {"group": _group_features, "code": _code_features, "mail": _mail_features, "other": lambda g: ["timecode" if "-->" in g else "url" if "://" in g else "path" if g[0] == "/" else "hex"]}


def _digit_groups(joined: str) -> Iterator[tuple[int, int, str]]:
    """Digits with what joins them, with a plus sign or the bracket of an area code before them; a slash between blanks parts two groups."""
    for m in _GROUPS.finditer(joined):
        end = m.start()
        for part in m.group().split(" / "):
            a, b = end, end + len(part)
            end = b + 3
            if a and joined[a - 1] == "+":
                a -= 1
            if a and joined[a - 1] == "(" and 0 < joined.find(")", a, b) - a <= 6:
                a -= 1
            yield a, b, joined[a:b]


def _hex_codes(joined: str) -> Iterator[tuple[int, int, str]]:
    """Whole words of hexadecimal digits, letters among them."""
    for m in _HEX.finditer(joined):
        g = m.group()
        if not g.isdigit() and not g.isalpha() and not joined[m.start() - 1 : m.start()].isalnum() and not joined[m.end() : m.end() + 1].isalnum():
            yield *m.span(), g


def _mails(view: str) -> Iterator[tuple[int, int, str]]:
    """Addresses of mails, found from the sign or word in their middle. A name before it has at most 64 characters by its standard."""
    end = 0
    for p in _PIVOT.finditer(view):
        if p.start() < end:
            continue
        local = _LOCAL.search(view, max(end, p.start() - 80), p.start())
        at = local.start() if local else p.start()
        while at < p.start() and not view[at].isalnum():
            at += 1
        m = _EMAIL.match(view, at)
        if m and m.end() > p.end():
            end = m.end()
            yield *m.span(), m.group()


def _matches(joined: str, views: Sequence[str], base: Sequence[int]) -> dict[str, list[tuple[int, int, str]]]:
    """(start, end, text) of what tokens may lie in, by channel."""
    out = {"group": list(_digit_groups(joined)), "code": [(*m.span(), m.group()) for m in _CODES.finditer(joined)], "mail": [], "other": []}
    for view, b in zip(views, base):
        if "@" in view or (view.isascii() is False or "at" in view) and ("[at]" in (low := view.lower()) or "(at)" in low or (" at " in low and "dot" in low)):
            out["mail"] += [(b + start, b + end, g) for start, end, g in _mails(view)]
        if "/" in view:
            for pattern in (_URL, _PATH) if "://" in view else (_PATH,):
                out["other"] += [(b + m.start(), b + m.end(), m.group()) for m in pattern.finditer(view)]
        if "-->" in view:
            out["other"] += [(b + m.start(), b + m.end(), m.group()) for m in _TIMECODE.finditer(view)]
    out["other"] += _hex_codes(joined)
    return out


class Encoded:
    """Tokens of many paragraphs as flat arrays."""

    def __init__(self, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: np.ndarray, gap: np.ndarray, line: np.ndarray, places: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.kind, self.starts, self.ends, self.count, self.gap, self.line, self.places = kind, starts, ends, count, gap, line, places


class Tokens:
    """Numbers of token types and of place feature sets, given out as they are met."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        self.types: dict[str, int] = {"": 0}
        #: Token as found -> its row in `shape`: type (blanks are -1, line breaks -2, ends of paragraphs -3), length, whether a blank leads.
        self.found: dict[str, int] = {"\n": 0, "\x00": 1}
        self.shape = np.zeros((1024, 3), np.int64)
        self.shape[:2] = [(-2, 1, 0), (-3, 1, 0)]
        self.places: dict[str, dict[tuple, int]] = {c: {} for c in CHANNELS}
        self.known: dict[str, dict[str, int]] = {c: {} for c in CHANNELS}
        self.upper = np.zeros(1024, bool)

    def _add(self, token: str) -> None:
        row = self.found[token] = len(self.found)
        if row >= len(self.shape):
            self.shape = np.concatenate([self.shape, np.zeros_like(self.shape)])
        bare = token.lstrip(" ")
        self.shape[row] = (self._type(bare), len(bare), len(token) - len(bare)) if bare and not bare.isspace() else (-1, len(token), 0)

    def _type(self, token: str) -> int:
        key = token if token.isascii() else _DROP.sub("", token)
        number = self.types.setdefault(key, len(self.types))
        if number >= len(self.upper):
            self.upper = np.r_[self.upper, np.zeros(len(self.upper), bool)]
        self.upper[number] = key[:1].isupper()
        return number

    def _place(self, channel: str, text: str) -> int:
        """Number of the feature set of a match; -1 if it has none."""
        known = self.known[channel]
        number = known.get(text)
        if number is None:
            if len(known) > 200_000:
                known.clear()
            features = tuple(CHANNELS[channel](text))
            number = known[text] = self.places[channel].setdefault(features, len(self.places[channel])) if features else -1
        return number

    def add(self, views: Sequence[str]) -> Encoded:
        found = self.found
        joined = "\x00".join(views)
        tokens = _TOKEN.findall(joined)
        for token in sorted(set(tokens) - found.keys()):  # sorted, so that sums are the same in every process
            self._add(token)
        kind, length, lead = self.shape[np.fromiter(map(found.__getitem__, tokens), np.int64, len(tokens))].T
        start = np.cumsum(length + lead) - length
        owner = np.cumsum(kind == -3)
        base = np.r_[0, start[kind == -3] + 1][: len(views)] if len(views) else np.zeros(0, np.int64)
        real = np.flatnonzero(kind >= 0)
        lines = np.cumsum(kind <= -2)[real]
        own = owner[real]
        count = np.bincount(own, minlength=len(views)).astype(np.int64)
        apart = np.r_[True, np.diff(lines) > 0] if len(real) else np.zeros(0, bool)
        gap = np.where(apart, 2, np.r_[False, np.diff(real) > 1] | (lead[real] > 0)) if len(real) else np.zeros(0, np.int64)
        places = {}
        for channel, marks in _matches(joined, views, base.tolist()).items():
            number = np.fromiter((self._place(channel, t) for _, _, t in marks), np.int64, len(marks))
            edges = np.array([m[:2] for m in marks], np.int64).reshape(-1, 2)
            lo, hi = np.searchsorted(start[real], edges[:, 0]), np.searchsorted(start[real], edges[:, 1])
            keep = (number >= 0) & (hi > lo)
            number, lo, hi = number[keep], lo[keep], hi[keep]
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            row = np.repeat(number, size) * 4 + (at == np.repeat(lo, size)) + 2 * (at == np.repeat(hi - 1, size))
            at, one = np.unique(at, return_index=True)  # of several matches of a channel, the first counts
            places[channel] = (at, row[one])
        return Encoded(kind[real], start[real] - base[own] if len(real) else start[real], (start + length)[real] - base[own] if len(real) else start[real], count, gap, self._lines(kind[real], lines, apart), places)

    def _lines(self, kind: np.ndarray, lines: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Form of each token's line: tokens in it (up to 6), the share of capitals among them (none, some, half, all), and whether it is the first."""
        if not len(kind):
            return kind
        number = np.cumsum(apart) - 1
        n = np.bincount(number)
        capitals = np.bincount(number, self.upper[kind])
        share = np.where(capitals == 0, 0, np.where(capitals == n, 3, np.where(2 * capitals >= n, 2, 1)))
        return (np.minimum(n, 6)[number] * 4 + share[number].astype(np.int64)) * 2 + apart


def _allowed() -> np.ndarray:
    """Transitions that a labelling can have."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                ok[i, j] = a[2:] == b[2:] and a != "O"
    return ok


ALLOWED = _allowed()
START = np.array([x[0] != "I" for x in LABELS])
#: Labels by their part in a span: O and all beginnings; beginnings; insides.
_OUTER, _BEGIN, _INSIDE = (np.array([i for i, x in enumerate(LABELS) if x[0] in kinds]) for kinds in ("OB", "B", "I"))


class Packed:
    """Tokens in order of their place in a paragraph, longer paragraphs first: step s is a block whose first columns go on in step s + 1. There is no padding."""

    def __init__(self, count: np.ndarray):
        who = np.argsort(-count, kind="stable")
        who = who[count[who] > 0]
        first = (np.cumsum(count) - count)[who]
        n = count[who]
        #: Number of paragraphs with more than s tokens.
        self.sizes = (len(n) - np.searchsorted(n[::-1], np.arange(n[0] if len(n) else 0), side="right")).tolist()
        self.at = np.concatenate([first[:b] + s for s, b in enumerate(self.sizes)]) if len(n) else np.zeros(0, np.int64)
        edges = np.r_[0, np.cumsum(self.sizes)].astype(int).tolist() if len(n) else [0]
        self.blocks = list(zip(edges[:-1], edges[1:]))


def viterbi(emission: np.ndarray, count: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best labels of all tokens; emission is (tokens, labels)."""
    packed, m = Packed(count), len(LABELS)
    best = np.ascontiguousarray(emission[packed.at].T)
    outer, begun, going = transitions[:, _OUTER], transitions[_BEGIN, _INSIDE][:, None], transitions[_INSIDE, _INSIDE][:, None]
    gained = np.empty((m, packed.sizes[0] if packed.sizes else 0), emission.dtype)
    for s, (a, b) in enumerate(packed.blocks):
        if s == 0:
            best[~START, a:b] = -1e9
        else:
            n = b - a
            before, new = best[:, last : last + n], gained[:, :n]
            new[_OUTER] = (before[:, None, :] + outer[:, :, None]).max(0)
            new[_INSIDE] = np.maximum(before[_BEGIN] + begun, before[_INSIDE] + going)
            best[:, a:b] += new
        last = a
    label = np.zeros(len(packed.at), np.int64)
    closed = np.where(ALLOWED, transitions, -1e9).astype(emission.dtype)
    follow = label[:0]
    for a, b in reversed(packed.blocks):
        score = best[:, a:b].copy()
        score[:, : len(follow)] += closed[:, follow]
        follow = label[a:b] = score.argmax(0)
    out = np.zeros(len(emission), np.int64)
    out[packed.at] = label
    return out


class _Sums:
    """Sums of rows of values by key, by a sort that is made once."""

    def __init__(self, keys: np.ndarray, size: int):
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.starts = np.unique(keys[self.order], return_index=True)
        self.size = size

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, values.shape[1]), values.dtype)
        if len(self.keys):
            out[self.keys] = np.add.reduceat(values[self.order], self.starts)
        return out


def _shifted(kind: np.ndarray, count: np.ndarray) -> dict[int, np.ndarray]:
    """Type at each offset from each token, 0 beyond the paragraph."""
    number = np.repeat(np.arange(len(count)), count)
    out = {0: kind}
    for o in range(1, max(OFFSETS) + 1):
        same = number[:-o] == number[o:]
        out[o], out[-o] = np.zeros_like(kind), np.zeros_like(kind)
        out[o][:-o] = np.where(same, kind[o:], 0)
        out[-o][o:] = np.where(same, kind[:-o], 0)
    return out


def _uses(e: Encoded) -> dict[str, tuple[np.ndarray | None, np.ndarray]]:
    """(tokens, rows) by table: which row of each table counts for which token (None: for all in their order)."""
    after = np.ones(len(e.kind), bool)
    after[np.cumsum(e.count)[e.count > 0] - 1] = False  # has a next token
    head = np.r_[True, ~after[:-1]] if len(after) else after
    out: dict[str, tuple[np.ndarray | None, np.ndarray]] = {str(o): (None, x) for o, x in _shifted(e.kind, e.count).items()}
    out["gap"] = (None, e.gap)
    out["gap-next"] = (None, np.where(after, np.r_[e.gap[1:], 2], 2) if len(after) else e.gap)
    out["line"] = (None, e.line)
    for channel, (at, row) in e.places.items():
        out[channel] = (at, row)
        follows, leads = ~head[at], after[at]
        out[f"{channel}-next"] = (at[follows] - 1, row[follows])
        out[f"{channel}-before"] = (at[leads] + 1, row[leads])
    return out


def _place_rows(features: Sequence[str]) -> list[list[str]]:
    """Features of the four rows of a place: inside, first, last, both."""
    return [[*features, *(["first", f"{features[0]}|first"] if f & 1 else []), *(["last", f"{features[0]}|last"] if f & 2 else [])] for f in range(4)]


_GAPS = [[f"glue={g}"] for g in range(3)]
_LINES = [[f"line={n}", f"caps={c}", f"form={n}:{c}", f"form={n}:{c}:{f}"] for n in range(7) for c in range(4) for f in range(2)]


def _entries(rows: Sequence[Sequence[str]], table: str, index: dict[str, int], grow: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature number) of all features of the rows of a table."""
    row, number = [], []
    for r, features in enumerate(rows):
        for f in features:
            key = f"{table}\t{f}"
            k = index.setdefault(key, len(index)) if grow else index.get(key)
            if k is not None:
                row.append(r)
                number.append(k)
    return np.array(row, np.int64), np.array(number, np.int64)


class Crf:
    """Weights by feature, transitions, and Viterbi."""

    def __init__(self, names: Sequence[str], weights: np.ndarray, transitions: np.ndarray, given: set[str], family: set[str]):
        self.names, self.weights, self.transitions, self.given, self.family = names, weights, transitions, given, family
        self.index = {name: k for k, name in enumerate(names)}
        # features of types have one row for all offsets
        self.of_type: dict[str, int] = {}
        places = [str(o) for o in OFFSETS]
        where = [(k, *name.split("\t", 1)) for k, name in enumerate(names)]
        where = [(k, places.index(table), self.of_type.setdefault(f, len(self.of_type))) for k, table, f in where if table in places]
        self.typed = np.zeros((len(self.of_type), len(OFFSETS), len(LABELS)), np.float32)
        if where:
            k, o, f = np.array(where).T
            self.typed[f, o] = weights[k]
        self._reset()

    def _reset(self) -> None:
        self.tokens = Tokens(self.given, self.family)
        self.scores: dict[str, np.ndarray] = {}
        self.known: dict[str, int] = {}
        for table, rows in (("gap", _GAPS), ("gap-next", _GAPS), ("line", _LINES)):
            self._grow(table, rows)
        # the three small tables as one
        gap, after, line = (self.scores.pop(t) for t in ("gap", "gap-next", "line"))
        self.form = (gap[:, None, None] + after[None, :, None] + line[None, None]).reshape(-1, len(LABELS))

    def _grow(self, table: str, rows: Sequence[Sequence[str]]) -> None:
        row, number = _entries(rows, table, self.index, False)
        own = _Sums(row, len(rows))(self.weights[number])
        self.scores[table] = np.concatenate([self.scores[table], own]) if table in self.scores else own

    def _emissions(self, e: Encoded) -> np.ndarray:
        t = self.tokens
        if self.known.get("types", 0) < len(t.types):  # only the rows of new types are computed
            row, number = [], []
            words = list(t.types)[self.known.get("types", 0) :]
            for r, word in enumerate(words):
                for f in chain(*type_features(word, t.given, t.family)) if word else ("pad",):
                    k = self.of_type.get(f)
                    if k is not None:
                        row.append(r)
                        number.append(k)
            own = _Sums(np.array(row, np.int64), len(words))(self.typed[np.array(number, np.int64)].reshape(len(number), -1)).reshape(len(words), len(OFFSETS), -1)
            for i, o in enumerate(map(str, OFFSETS)):
                part = np.ascontiguousarray(own[:, i])
                self.scores[o] = np.concatenate([self.scores[o], part]) if o in self.scores else part
            self.known["types"] = len(t.types)
        for channel, places in t.places.items():
            if self.known.get(channel, 0) < len(places):
                new = [r for f in list(places)[self.known.get(channel, 0) :] for r in _place_rows(f)]
                self._grow(channel, new)
                self._grow(f"{channel}-next", new)
                self._grow(f"{channel}-before", new)
                self.known[channel] = len(places)
        uses = _uses(e)
        (_, gap), (_, after), (_, line) = (uses.pop(t) for t in ("gap", "gap-next", "line"))
        out = self.form[(gap * len(_GAPS) + after) * len(_LINES) + line]
        for table, (at, row) in uses.items():
            if at is None:
                out += self.scores[table][row]
            elif len(at):
                out[at] += self.scores[table][row]
        return out

    def decode(self, views: Sequence[str]) -> list[list[tuple[int, int, str]]]:
        """Labelled spans of paragraphs."""
        if len(self.tokens.found) > 400_000 or max(map(len, self.tokens.places.values())) > 100_000:
            self._reset()
        e = self.tokens.add(views)
        out: list[list[tuple[int, int, str]]] = [[] for _ in views]
        if not len(e.kind):
            return out
        label = viterbi(self._emissions(e), e.count, self.transitions)
        owner = np.repeat(np.arange(len(views)), e.count)
        head = np.flatnonzero(label % 2 == 1)
        # the last token of a span is the last before a label that is no inside
        closed = np.flatnonzero((label > 0) & (np.r_[label[1:], 0] % 2 + (np.r_[label[1:], 0] == 0) > 0))
        for a, b in zip(head.tolist(), closed.tolist()):
            out[owner[a]].append((int(e.starts[a]), int(e.ends[b]), TYPES[label[a] // 2]))
        return out


def train(people: Sequence[tuple[str | None, str | None]], copies: int = 16, steps: int = 100, rate: float = 0.1, penalty: float = 0.02, blind: float = 0.25, seldom: int = 6, rows: Sequence[tuple[str, list[tuple[int, int, str]]]] | None = None) -> Crf:
    """Weights that fit the labelled table (rows; by default `copies` fillings of each pattern): Adam on the penalised
    likelihood, gradients by forward and backward sums in numpy. Of `blind` of the words the letters are hidden, so that
    the forms around them are learnt too."""
    pairs = sorted((g, f) for g, f in people if g and f)
    given, family = {g for g, _ in pairs}, {f for _, f in pairs}
    tokens = Tokens(given, family)
    texts = pii_labels.rows(pairs, copies) if rows is None else rows
    e = tokens.add([_view(t) for t, _ in texts])
    first = np.cumsum(e.count) - e.count
    gold = np.zeros(len(e.kind), np.int64)
    for p, (_, spans) in enumerate(texts):
        own = slice(first[p], first[p] + e.count[p])
        for a, b, kind in spans:
            inside = np.flatnonzero((e.starts[own] < b) & (e.ends[own] > a)) + first[p]
            gold[inside] = 2 * TYPES.index(kind) + 2
            gold[inside[0]] = 2 * TYPES.index(kind) + 1
    names, m = list(tokens.types), len(LABELS)
    # words that hardly occur have no feature of their own, as those that will be met for the first time
    rare = np.bincount(e.kind, minlength=len(names)) < seldom
    hidden = np.random.default_rng(3).random(len(e.kind)) < blind
    e.kind = e.kind + len(names) * hidden
    index: dict[str, int] = {}
    typed = [type_features(w, given, family, seen) if w else (["pad"], []) for seen in (True, False) for w in names]
    typed = [([f for f in far if not (f.startswith("w=") and rare[k % len(names)])], near) for k, (far, near) in enumerate(typed)]
    rows_of = {str(o): [far + near if abs(o) <= 1 else far for far, near in typed] for o in OFFSETS} | {"gap": _GAPS, "gap-next": _GAPS, "line": _LINES}
    for channel, places in tokens.places.items():
        rows_of[channel] = rows_of[f"{channel}-next"] = rows_of[f"{channel}-before"] = [r for f in places for r in _place_rows(f)]
    uses = _uses(e)
    tables = []
    for table, (at, row) in uses.items():
        entry_row, number = _entries(rows_of[table], table, index, True)
        n = len(rows_of[table])
        tables.append((at, row, number, entry_row, _Sums(entry_row, n), _Sums(row, n), number))
    by_feature = [_Sums(number, len(index)) for *_, number in tables]
    w, trans = np.zeros((len(index), m), np.float32), np.zeros((m, m), np.float32)
    packed = Packed(e.count)
    last = np.zeros(len(e.kind), bool)
    last[np.cumsum(e.count)[e.count > 0] - 1] = True
    empirical = np.zeros((m, m))
    np.add.at(empirical, (gold[:-1][~last[:-1]], gold[1:][~last[:-1]]), 1)
    one_hot = np.eye(m, dtype=np.float32)[gold]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, trans)]
    pool = ThreadPoolExecutor(min(4, os.cpu_count() or 1))  # numpy works without the interpreter's lock; sums are taken in a fixed order
    for step in range(1, steps + 1):
        emission = np.zeros((len(e.kind), m), np.float32)
        for (at, *_), own in zip(tables, pool.map(lambda t: t[4](w[t[2]])[t[1]], tables)):
            if at is None:
                emission += own
            else:
                emission[at] += own
        marginal, seen_pairs = _marginals(emission, packed, trans)
        residual = one_hot - marginal
        grad = -penalty * w
        for own in pool.map(lambda t, features: features(t[5](residual if t[0] is None else residual[t[0]])[t[3]]), tables, by_feature):  # noqa: B023
            grad += own
        for value, g, (m1, m2) in ((w, grad, moments[0]), (trans, empirical - seen_pairs - penalty * trans, moments[1])):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            value += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8) / (1 + 3 * step / steps)
    pool.shutdown()
    return Crf(list(index), w.astype(np.float32), trans.astype(np.float32), given, family)


def _marginals(emission: np.ndarray, packed: Packed, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label of each token, and expected transitions, by scaled forward and backward sums."""
    gain = np.exp(np.clip(emission - emission.max(1, keepdims=True), -60, 0))[packed.at].T.copy()
    move = (np.exp(np.clip(trans, -20, 20)) * ALLOWED).astype(gain.dtype)
    alpha, beta, right = np.empty_like(gain), np.ones_like(gain), np.empty_like(gain)
    scale = np.empty(gain.shape[1], gain.dtype)
    for s, (a, b) in enumerate(packed.blocks):
        own = gain[:, a:b] * START[:, None] if s == 0 else (move.T @ alpha[:, before : before + b - a]) * gain[:, a:b]
        scale[a:b] = np.maximum(own.sum(0), 1e-30)
        alpha[:, a:b] = own / scale[a:b]
        before = a
    pairs = np.zeros_like(move)
    for (a, _), (c, d) in reversed(list(zip(packed.blocks, packed.blocks[1:]))):
        right[:, c:d] = gain[:, c:d] * beta[:, c:d] / scale[c:d]
        beta[:, a : a + d - c] = move @ right[:, c:d]
        pairs += alpha[:, a : a + d - c] @ right[:, c:d].T
    marginal = np.empty_like(emission)
    marginal[packed.at] = (alpha * beta).T
    return marginal, pairs * move


#: What stands at the edges of a labelled stretch without being part of it.
_HEAD = " \t\n\r\v\f,;:.<>\"“”«»'‘’*|！，。；：）)]"
_TAIL = " \t\n\r\v\f,;:<>\"“”«»'‘’*|!?！？，。；：（(["
#: Last words of addresses that have a dot of their own.
_SHORT = re.compile(r"(?:\b(?:St|Str|izq|dcha)|str)$")
_CLOSE = {")": "(", "）": "（", "]": "["}


def _trimmed(view: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """A labelled stretch without blanks and marks at its edges; None if it can't be of its type by definition."""
    head = _HEAD if kind == "phone" else _HEAD + "("
    while a < b and (view[a] in head or view[a].isspace()):
        a += 1
    while b > a:
        c = view[b - 1]
        if c in _TAIL or c.isspace() or (c == "." and not (kind == "street_address" and _SHORT.search(view, a, b - 1))) or (c in _CLOSE and view.count(c, a, b) > view.count(_CLOSE[c], a, b)):
            b -= 1
        else:
            break
    if kind == "street_address" and b < len(view) and view[b] == "." and _SHORT.search(view, a, b):
        b += 1
    digits = sum(map(str.isdigit, view[a:b]))
    if kind == "person_name":
        ok = digits == 0 and any(map(str.isalpha, view[a:b]))
    elif kind == "street_address":
        ok = digits > 0 and any(map(str.isalpha, view[a:b]))
    elif kind == "email":
        ok = "@" in view[a:b] or _AT_WORD.search(view, a, b) is not None
    else:
        ok = digits >= (5 if kind == "phone" else 3)
    return (a, b) if ok and a < b else None


_AT_WORD = re.compile(r"\bat\b", re.I)


def find(crf: Crf, texts: Sequence[str | None]) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, type) of each text, sorted. Equal paragraphs are decoded once."""
    views: dict[str, int] = {}
    parts: list[list[tuple[int, int]]] = []
    for t in texts:
        own: list[tuple[int, int]] = []
        if t:
            view = _view(t)
            start = 0
            for m in [*_PARAGRAPH.finditer(view), None]:
                end = m.start() if m else len(view)
                if end > start:
                    own.append((start, views.setdefault(view[start:end], len(views))))
                start = m.end() if m else end
        parts.append(own)
    named = list(views)
    found = [[(*ok, kind) for a, b, kind in spans if (ok := _trimmed(view, a, b, kind))] for view, spans in zip(named, crf.decode(named))]
    return [[(start + a, start + b, kind) for start, k in own for a, b, kind in found[k]] for own in parts]


def redact(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """The text with typed placeholders in place of the spans."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


SPANS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pii_type", T.StringType()), T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType())])
REDACTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.IntegerType())])


def _slices(batch: pa.RecordBatch, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded amount of text; a longer text is a part of its own."""
    start = size = 0
    for i, t in enumerate(batch.column("text").to_pylist()):
        n = len(t) if t else 0
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _people(people: DataFrame) -> list[tuple[str, str]]:
    rows = people.select("given_name", "family_name").distinct().limit(MAX_PEOPLE + 1).collect()
    if len(rows) > MAX_PEOPLE:
        raise ValueError(f"the crew list has more than {MAX_PEOPLE} people")
    return sorted((r[0], r[1]) for r in rows if r[0] and r[1])


_STORED = "names string, weights binary, transitions binary"
_models: dict[str, tuple] = {}


def _model(spark: SparkSession, people: Sequence[tuple[str, str]]) -> tuple:
    """The fitted model: from memory, from the shared folder, or trained now and stored there. Its key is a hash of all that it depends on."""
    own = (pii_labels.rows(people), CUES, LABELS, OFFSETS, train.__defaults__, train.__code__.co_code.hex())
    key = hashlib.sha256(repr(own).encode("utf-8", "replace")).hexdigest()[:32]
    if key not in _models:
        path = f"{shared_folder(spark)}/personal-spans-{key}"
        try:
            row = spark.read.schema(_STORED).parquet(path).first()
        except AnalysisException:
            row = None
        if row is None:
            crf = train(people)
            # a second session that stores the same adds an equal row
            spark.createDataFrame([("\n".join(crf.names), bytearray(crf.weights.tobytes()), bytearray(crf.transitions.tobytes()))], _STORED).coalesce(1).write.mode("append").parquet(path)
            names, weights, transitions = crf.names, crf.weights, crf.transitions
        else:
            names, m = row["names"].split("\n"), len(LABELS)
            weights, transitions = np.frombuffer(row["weights"], np.float32).reshape(-1, m), np.frombuffer(row["transitions"], np.float32).reshape(m, m)
        _models[key] = (names, weights, transitions, {g for g, _ in people}, {f for _, f in people})
    return _models[key]


def personal_spans(documents: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, pii_type, span_start, span_end of every personal datum in every text."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(_model(spark, _people(people)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*sent.value)
        for batch in batches:
            for part in _slices(batch):
                ids = part.column("doc_id").to_pylist()
                rows = [(i, kind, a, b) for i, spans in zip(ids, find(crf, part.column("text").to_pylist())) for a, b, kind in spans]
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=SPANS.names)

    return spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, SPANS)


def redacted(documents: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, text with placeholders, number of spans; one row per document."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(_model(spark, _people(people)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*sent.value)
        for batch in batches:
            for part in _slices(batch):
                texts = part.column("text").to_pylist()
                found = find(crf, texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([redact(t, s) if t else t for t, s in zip(texts, found)], pa.string()), pa.array([len(s) for s in found], pa.int32())], names=REDACTED.names)

    return spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, REDACTED)
