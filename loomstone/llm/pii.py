"""Operator 6: personal data with offsets into the source, disguised forms included.

Base spans are leftmost non-overlapping matches per kind in the text as it stands. Then transducers rewrite the text and
keep, for every character they emit, the source range it came from: homoglyphs and invisible characters, spelled digits,
and disguised at and dot signs. The same detectors run on the rewritten text, and what they find is mapped back; a found
span is added unless it is itself a base span: a base span that it overlaps may be only what the disguise has left.

Defined results: a null text is an empty one without spans; every row is kept, equal rows too; offsets count code points
with exclusive ends; other columns of the input are ignored by ``detect`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import shared

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

#: Letters of other scripts that look like ASCII letters, then signs that look like ASCII signs.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u",
    "․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "﹢": "+", " ": " ", " ": " ", " ": " ", "　": " ",
}
INVISIBLE = "​‌‍⁠﻿­"
#: The ten digits as words, from zero to nine, in the languages covered.
DIGIT_WORDS = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
SPELLED = {w: str(d) for row in DIGIT_WORDS for d, w in enumerate(row)}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign: a domain to its right, the whole run of local characters to its left."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start, after = at, at + 1
        if m := _DOMAIN.match(text, after):
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                free = after = m.end()
                out.append((start, free))
        at = text.find("@", after)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Numbers joined by dots, taken four at a time from the left."""
    out = []
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]


def base(text: str) -> list[Span]:
    """Spans by kind as in ``KINDS``, then by start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, find in (("ip", addresses), ("card", cards), ("phone", phones)):
            out += [(kind, *s) for s in find(text)]
    return out


class Tape:
    """A text with, for each character, where its source starts and ends."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, range(len(text)), range(1, len(text) + 1), False

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges (ascending, disjoint); each emitted character stands for its whole range."""
        if not edits:
            return
        parts, starts, ends, at = [], array("i"), array("i"), 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:a], new]
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            if new:
                starts.extend([self.starts[a]] * len(new))
                ends.extend([self.ends[b - 1]] * len(new))
            at = b
        self.text, self.starts, self.ends, self.changed = "".join(parts), starts, ends, True

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


@lru_cache(maxsize=1)
def _lookalikes() -> dict[int, str]:
    """Characters that stand for one ASCII character: homoglyphs, wide forms, and the decimal digits of all scripts."""
    out = {n: chr(n - 0xFEE0) for n in range(0xFF01, 0xFF5F)}
    out |= {n: str(d) for n in range(128, 0x20000) if (d := unicodedata.decimal(chr(n), None)) is not None}
    return out | {ord(c): new for c, new in HOMOGLYPHS.items()}


_INVISIBLE = re.compile("[" + INVISIBLE + "]+")


def plain_characters(tape: Tape) -> None:
    """Look-alikes are replaced one for one, so positions stay; invisible characters go."""
    text = tape.text.translate(_lookalikes())
    tape.text, tape.changed = text, tape.changed or text != tape.text
    tape.rewrite([(*m.span(), "") for m in _INVISIBLE.finditer(text)])


_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_RUN = re.compile(rf"\b(?<!\w)(?:plus[ -]{{1,2}})?(?:{_WORD})(?:[ ,.\-]{{1,2}}(?:{_WORD}|dot|point|punkt|punto|[0-9]++)){{3,}}(?!\w)", re.IGNORECASE)
_TOKEN = re.compile(r"([ ,.\-]*)(\w+)")


def spelled_digits(tape: Tape) -> None:
    """Runs of at least four digits as words become digits; "plus" before and "dot" within a run become signs."""
    edits = []
    for m in _RUN.finditer(tape.text):
        before = ""
        for t in _TOKEN.finditer(m.group()):
            gap, word = t.groups()
            low = word.lower()
            new = SPELLED.get(low) or {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}.get(low)
            glued = new is not None and (before in (".", "+", "word") or not before)
            a = m.start() + (t.start() if glued and before else t.start(2))
            if new is not None:
                edits.append((a, m.start() + t.end(), new))
            elif before == "." and gap:
                edits.append((m.start() + t.start(), m.start() + t.start(2), ""))
            before = new if new in (".", "+") else "word" if new else "digits"
    tape.rewrite(edits)


#: Disguised dots: in brackets, as a word of its own, between hyphens or underscores, or set apart by white space.
_DOT = r"\s*+[\[({<]\s*+(?i:dot|\.|punkt|punto|point)\s*+[\])}>]\s*+|\s++(?i:dot|punkt|punto)\s++|[_-](?i:dot)[_-]|\s++\.\s++"
#: At signs: in brackets, as a word of its own before a disguised dot, plain before a host, or between hyphens or underscores.
_AT = re.compile(
    r"[@\[({<_aA-](?:(?P<bracket>(?<=[\[({<])\s*+(?i:at|@|arroba|arobase)\s*+[\])}>])"
    rf"|(?<=@)(?=\s*+[A-Za-z0-9-]++(?:{_DOT}|\.))"
    rf"|(?P<word>(?<=[aA])(?<!\S.)(?i:t|rroba|robase)(?=\s++[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?:{_DOT})))"
    r"|(?<=[A-Za-z0-9][_-])[aA][tT][_-](?=[A-Za-z0-9]))"
)
_ANY_DOT = re.compile(rf"{_DOT}|\.")
_DOT_BETWEEN = re.compile(r"(?<=[A-Za-z0-9])-dot-(?=[A-Za-z0-9])", re.IGNORECASE)
_NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:{_DOT})(?=[0-9])")
_LABEL = re.compile(r"[A-Za-z0-9-]{1,64}")
_BRACKETED_DOT = re.compile(r"[\[({<]\s*+(?:dot|\.|punkt|punto|point)\s*+\Z", re.IGNORECASE)
#: What an address may hold (RFC 5321 and 1035): characters of a local part and of a label.
LOCAL_MOST, LABEL_MOST = 64, 63
#: Characters of a host (RFC 1035).
HOST_MOST = 253
#: Top-level names, beside all of two letters, that end a host whose last dot is a plain sign set apart by blanks.
TOP_NAMES = frozenset("com org net edu gov mil int info biz name pro app dev cloud online site tech store blog shop email xyz example test invalid local".split())
#: Function words and numbers, which neither name somebody before a bare "at" nor end a host after it.
FUNCTION_WORDS = frozenset(
    "a an the this that these those i we you he she it they me us him her them my your his its our their who which what where when how why "
    "is are was were be been am has have had do does did will would can could may might must shall should "
    "not no and or but so if than then as of in on off up down out over under by for from to with into onto back here there now still just only even again also very".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred".split())
#: Verbs that take "at".
VERBS_AT = frozenset(
    "arrive arrives arrived arriving look looks looked looking meet meets met meeting stay stays stayed staying stare stares stared staring aim aims aimed aiming "
    "point points pointed pointing laugh laughs laughed laughing smile smiles smiled smiling shout shouts shouted shouting sit sits sat sitting stand stands stood standing wait waits waited waiting".split()
)


def _blanks_before(text: str, at: int, free: int) -> int:
    while at > free and text[at - 1].isspace():
        at -= 1
    return at


def _blanks_after(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _local_before(text: str, at: int, free: int) -> int:
    """Where the run of local characters that ends at ``at`` begins; a run longer than a local part may be has no begin."""
    begin = at
    while begin > free and text[begin - 1] in _LOCAL:
        begin -= 1
        if at - begin > LOCAL_MOST:
            return at
    return begin


def _dot_before(text: str, at: int, free: int) -> int | None:
    """Where a disguised dot that ends at ``at`` begins."""
    end = _blanks_before(text, at, free)
    if end > free and text[end - 1] in "])}>":
        inner = _blanks_before(text, end - 1, free)
        if m := _BRACKETED_DOT.search(text, max(free, inner - 8), inner):
            return _blanks_before(text, m.start(), free)
    elif end < at:
        for word in ("dot", "punkt", "punto"):
            begin = end - len(word)
            if begin > free and text[begin:end].lower() == word and text[begin - 1].isspace():
                return _blanks_before(text, begin, free)
    return None


def _step(text: str, at: int, split: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]], tuple[int, int] | None]:
    """The label at ``at`` (cut at "-dot-" if ``split``), the dots within it, and the dot after it; no labels if there is none."""
    m = _LABEL.match(text, at)
    if m is None or m.end() - at > LABEL_MOST:
        return [], [], None
    labels, dots, begin = [], [], at
    for d in _DOT_BETWEEN.finditer(text, at, m.end()) if split else ():
        labels.append((begin, d.start()))
        dots.append(d.span())
        begin = d.end()
    d = _ANY_DOT.match(text, m.end())
    return [*labels, (begin, m.end())], dots, d.span() if d else None


#: Labels that are read ahead at once, and steps that are remembered.
AHEAD, REMEMBERED = 1024, 20_000


class _Hosts:
    """Labels joined by dots of any kind from given places on; chains that several at signs lead into are read once.

    For each label that is read: what ``_step`` says, and where the next disguised dot and the next label that may end a host
    begin (beyond the text if there is none). Chains are read ahead in parts, the last labels of a part again with the next,
    so what is remembered holds for as far as a host may reach.
    """

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def _read(self, at: int, split: bool) -> None:
        path, text, none = [], self.text, len(self.text) + HOST_MOST
        while (at, split) not in self.known and len(path) < AHEAD:
            step = _step(text, at, split)
            path.append((at, step))
            if step[2] is None:
                break
            at = step[2][1]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        whole = len(path) < AHEAD
        following = self.known.get((at, split)) if whole and path[-1][1][2] is not None else None
        for i in range(len(path) - 1, -1, -1):
            at, (own, inner, after) = path[i]
            hidden, top = following[3:] if following else (none, none)
            if after and following and following[0]:
                first = following[0][0]
                if text[slice(*after)] != ".":
                    hidden = after[0]
                if _ends_host(text[slice(*first)], text[slice(*after)]):
                    top = first[0]
            for label, dot in reversed(list(zip(own[1:], inner, strict=True))):
                hidden = dot[0]
                top = label[0] if _ends_host(text[slice(*label)], text[slice(*dot)]) else top
            following = (own, inner, after, hidden, top)
            if whole or i < AHEAD - HOST_MOST // 2 - 1:
                self.known[at, split] = following

    def _at(self, at: int, split: bool) -> tuple:
        if (at, split) not in self.known:
            self._read(at, split)
        return self.known[at, split]

    def ahead(self, at: int, split: bool) -> tuple[bool, bool]:
        """Whether the chain goes on to a disguised dot, and to a label that may end a host."""
        hidden, top = self._at(at, split)[3:]
        return hidden <= len(self.text), top <= len(self.text)

    def labels(self, at: int, split: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Labels and the dots between them, of ``HOST_MOST`` characters at most; ``split``: "-dot-" is a dot too."""
        labels, dots, size, dot = [], [], 0, None
        while True:
            own, inner, after, *_ = self._at(at, split)
            size += sum(b - a + 1 for a, b in own)
            if not own or size > HOST_MOST + 1:
                return labels, dots
            if dot:
                dots.append(dot)
            labels += own
            dots += inner
            if after is None:
                return labels, dots
            dot, at = after, after[1]


def _ends_host(name: str, dot: str) -> bool:
    """Whether a label may be a top-level name: a known one, or any letters after a dot that is spelled or in brackets."""
    low = name.lower()
    if low in TOP_NAMES or len(low) == 2 and low.isalpha():
        return True
    return dot.strip() not in ("", ".") and low.isalpha() and len(low) > 2 and low not in FUNCTION_WORDS and low not in NUMBER_WORDS


def signs(tape: Tape) -> None:
    """Disguised at and dot signs become signs where they make an address within the limits of its standard.

    The host ends with its last label that may be a top-level name (``_ends_host``); after an at sign in brackets, which
    leaves no doubt, any label may end it. A bare word "at" and one between hyphens count only where a disguised dot follows,
    and the bare one only after a word that is no function word, number or verb that takes "at", and before a host that is
    more than a function word. White space of every kind and length around a disguised sign counts alike. Time is linear in
    the text: what an at sign looks at is bounded by the standard, and labels are read once.
    """
    text, edits, free, hosts = tape.text, [], 0, _Hosts(tape.text)
    for m in _AT.finditer(text):
        if m.start() < free:
            continue
        joined_ = m.group()[0] in "-_"
        plain = m.group() == "@"
        end, begin = (m.end(), m.start()) if joined_ else (_blanks_after(text, m.end()), _blanks_before(text, m.start(), free))
        split, spelled = joined_ or m.group("bracket") is not None, m.group("word") or m.group()[0] == "-" or plain and (begin, end) == m.span()
        some_dot, some_top = hosts.ahead(end, split)
        if spelled and not some_dot or not some_top and not m.group("bracket"):
            continue
        labels, dots = hosts.labels(end, split)
        tops = [i for i in range(1, len(labels)) if _ends_host(text[slice(*labels[i])], text[slice(*dots[i - 1])])]
        if not tops and not (m.group("bracket") and len(labels) > 1):
            continue
        last = tops[-1] if tops else len(labels) - 1
        hidden = [d for d in dots[:last] if text[slice(*d)] != "."]
        if not hidden and spelled:
            continue
        name = _local_before(text, begin, free)
        if name == begin:
            continue
        before, size = [], begin - name
        while len(before) < 3 and (d := _dot_before(text, name, free)) is not None:
            further = _local_before(text, d, free)
            size += 1 + d - further
            if further == d or size > LOCAL_MOST:
                break
            before.append((d, name, "."))
            name = further
        if m.group("word"):
            low = text[name:begin].lower()
            if not before and (low in FUNCTION_WORDS or low in NUMBER_WORDS or low in VERBS_AT) or last == 1 and text[slice(*labels[0])].lower() in FUNCTION_WORDS:
                continue
        edits += [*before[::-1], (begin, end, "@"), *((*d, ".") for d in hidden)]
        free = labels[last][1]
    taken, i = [], 0
    for m in _NUMBER_DOT.finditer(text):
        while i < len(edits) and edits[i][1] <= m.start():
            i += 1
        if i == len(edits) or m.end() <= edits[i][0]:
            taken.append((*m.span(), "."))
    tape.rewrite(sorted(edits + taken))


def disguised(text: str) -> list[Span]:
    """Spans of the rewritten text, in source offsets; none if nothing was rewritten."""
    tape = Tape(text)
    if not text.isascii():
        plain_characters(tape)
    spelled_digits(tape)
    signs(tape)
    return [(kind, *tape.source(a, b)) for kind, a, b in base(tape.text)] if tape.changed else []


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each by kind and start."""
    found = base(text)
    known = set(found)
    extra = [x for x in disguised(text) if x not in known]
    if not extra:
        return found, found
    return found, sorted([*found, *extra], key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def detect(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: base counts by kind, SHA-256 of the base spans, all spans, and how many were added."""
    shared.small_batches(docs.sparkSession)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches):
        for b in batches:
            shared.trim()
            rows = []
            for t in b.column(1).to_pylist():
                found, full = spans(t or "")
                kinds = [x[0] for x in found]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(found).encode()).hexdigest(), joined(full), len(full) - len(found)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(shared.worker(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` masked; null stays null."""
    shared.small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        for b in batches:
            shared.trim()
            new = [None if t is None else masked(t, f) if (f := spans(t)[1]) else t for t in b.column(place).to_pylist()]
            yield b.set_column(place, b.schema.field(place), pa.array(new, b.schema.field(place).type))

    return docs.mapInArrow(shared.worker(run), docs.schema)
