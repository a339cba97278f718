"""Personal data in texts, plain and disguised, with offsets into the original.

Plain e-mail addresses, IPv4 addresses, card and phone numbers are found as they stand. Then transducers rewrite the places that hold disguises, each a pass over the text that keeps,
for every character it writes, the span of source characters it stands for: look-alike and full-width characters become ASCII, invisible ones go; runs of spelled digits become digits; spelled
or bracketed "at" and "dot" become signs. Identifiers found in the rewritten text that rest on a rewritten character are mapped back to source spans and added.

Defined results: null and empty texts have no spans, and base_sha256 of nothing. Offsets are code points, ends are exclusive. Matches that fail a kind's test are dropped and not tried again. An added
span never lies inside a plain one of its kind, but may hold one. Repeated rows are treated alike. An empty table gives an empty result. Other columns of the input are not read.
Texts may be of any length: no pattern looks at a stretch of text more than a fixed number of times.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import tidy

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # what fails at a number's first digit fails at the others
CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An @ with a domain after it and all characters before it that a name may hold, back to the match before."""
    at, last = text.find("@"), 0
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > last and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                yield start, domain.end()
                last = domain.end()
        at = text.find("@", at + 1)


def plain(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of what stands undisguised, by start and then kind as listed."""
    out = [("email", *span) for span in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := NO_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NO_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


#: Look-alikes of ASCII letters beyond those that compatibility forms give, in alphabets order.
LOOKALIKES = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухѕіјԁһԛԝ", "ABEKMHOPCTYXSIJaeopcyxsijdhqw", strict=True)) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχ", "ABEZHIKMNOPTYXaivopux", strict=True)) | dict(zip("ɑɡıƖ․‐‑‒–＠﹫∙•", "agil.----@@..", strict=True))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digits from zero to nine in four languages, and other spellings.
DIGITS = {
    w: str(d)
    for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for d, w in enumerate(words.split())
} | {"oh": "0", "zwo": "2", "fuenf": "5"}
AT, DOT, DASH, PLUS = "at|arroba|arobase|ät", "dot|punkt|point|punto", "dash|hyphen|minus|bindestrich|tiret|guion", "plus|más"
#: Last labels that an address of bare words may end in.
ENDINGS = frozenset("com org net edu gov mil int info biz name io co me tv ai app dev eu de at ch fr es it pt nl be lu dk se no fi is ie uk us ca mx br ar cl pl cz sk hu ro bg gr tr ru ua jp cn in au nz za il".split())

_DIGIT = "|".join(sorted(map(re.escape, DIGITS), key=len, reverse=True))
_SIGN = f"{DOT}|{DASH}|{PLUS}|point"
SPELLED = re.compile(rf"(?<!\w)(?:(?:{PLUS})[ \t]+)?(?:(?:{_DIGIT}|[0-9]+)(?:[ \t]*[-,.][ \t]*|[ \t]+(?:(?:{DOT}|{DASH})[ \t]+)?)){{3,}}(?:{_DIGIT}|[0-9]+)(?!\w)", re.I)
_UNIT = re.compile(rf"(?P<digit>{_DIGIT})(?!\w)|(?P<own>[0-9]+)|(?P<dot>(?:{DOT})(?!\w))|(?P<dash>(?:{DASH})(?!\w))|(?P<plus>(?:{PLUS})(?!\w))|(?P<sign>[-.])|(?P<gap>[ \t,]+)", re.I)
BRACKETED = re.compile(rf"(?:(?<!\s)\s+)?[\[({{<]\s*(?:(?P<at>{AT}|@)|(?P<dot>{DOT}|\.))\s*[\])}}>]\s*", re.I)
_DOTS = rf"[ \t]+(?:{DOT})[ \t]+"
#: Bare words count only together: something "at" something "dot" something. From the "at" on; what is before it is read backwards, in the mirrored text.
BARE = re.compile(rf"(?<=[a-z0-9_%+-])[ \t]+(?:{AT})[ \t]+[a-z0-9-]+(?:\.[a-z0-9-]+)*{_DOTS}[a-z0-9-]+(?:(?:{_DOTS}|\.)[a-z0-9-]+)*", re.I)
_MIRRORED = "|".join(w[::-1] for w in DOT.split("|"))
BEFORE = re.compile(rf"[a-z0-9_%+-]+(?:(?:[ \t]+(?:{_MIRRORED})[ \t]+|\.)[a-z0-9_%+-]+)*(?![\w.%+-])", re.I)
#: The same where one of the two is a sign.
MIXED = re.compile(rf"(?<![\w.%+-])[a-z0-9._%+-]+[ \t]*@[ \t]*[a-z0-9-]+(?:\.[a-z0-9-]+)*(?:{_DOTS}[a-z0-9-]+)+", re.I)
_WORD_SIGN = re.compile(rf"[ \t]+(?:(?P<at>{AT})|(?P<dot>{DOT}))[ \t]+|[ \t]*(?P<sign>@)[ \t]*", re.I)
_NO_LABEL = re.compile(r"[^A-Za-z0-9-]")
#: Blanks about signs are disguises only where another one is. From the name's last character on.
SPACED = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:[ \t]+@[ \t]*|@[ \t]+)[A-Za-z0-9-]+(?:[ \t]*\.[ \t]*[A-Za-z0-9-]+)+")
BLANKS = re.compile(r"[ \t]+")


#: What BARE, MIXED and SPELLED with dots all hold.
DOTTED = re.compile(rf"[ \t](?:{DOT})[ \t]", re.I)
WORD_BORDER = re.compile(r"\W+")


def _lower(text: str) -> str:
    """Lower case in which a dotted capital I, which the patterns take for an i, is one."""
    return text.replace("\u0130", "i").lower()


class Mapped:
    """A text in which each character stands for source characters from start to end; changed marks those that a transducer wrote."""

    def __init__(self, text: str):
        self.text, self.start, self.changed = text, np.arange(len(text)), np.zeros(len(text), bool)
        self.end = self.start + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """The text with each place from a to b, in order, written as given; all characters written stand for the whole place."""
        if not edits:
            return self
        out, text, at, gone = Mapped(""), [], 0, False
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            if gone and a > at:  # where characters went, what follows counts as changed
                self.changed[at] = True
            text += [self.text[at:a], new]
            gone = not new if a > at or new else gone
            at = b
        out.text = "".join(text)
        cut = np.array([(a, b, len(new)) for a, b, new in edits], np.int64)
        # Kept stretches and edits by turns: where each begins in the old text, and how much of the new one it gives
        begin = np.stack([np.concatenate([[0], cut[:, 1]]), np.concatenate([cut[:, 0], [len(self.text)]])], axis=1).ravel()[:-1]
        given = np.stack([np.concatenate([cut[:, 0], [len(self.text)]]) - begin[::2], np.concatenate([cut[:, 2], [0]])], axis=1).ravel()[:-1]
        of = np.repeat(np.arange(len(given)), given)
        kept = of % 2 == 0
        at = begin[of] + np.where(kept, np.arange(len(of)) - (np.cumsum(given) - given)[of], 0)
        until = np.where(kept, at, np.concatenate([cut[:, 1], [0]])[of // 2] - 1)
        out.start, out.end, out.changed = self.start[at], self.end[until], ~kept | self.changed[at]
        return out


def _plain_letter(c: str) -> str | None:
    """The ASCII form of an odd character; None where it has none."""
    if c in INVISIBLE:
        return ""
    form = LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
    if len(form) == 1 and not form.isascii() and form.isdigit():
        form = str(unicodedata.digit(form))
    return form if len(form) == 1 and form.isascii() and form.isprintable() else None


def _odd() -> re.Pattern:
    """All characters that _plain_letter maps, as ranges, and whole planes beyond U+FFFF, where many ranges are slow to search; what it doesn't map stays."""
    codes = [k for k in range(0x80, 0x10000) if _plain_letter(chr(k)) is not None]
    edges = [k for k in range(len(codes)) if k == 0 or codes[k] != codes[k - 1] + 1]
    ranges = [f"{chr(codes[a])}-{chr(codes[b - 1])}" for a, b in zip(edges, [*edges[1:], len(codes)], strict=True)]
    return re.compile(f"[{''.join(ranges)}\U00010000-\U0010ffff]")


#: What the first transducer looks at: invisible characters, look-alikes, digits of other scripts, and compatibility forms.
ODD = _odd()


def look_alikes(m: Mapped) -> Mapped:
    return m.rewrite([(x.start(), x.end(), new) for x in ODD.finditer(m.text) if (new := _plain_letter(x.group())) is not None])


def spelled_digits(m: Mapped) -> Mapped:
    edits = []
    for run in SPELLED.finditer(m.text):
        units = [x.lastgroup for x in _UNIT.finditer(m.text, *run.span())]
        if units.count("digit") < 3 and units.count("dot") < 3:
            continue
        for x in _UNIT.finditer(m.text, *run.span()):
            new = DIGITS[_lower(x["digit"])] if x["digit"] else "." if x["dot"] else "-" if x["dash"] else "+" if x["plus"] else "" if x["gap"] else None
            if new is not None:
                edits.append((*x.span(), new))
    return m.rewrite(edits)


def _bare(text: str) -> Iterator[tuple[int, int]]:
    """Addresses of bare words."""
    mirrored, last = None, 0
    for x in BARE.finditer(text):
        mirrored = text[::-1] if mirrored is None else mirrored
        before = BEFORE.match(mirrored, len(text) - x.start(), len(text) - last)
        if before:
            yield len(text) - before.end(), x.end()
            last = x.end()


def _spaced(text: str) -> Iterator[tuple[int, int, int]]:
    """Addresses with blanks about their signs: start, where the name ends, end."""
    last = 0
    for x in SPACED.finditer(text):
        start = x.start()
        while start > last and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        yield start, x.start(), x.end()
        last = x.end()


def signs(m: Mapped) -> Mapped:
    m = m.rewrite([(x.start(), x.end(), "@" if x["at"] else ".") for x in BRACKETED.finditer(m.text)])
    edits, last = [], 0
    for a, b in sorted([*_bare(m.text), *(x.span() for x in MIXED.finditer(m.text))], key=lambda s: (s[0], -s[1])):
        if a >= last and _NO_LABEL.split(m.text[max(a, b - 8) : b])[-1].lower() in ENDINGS:
            edits += [(x.start(), x.end(), "." if x["dot"] else "@") for x in _WORD_SIGN.finditer(m.text, a, b)]
            last = b
    m = m.rewrite(edits)
    return m.rewrite([(*y.span(), "") for a, at, b in _spaced(m.text) if m.changed[a:b].any() for y in BLANKS.finditer(m.text, at, b)])


def _suspect(text: str) -> bool:
    """Whether a disguise may be there at all: what each transducer needs for its first edit, by its own patterns. What it lets through is only looked at more closely."""
    return bool(
        ODD.search(text)
        or BRACKETED.search(text)
        or DOTTED.search(text)
        or sum(map(DIGITS.__contains__, WORD_BORDER.split(_lower(text)))) >= 3  # a spelled digit of a run is a word of its own
    )


def disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not _suspect(text):
        return []
    m = signs(spelled_digits(look_alikes(Mapped(text))))
    if not m.changed.any():
        return []
    own = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}  # of a kind, in order and apart from each other
    starts = {k: [a for a, _ in x] for k, x in own.items()}
    out = []
    for kind, a, b in plain(m.text):
        if m.changed[a:b].any():
            lo, hi = int(m.start[a]), int(m.end[b - 1])
            before = bisect_right(starts[kind], lo) - 1
            if before < 0 or own[kind][before][1] < hi:
                out.append((kind, lo, hi))
    return out


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and all."""
    base = plain(text)
    return base, sorted(base + disguised(text, base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span, or what overlapping ones cover, replaced by the first one's kind."""
    out, at, until = [], 0, 0
    for kind, a, b in found:
        if a >= until:
            out += [text[at:a], f"<{kind.upper()}>"]
        until = at = max(until, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of all spans), base_sha256, spans, n_spans, n_added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in batches:
            rows = []
            for text in b["text"]:
                base, found = spans(text or "")
                rows.append((*(sum(k == kind for k, _, _ in found) for kind in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(found), len(found), len(found) - len(base)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added"])
            out.insert(0, "doc_id", pd.array(b["doc_id"], "Int64"))
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of text replaced by their kinds; null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in batches:
            yield b.assign(text=[None if t is None else redacted(t, spans(t)[1]) for t in b["text"]])[names]

    return docs.mapInPandas(run, docs.schema)
