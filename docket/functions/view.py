"""The normalised view of a text and the map from its characters back to the original."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FLAGS, count_until, find_all, let, record, running, steps

_BLANKS = " \t\u00a0\u2007\u202f"
_WHITE = f"[{_BLANKS}\f\r\n]"
#: Stretches of white space of which the view has less than the text.
SHORTENED = rf"(?={_WHITE})(?:\A{_WHITE}+|{_WHITE}{{2,}}|[\f\r]|{_WHITE}\z)"
_NO_CAPITAL = r"\n\p{Ll}\p{Lt}\p{Lm}\p{Lo}"
_GOES_ON = r"(?=[\p{Ll}\p{Nd},)–-])"
#: A line of capitals and what may stand between them, before a line that would else go on with it.
HEADING = rf"(?m)^([^{_NO_CAPITAL}]*\p{{Lu}}[^{_NO_CAPITAL}]*\p{{Lu}}[^{_NO_CAPITAL}]*)\n{_GOES_ON}"
JOINED = rf"\n(?<![.:;!?]\n){_GOES_ON}(?![0-9]{{1,3}} ?\.(?![0-9]))"
_KEPT = "\ufffe"  # a line feed that stays; no text holds this character by the standard
#: White space that a view has less of; a text without any of these has at most one blank or line feed too much at each end.
_ODD = ("  ", " \n", "\n ", "\n\n", "\f", "\r", *_BLANKS[1:])


def even(original: Column) -> Column:
    """Whether a text is even, for views of it and of its parts."""
    return _even(original)


def _even(original: Column) -> Column:
    """Whether nothing is shortened but at the ends, from searches for fixed strings, which cost a tenth of the patterns."""
    odd = F.contains(original, F.lit(_ODD[0]))
    for x in _ODD[1:]:
        odd = odd | F.contains(original, F.lit(x))
    return ~odd


def _text(original: Column, even: Column) -> Column:
    lines = F.trim(F.when(even, original).otherwise(_lines(original)), F.lit(" \n"))
    return let(lines, lambda t: F.when(t.rlike(FLAGS + r"\n" + _GOES_ON), _joined(t)).otherwise(t))


def _lines(original: Column) -> Column:
    # Each pattern matches only where it changes something
    bare = F.replace(F.replace(original, F.lit("\f"), F.lit("")), F.lit("\r"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(bare, f"[{_BLANKS}]+\n[{_BLANKS}\n]*|\n[{_BLANKS}\n]+", "\n"), f"[{_BLANKS[1:]}][{_BLANKS}]*| [{_BLANKS}]+", " ")


def _joined(lines: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(lines, FLAGS + HEADING, f"$1{_KEPT}"), FLAGS + JOINED, " "), F.lit(_KEPT), F.lit("\n"))


def _ends(original: Column) -> Column:
    """The moves of an even text: a blank at either end."""
    blank = lambda c: c.isin(" ", "\n").cast("int")
    lead = blank(F.left(original, F.lit(1)))
    tail = F.when(F.length(original) > 1, blank(F.right(original, F.lit(1)))).otherwise(0)
    move = lambda at, shift: record(at=at, kept=F.lit(None).cast("int"), shift=shift)
    return F.concat(F.slice(F.array(move(F.lit(0), F.lit(1))), F.lit(1), lead), F.slice(F.array(move(F.length(original) - 1 - lead, lead + 1)), F.lit(1), tail))


def _moves(original: Column, even: Column) -> Column:
    return F.when(even, _ends(original)).otherwise(_shortened(original))


def _shortened(original: Column) -> Column:
    """array<struct<at, kept, shift>>: of each shortened stretch, where it begins in the view, the place in the original of the character that stays of it (the last line feed, else the first blank;
    at the ends of the text none), and how many characters are gone when it is over."""
    size = F.length(original)

    def stays(h: Column) -> Column:
        inner = (h["start"] > 0) & (h["end"] < size)
        line = F.instr(F.reverse(h["raw"]), "\n")  # from the end, from 1; 0 where there is none
        blank = F.length(F.regexp_extract(h["raw"], r"^[\f\r]*", 0))
        return F.when(inner & (line > 0), h["end"] - line).when(inner & (h["start"] + blank < h["end"]), h["start"] + blank)

    def measured(h: Column) -> Column:
        return let(stays(h), lambda kept: record(start=h["start"], kept=kept, gone=h["end"] - h["start"] - F.when(kept.isNull(), 0).otherwise(1)))

    move = lambda m, before: record(at=m["start"] - before, kept=m["kept"], shift=before + m["gone"])
    return let(F.transform(find_all(original, SHORTENED), measured), lambda ms: F.zip_with(ms, F.slice(running(F.transform(ms, lambda m: m["gone"])), F.lit(1), F.size(ms)), move))


def view(original: Column, even: Column | None = None) -> Column:
    """struct<text, n, size, moves, ways>: text is the view, n its length, size the original's; place() leads back. even: whether the original is known for an even text or a part of one.

    Form feeds and carriage returns go, blanks become one space, lines are trimmed and empty ones skipped. A line is joined to the one before it by a space where that one doesn't end a
    sentence and isn't a heading in capitals, and this one goes on: it starts with a small letter, a digit or one of ,)–- and not with a list number. Otherwise a line feed stays.
    """
    seen = lambda t, even: let(_text(t, even), lambda v: let(_moves(t, even), lambda m: record(text=v, n=F.length(v), size=F.length(t), moves=m, ways=steps(F.size(m)))))
    known = lambda t: _even(t) if even is None else F.when(even, even).otherwise(_even(t))
    return let(original, lambda t: F.when(t.isNotNull(), let(known(t), lambda e: seen(t, e))))


def origin(seen: Column, at: Column) -> Column:
    """The place in the original of a character of the view; of its end, the original's end."""
    moved = lambda m: F.when(m.isNull(), at).when((m["at"] == at) & m["kept"].isNotNull(), m["kept"]).otherwise(at + m["shift"])
    last = F.get(seen["moves"], count_until(seen["moves"], seen["ways"], lambda m: m["at"] <= at) - 1)
    return F.when(at >= seen["n"], seen["size"]).otherwise(let(last, moved))


def place(seen: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The span of the original that a span of the view stands for."""
    lo = origin(seen, start)
    return lo, F.when(start == end, lo).otherwise(origin(seen, end - 1) + 1)
