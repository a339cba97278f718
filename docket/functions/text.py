"""Text columns: offsets of pattern matches, overlap resolution, tokens, and clean-up of characters. Offsets are code points, ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode classes and case, and only the line feed ends a line.
FLAGS = "(?uUd)"

#: Polish letters with marks and their plain forms.
MARKED, PLAIN = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ"
#: Other Latin letters with marks, by their plain letters.
OTHER_MARKS = {"a": "àáâãäåāă", "c": "çčĉċ", "d": "ďđ", "e": "èéêëēĕėě", "g": "ğĝġģ", "i": "ìíîïīĭį", "l": "ĺļľ", "n": "ñňņ", "o": "òôõöøōŏő", "r": "ŕřŗ", "s": "šŝş", "t": "ťţ", "u": "ùúûüūŭůűų", "y": "ýÿ", "z": "žẑ"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A character that no text holds by the standard; one that does loses it in the lengths of gaps alone.
CUT = "\uffff"


CHUNK = 512

HITS = "array<struct<start:int,end:int,raw:string>>"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: an expression that is named twice, or inside a lambda, would be evaluated each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def record(**fields: Column) -> Column:
    """A struct with these fields, whose names also hold inside lambdas."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def each(df: DataFrame, columns: list, array: Column, name: str, place: str = "ord") -> DataFrame:
    """columns, place and name of df, a row for each entry of an array. Entries come out of an outer generator: for an inner one Spark would evaluate the array again, to leave out rows
    without entries beforehand."""
    return df.select(*columns, F.posexplode_outer(array).alias(place, name)).filter(F.col(place).isNotNull())


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone, as in a LIKE that folds ASCII only."""
    return F.translate(c, _UPPER, _LOWER)


def contains_folded(c: Column, needle: str) -> Column:
    """Substring test with ASCII case folding. Wildcards are literal characters."""
    return F.contains(ascii_lower(c), F.lit(needle.translate(str.maketrans(_UPPER, _LOWER))))


def fold(c: Column, keep_stroke: bool = False) -> Column:
    """Lower case without diacritics; keep_stroke leaves the Polish ł, which has no decomposition, as full-text tokenizers do."""
    marks = {m: p for p, ms in OTHER_MARKS.items() for m in ms} | {m: p for m, p in zip(MARKED, PLAIN, strict=True) if m.islower()}
    if keep_stroke:
        marks.pop("ł")
    return F.translate(F.lower(c), "".join(marks), "".join(marks.values()))


def tokens(c: Column) -> Column:
    """Words of letters and digits, lower-cased, without diacritics but for ł."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit("")), keep_stroke=True), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def n_tokens(c: Column) -> Column:
    """How many tokens a text has: letters stay letters without their marks, so they are left on."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
    # None but the first and the last can be empty
    return F.size(words) - (F.get(words, F.lit(0)) == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")


BLOCK = 128
_POWERS = [1 << k for k in reversed(range(24))]


def running(sizes: Column) -> Column:
    """0, and the sum of all entries of an array of numbers up to each. Blocks are added up on their own, so that an entry is copied once for each BLOCK entries that follow."""
    append = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    block = lambda xs, acc, k: F.aggregate(F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)), F.slice(acc, -1, 1), append)
    joined = lambda xs: F.aggregate(F.sequence(F.lit(0), (F.size(xs) / BLOCK).cast("int")), F.array(F.lit(0)), lambda acc, k: F.concat(acc, F.slice(block(xs, acc, k), 2, BLOCK)))
    return let(sizes, joined)


def steps(n: Column) -> Column:
    """What count_until halves its way by, for an array of n entries."""
    return F.filter(F.lit(_POWERS), lambda p: p <= n)


def count_until(array: Column, ways: Column, holds) -> Column:
    """How many entries from the first on hold, where all that hold stand before all that don't: a binary search."""
    n = F.size(array)
    return F.aggregate(ways, F.lit(0), lambda at, p: F.when((at + p <= n) & holds(F.get(array, at + p - 1)), at + p).otherwise(at))


def pieces(c: Column, pattern: str, flags: str = FLAGS) -> Column:
    """What lies between matches and the matches, in turn, from one pass over a text without CUT."""
    # A split by a pattern compiles it for every row; a replacement keeps it, and a split by one character needs none
    return F.split(F.regexp_replace(c, F.lit(flags + pattern), F.lit(f"{CUT}$0{CUT}")), CUT, -1)


def find_all(c: Column, pattern: str, flags: str = FLAGS, rest: int = 0) -> Column:
    """array<struct<start, end, raw>> of the matches of a pattern, which must not match nothing. rest: with that many characters that follow each, as rest. Null texts give null."""

    def after(ps: Column, i: Column) -> Column:
        own = F.get(ps, i + 1)
        # The next pieces: a match has two characters at least, as all patterns do that ask for what follows
        more = lambda: F.left(F.array_join(F.transform(F.slice(ps, i + 2, F.lit(rest)), lambda x: F.left(x, F.lit(rest))), ""), F.lit(rest))
        return F.when((F.length(own) >= rest) | (i + 2 >= F.size(ps)), F.left(own, F.lit(rest))).otherwise(more())

    def hits(ps: Column, at: Column) -> Column:
        def hit(k: Column) -> Column:
            i = k * 2 - 1
            more = {"rest": after(ps, i)} if rest else {}
            return record(start=F.get(at, i), end=F.get(at, i + 1), raw=F.get(ps, i), **more)

        return F.transform(F.sequence(F.lit(1), ((F.size(ps) - 1) / 2).cast("int")), hit)

    shape = HITS.replace("raw:string", "raw:string,rest:string") if rest else HITS
    found = lambda ps: F.when(F.size(ps) == 1, F.array().cast(shape)).when(ps.isNotNull(), let(running(F.transform(ps, F.length)), lambda at: hits(ps, at)))
    # Most texts hold no match of most patterns, which a test tells sooner than a cut
    held = lambda t: F.when(t.rlike(flags + pattern), let(pieces(t, pattern, flags), found)).when(t.isNotNull(), F.array().cast(shape))
    return let(F.replace(c, F.lit(CUT), F.lit(" ")), held)


def first_from(text: Column, pattern: str, after: Column, before: Column | None = None, begins: str = "") -> Column:
    """struct<start, end, raw> of the first match that starts at after or later, or null. Only the text until there is looked at; what stands before after is seen by what looks behind.
    before: where the text is taken to end; begins: what takes no character and holds wherever a match begins, tried first as it is cheap."""
    whole = rf"{FLAGS}{begins}(?!\A)(?:{pattern})"

    def cut(tail: Column) -> Column:
        def found(at: Column, raw: Column) -> Column:
            # The place is one in UTF-16, where some characters count twice
            lo = F.length(F.decode(F.substring(F.encode(tail, "UTF-16BE"), F.lit(1), (at - 1) * 2), "UTF-16BE"))
            return let(after + lo - 1, lambda start: record(start=start, end=start + F.length(raw), raw=raw))

        return let(F.regexp_instr(tail, F.lit(whole)), lambda at: F.when(at > 0, let(F.regexp_extract(tail, whole, 0), lambda raw: found(at, raw))))

    text = text if before is None else F.left(text, before)
    return let(F.when(after > 0, F.substr(text, after)).otherwise(F.concat(F.lit("\n"), text)), cut)


def chunks(text: Column) -> Column:
    """A text in parts of CHUNK characters, for reading stretches of it by place."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def stretch(parts: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in chunks, without going through what stands before."""
    first, last = (start / CHUNK).cast("int"), (end / CHUNK).cast("int")
    one = F.coalesce(F.get(parts, first), F.lit(""))
    own = F.when(first == last, one).otherwise(F.array_join(F.slice(parts, first + 1, last - first + 1), ""))
    return F.substr(own, start - first * CHUNK + 1, end - start)


def without_overlaps(hits: Column) -> Column:
    """Of an array of structs with start and end: sorted by start, the longer first; one that begins before the end of the last kept is dropped."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])

    def fold_hits(all_hits: Column) -> Column:
        free = lambda kept, x: F.when((F.size(kept) > 0) & (x["start"] < F.element_at(kept, -1)["end"]), kept).otherwise(F.concat(kept, F.array(x)))
        apart = lambda xs: F.forall(F.zip_with(F.slice(xs, F.lit(2), F.size(xs)), xs, lambda b, a: F.coalesce(b["start"] >= a["end"], F.lit(True))), lambda ok: ok)
        # Most have none: then nothing is copied
        kept = lambda xs: F.when(apart(xs), xs).otherwise(F.aggregate(xs, F.slice(xs, 1, 0), free))
        return let(F.array_sort(all_hits, order), kept)

    return let(hits, fold_hits)


#: Format characters that never belong in an export, by code point.
FORMAT_CHARACTERS = (0x061C, 0x200B, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF)
_CONTROLS = "".join(chr(k) for k in (*range(0x20), 0x7F, *range(0x80, 0xA0), *FORMAT_CHARACTERS) if chr(k) not in "\t\n")


def strip_controls(c: Column) -> Column:
    """Without control characters but tab and line feed, and without direction and zero-width marks."""
    return F.translate(c, _CONTROLS, "")


def neutral(c: Column) -> Column:
    """Cleaned text that no spreadsheet takes for a formula."""
    clean = strip_controls(c)
    return F.when(clean.rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), clean)).otherwise(clean)


def mask(c: Column, secrets: dict[str, str]) -> Column:
    """Known secret values replaced by <name>, the longest first."""
    for value, name in sorted(secrets.items(), key=lambda s: -len(s[0])):
        c = F.replace(c, F.lit(value), F.lit(f"<{name}>")) if value else c
    return c


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """A code's label with the code in brackets; unknown codes stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    label = F.try_element_at(names, code)
    return F.when(label.isNull(), code).otherwise(F.concat(label, F.lit(" ("), code, F.lit(")")))
