"""Case numbers and document identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import find_all, let, record, without_overlaps

#: The announcement of a case number, and the families of case numbers as they are written.
CHAMBER = r"(?i)(?=[Kk\u212a])\b(KIO\s*/\s*UZP|KIO\s*/\s*KU|KIO\s*/\s*KD|KIO\s*/\s*W|KIO)\s*/?\s*(\d{1,5})\s*/\s*(\d{2}(?:\d{2})?)(?!\d)"
COURT = r"(?=[IVXL])\b([IVXL]{1,6})\s+([A-Z][A-Za-z]{0,4})\s+(\d{1,6})\s*/\s*(\d{2}(?:\d{2})?)(?!\d)"
ADMINISTRATIVE = r"(?=[IVXL])\b([IVXL]{1,6})\s+(SA|GSK)\s*/\s*([A-Za-z]{2})\s+(\d{1,6})\s*/\s*(\d{2}(?:\d{2})?)(?!\d)"
ARBITRATION = r"(?i)(?=[Uu])\bUZP\s*/\s*ZO\s*/\s*0\s*-\s*(\d{1,4})\s*/\s*(\d{2})(?!\d)"
UNION = r"(?=[CT])\b([CT])\s*[-‑–]\s*(\d{1,4})\s*/\s*(\d{2})(?!\d)"
BARE = r"^\s*(\d{1,4})\s*/\s*(\d{2})(?!\d)"
#: Court registers by the court they belong to.
REGISTERS = {
    "sn": ("CSK", "CZP", "CKN", "CK", "CRN", "CR", "CZ", "PK", "PKN", "SK", "PZ", "CKU", "CSR", "UKN"),
    "sa": ("ACa", "AGa", "ACr", "ACz", "AGz"),
    "so": ("Ga", "Zs", "Ca", "GC", "C", "Gz", "Cz", "AmA", "AmZ", "AmR", "Ns"),
    "nsa": ("GSK", "OSK", "FSK", "FPS", "OPS", "GPS"),
}

_U = "(?uUd)"
_REGISTER = {r.lower(): (r, court) for court, names in REGISTERS.items() for r in names}
_part = lambda raw, pattern, k: F.regexp_extract(raw, _U + pattern, k)
_number = lambda c: F.regexp_replace(c, r"^0+(?=\d)", "")
_year = lambda c: F.right(c, F.lit(2))


def _lookup(k: int) -> Column:
    return F.create_map(*[F.lit(x) for r, v in _REGISTER.items() for x in (r, v[k])])


def _chamber(raw: Column) -> tuple[Column, Column]:
    prefix = F.upper(F.regexp_replace(_part(raw, CHAMBER, 1), _U + r"\s+", ""))
    return F.lit("kio"), F.concat(prefix, F.lit(" "), _number(_part(raw, CHAMBER, 2)), F.lit("/"), _year(_part(raw, CHAMBER, 3)))


def _court(raw: Column) -> tuple[Column, Column]:
    own = _part(raw, COURT, 2)
    name = F.coalesce(F.try_element_at(_lookup(0), F.lower(own)), own)
    kind = F.coalesce(F.try_element_at(_lookup(1), F.lower(own)), F.lit("inne"))
    return kind, F.concat(_part(raw, COURT, 1), F.lit(" "), name, F.lit(" "), _number(_part(raw, COURT, 3)), F.lit("/"), _year(_part(raw, COURT, 4)))


def _administrative(raw: Column) -> tuple[Column, Column]:
    of = lambda k: _part(raw, ADMINISTRATIVE, k)
    seat = F.concat(F.upper(F.left(of(3), F.lit(1))), F.lower(F.right(of(3), F.lit(1))))
    return F.when(of(2) == "GSK", "nsa").otherwise("wsa"), F.concat(of(1), F.lit(" "), of(2), F.lit("/"), seat, F.lit(" "), _number(of(4)), F.lit("/"), _year(of(5)))


def _arbitration(raw: Column) -> tuple[Column, Column]:
    return F.lit("uzp_zo"), F.concat(F.lit("UZP/ZO/0-"), _number(_part(raw, ARBITRATION, 1)), F.lit("/"), _part(raw, ARBITRATION, 2))


def _union(raw: Column) -> tuple[Column, Column]:
    return F.lit("tsue"), F.concat(_part(raw, UNION, 1), F.lit("-"), _number(_part(raw, UNION, 2)), F.lit("/"), _part(raw, UNION, 3))


#: What every number of the families but the first has.
OTHERS = r"(?=[CILTUVXu])(?:[IVXL]\s+[A-Z]|[CT]\s*[-‑–]\s*\d|[Uu][Zz][Pp]\s*/)"
FAMILIES = ((CHAMBER, _chamber), (COURT, _court), (ADMINISTRATIVE, _administrative), (ARBITRATION, _arbitration), (UNION, _union))


def _with(f, canon):
    return lambda h: f(h, canon)


def case_numbers(text: Column) -> Column:
    """array<struct<start, end, raw, kind, canon>> of all case numbers of a text, without overlaps."""

    def named(h: Column, canon) -> Column:
        kind, name = canon(h["raw"])
        return record(start=h["start"], end=h["end"], raw=h["raw"], kind=kind, canon=name)

    def families(t: Column) -> Column:
        own, *others = [F.transform(find_all(t, p), _with(named, c)) for p, c in FAMILIES]
        return F.when(t.rlike(_U + OTHERS), F.concat(own, *others)).otherwise(own)

    return let(text, lambda t: without_overlaps(families(t)))


def chamber_number(text: Column) -> Column:
    """The first chamber case number of a text in canonical form, or null."""
    one = F.regexp_replace(F.trim(text), _U + r"\s+", " ")
    hit = F.regexp_extract(one, _U + CHAMBER, 0)
    return F.when(hit != "", _chamber(hit)[1])


def chamber_numbers(text: Column) -> Column:
    """All chamber case numbers of a text, each once, in order."""
    hits = F.regexp_extract_all(F.regexp_replace(text, _U + r"\s+", " "), F.lit(_U + CHAMBER), F.lit(0))
    return F.array_distinct(F.transform(hits, lambda h: _chamber(h)[1]))


def bare_number(rest: Column) -> Column:
    """A number and year that stand right at the start of a text, as a chamber case number; else null."""
    return F.when(rest.rlike(_U + BARE), F.concat(F.lit("KIO "), _number(_part(rest, BARE, 1)), F.lit("/"), _part(rest, BARE, 2)))


def vintage(number: Column) -> Column:
    """The year of a canonical case number, or brak."""
    year = F.regexp_extract(number, r"/(\d{2})$", 1)
    return F.when(year == "", "brak").when(year.isNull(), "brak").otherwise(F.concat(F.lit("20"), year))


def document_id(source: Column, ref: Column, fold_case: bool) -> Column:
    """source:ref, null where either can't name a document. Sources are lower case without blanks or colons; whether refs fold case is the channel's policy."""
    source, ref = F.lower(F.trim(source)), F.trim(ref)
    good = (source != "") & ~source.rlike(r"[\s:]") & (ref != "") & ~ref.rlike(r"[\x00-\x1f\x7f]")
    return F.when(good, F.concat(source, F.lit(":"), F.lower(ref) if fold_case else ref))


def file_name(ref: Column) -> Column:
    """A safe file name from a reference: other characters become one underscore, at most 120 of them."""
    return F.substring(F.regexp_replace(ref, r"[^A-Za-z0-9._-]+", "_"), 1, 120)
