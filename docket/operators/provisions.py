"""Provisions of statutes that rulings name, in the text and in the channel's list; both are read in Python, over Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions import reading
from docket.functions.text import each

ACTS = ("pzp2004", "pzp2019", "kc", "kpc", "rozporzadzenie", "inne", "nieustalone")
TYPES = {"ord": "int", "source": "string", "form": "string", "act": "string", "raw": "string", "start": "int", "end": "int"}
_FIELDS = ("form", "act", "raw", "start", "end")


def named(text: Column, listed: Column | None = None, found: Column | None = None, in_text: bool = True, fields: tuple[str, ...] = tuple(TYPES)) -> Column:
    """An array of structs of the provisions in all sections of a text, in order, and behind them those of a channel's list, without offsets; ord counts each source on its own.
    found: the spans of the sections, where they are known already."""
    view, spans, act, even, views, provisions, entries, shaped = reading.view, reading.spans, reading.document_act, reading._even, reading.section_views, reading.provisions, reading.listed, reading.nested
    names, has_list, has_spans = list(TYPES), listed is not None, found is not None
    types = {n: pa.int32() if TYPES[n] == "int" else pa.string() for n in fields}
    at = [names.index(n) for n in fields]

    def one(text: str | None, known: list | None, told: list | None) -> list:
        seen, origin = view(text) if text is not None else ("", None)
        own, out = act(seen), []
        if in_text and text is not None:
            cut = spans(text, seen, origin) if known is None else [(s["kind"], s["start"], s["end"]) for s in known]
            out += [(i, "tresc", *p) for i, p in enumerate(provisions(text, views(text, cut, even(text)), own))]
        if told is not None:
            out += [(i, "kanal", *p) for i, p in enumerate(entries(told, own))]
        return [tuple(p[k] for k in at) for p in out]

    def read(*columns: pa.Array) -> pa.Array:
        texts, *more = (c.to_pylist() for c in columns)
        nothing = [None] * len(texts)
        told = more.pop() if has_list else nothing
        known = more.pop() if has_spans else nothing
        return shaped([one(*row) for row in zip(texts, known, told, strict=True)], types)

    shape = ",".join(f"{n}:{TYPES[n]}" for n in fields)
    given = [c for c in (text, found, listed) if c is not None]
    return F.arrow_udf(read, f"array<struct<{shape}>>", F.ArrowUDFType.SCALAR)(*given)


def _rows(docs: DataFrame, key: str, found: Column) -> DataFrame:
    return each(docs, [key], found, "_p", "_at").select(key, "_p.ord", "_p.source", *[F.col(f"_p.{f}") for f in _FIELDS])


def from_text(docs: DataFrame, text: str = "text", key: str = "doc_id", found: str | None = None) -> DataFrame:
    """key, ord, source, form, act, raw, start, end of the provisions in all sections, in one pass over each text. found: a column that holds the spans of the sections already."""
    return _rows(docs, key, named(F.col(text), found=F.col(found) if found else None))


def from_channel(docs: DataFrame, listed: str = "przepisy", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The same from the channel's list, in its order, by the same grammar and without offsets. An entry that the grammar doesn't know stays as it is."""
    return _rows(docs, key, named(F.col(text), F.col(listed), in_text=False))


def from_both(docs: DataFrame, listed: str = "przepisy", text: str = "text", key: str = "doc_id") -> DataFrame:
    """from_text and from_channel, from one view of each text."""
    return _rows(docs, key, named(F.col(text), F.col(listed)))


def collapsed(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, source, form, act, n: forms with how often they occur."""
    return rows.groupBy(key, "source", "form", "act").agg(F.count("*").alias("n"))


def by_source(rows: DataFrame) -> DataFrame:
    """source, act, n."""
    return rows.groupBy("source", "act").agg(F.count("*").alias("n"))


def containment(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: distinct forms of documents in the channel's list, in the text and in both, summed over documents, and the two shares."""
    forms = rows.groupBy(key, "form").agg(F.max((F.col("source") == "kanal").cast("int")).alias("c"), F.max((F.col("source") == "tresc").cast("int")).alias("t"))
    sums = forms.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for n, x in (("channel", F.col("c")), ("text", F.col("t")), ("both", F.col("c") * F.col("t")))])
    return sums.withColumns({"in_text": F.col("both") / F.nullif("channel", F.lit(0)), "in_channel": F.col("both") / F.nullif("text", F.lit(0))})
