"""Exports: rows with attribution, citation blocks, documents as text with headings, provenance of an export, and an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.identity import file_name
from docket.functions.text import neutral, strip_controls

UNKNOWN_DATE = "data nieznana"


#: The columns of an export's table, and the fields of a record that they take; the others are named where they are made.
COLUMNS = {
    "sygnatura": "sygnatura_glowna", "sygnatury": "sygnatury", "data_wydania": "data_wydania", "data_rozprawy": "data_rozprawy", "rodzaj": "rodzaj", "rozstrzygniecie": "rozstrzygniecie", "rozstrzygniecie_surowe": "rozstrzygniecie_surowe",
    "przewodniczacy": "przewodniczacy", "odwolujacy": "odwolujacy", "zamawiajacy": "zamawiajacy", "przepisy": "przepisy", "koszty": "koszty", "organ": None, "atrybucja": None, "kanal": None, "slug": "source_ref", "url_zrodla": "url_zrodla",
    "doc_id": "doc_id", "sha256": "sha256", "pobrano": None, "dlugosc_tresci": None,
}
ORGAN = "Krajowa Izba Odwoławcza"


def full_rows(records: DataFrame, channel: str, fetched: Column, attribution: str) -> DataFrame:
    """All columns of an export's table, of decoded records with doc_id and sha256."""
    made = {"organ": F.lit(ORGAN), "atrybucja": F.lit(attribution), "kanal": F.lit(channel), "pobrano": fetched, "dlugosc_tresci": F.length("tresc")}
    rows = records.withColumns({f"_{name}": made[name] for name, of in COLUMNS.items() if of is None})
    return cells(rows, {name: of or f"_{name}" for name, of in COLUMNS.items()}, {})


def cells(df: DataFrame, columns: dict[str, str], constants: dict[str, str]) -> DataFrame:
    """A flat row for a table: lists joined by "; ", text cleaned and made harmless, and constant columns such as the attribution. columns: name in the table by name in df."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        if kinds[c].startswith("array"):
            return neutral(F.array_join(c, "; "))
        return neutral(F.col(c)) if kinds[c] == "string" else F.col(c)

    return df.select(*[cell(c).alias(name) for name, c in columns.items()], *[F.lit(v).alias(k) for k, v in constants.items()])


def write_csv(rows: DataFrame, path: str) -> None:
    """Semicolons, a header, nulls as empty cells. Spark writes no byte-order mark."""
    rows.write.mode("errorifexists").option("header", True).option("sep", ";").option("nullValue", "").option("emptyValue", "").csv(path)


def citation_block(kind: Column, date: Column, numbers: Column, organ: str, source: Column, sha256: Column, fetched: Column, licence: str) -> Column:
    """How to cite a document: what, when, which case, whose, from where, and which version."""
    first = F.concat(F.upper(F.left(kind, F.lit(1))), F.substr(kind, F.lit(2)))
    head = F.concat_ws(" ", F.coalesce(first, F.lit("Orzeczenie")), F.lit(organ), F.coalesce(F.concat(F.lit("z dnia "), date), F.lit(f"({UNKNOWN_DATE})")))
    return F.concat_ws("; ", F.concat_ws(", ", head, F.array_join(numbers, ", ")), F.concat(F.lit("źródło: "), source), F.concat(F.lit("wersja "), F.substring(sha256, 1, 12)), F.concat(F.lit("pobrano "), fetched), F.lit(licence))


def jsonl(df: DataFrame, block: Column, raw: str) -> DataFrame:
    """value: a JSON line for each document with its identity, citation block and raw record."""
    return df.select(F.to_json(F.struct("doc_id", block.alias("citation"), F.col(raw).alias("record"))).alias("value"))


def markdown(df: DataFrame, title: Column, block: Column, body: Column, appendix: Column, ref: Column) -> DataFrame:
    """file, value: a document of its own for each row: front matter, citation, text, appendix."""
    front = F.concat(F.lit("---\ntitle: "), strip_controls(title), F.lit("\n---\n\n> "), block, F.lit("\n\n"))
    return df.select(F.concat(file_name(ref), F.lit(".md")).alias("file"), F.concat(front, strip_controls(body), F.coalesce(appendix, F.lit(""))).alias("value"))


def in_buckets(rows: DataFrame, n: int = 64) -> DataFrame:
    """Documents of an export with the bucket of their file name, by which they are written to folders."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(n)).cast("int")).repartition(n, "bucket")


def index(df: DataFrame, ref: str, number: str, date: str, outcome: str) -> DataFrame:
    """file, number, date, outcome of each exported document, unknown dates named as such."""
    return df.select(F.concat(file_name(F.col(ref)), F.lit(".md")).alias("file"), F.col(number).alias("number"), F.coalesce(date, F.lit(UNKNOWN_DATE)).alias("date"), F.coalesce(outcome, F.lit("")).alias("outcome"))


def dictionary(df: DataFrame, described: dict[str, str]) -> DataFrame:
    """position, column, type, description of the columns of an export, and of how many rows each holds something."""
    kinds = dict(df.dtypes)
    holds = lambda c: F.col(c).isNotNull() & (F.col(c) != "" if kinds[c] == "string" else F.lit(True))
    wide = df.agg(F.count("*").alias("_rows"), *[F.count_if(holds(c)).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("type"), F.lit(described.get(n, "")).alias("description"), F.col(f"_{i}").alias("filled"), F.col("_rows").alias("rows")) for i, (n, t) in enumerate(df.dtypes)]
    return wide.select(F.inline(F.array(*rows)))


def provenance(exported: DataFrame, runs: DataFrame, corpus: DataFrame, criteria: str, channel: str, requests: DataFrame, covered: DataFrame, version: str) -> DataFrame:
    """key, value: what an export is made of: criteria, runs, their time and requests, documents that they covered and fetched (covered: nowy), that are exported and in the corpus, the
    parse versions (version: a column of exported) and the channels."""
    ran = runs.agg(F.count("*").alias("runs"), F.min("started").alias("started"), F.max("finished").alias("finished"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ", ")
    sizes = exported.agg(F.count("*").alias("exported"), listed(channel).alias("channels"), listed(version).alias("versions"))
    parts = (sizes, corpus.agg(F.count("*").alias("corpus")), requests.agg(F.count("*").alias("requests")), covered.agg(F.count("*").alias("covered"), F.count_if("nowy").alias("fetched")))
    wide = ran
    for one_row in parts:
        wide = wide.join(F.broadcast(one_row))
    wide = wide.withColumn("criteria", F.lit(criteria))
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in wide.columns])))


def appendix(citations: DataFrame, provisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, appendix: the case numbers that a text cites and the provisions that it names, with how often, in the order of their first places; both from the text alone."""
    cited = citations.filter(F.col("canon").isNotNull()).select(key, F.lit(0).alias("part"), F.col("canon").alias("name"), "start")
    named = provisions.filter(F.col("source") == "tresc").select(key, F.lit(1).alias("part"), F.col("form").alias("name"), "start")
    forms = cited.unionByName(named).groupBy(key, "part", "name").agg(F.count("*").alias("n"), F.min("start").alias("at"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "name", "n"))), lambda x: F.concat(F.lit("- "), x["name"], F.lit(" ×"), x["n"].cast("string")))
    return forms.groupBy(key).agg(F.array_join(line, "\n").alias("appendix"))


def write_if_any(rows: DataFrame, write) -> bool:
    """Writes rows by a function of them, unless there are none; whether there were."""
    if rows.isEmpty():
        return False
    write(rows)
    return True
