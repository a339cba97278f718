"""Texts of rulings composed from orders, their lines and customers, and queries over them. The composition is SQL that both engines run, so the expected extraction follows from columns.

The last digit of an order's key decides the shape of its ruling: 1 a heading of spaced letters, 2 a repeated case number instead of a heading, 3 neither, so that the reasons begin below
the signature, 4 a dissent, 5 sentences broken over lines and pages, 6 no appeal instruction, 7 no header, and numbers of other courts, 8 announced numbers that can't be read, or bare
ones, and an operative part of spaced letters, 9 a heading glued to the signature's dots, 0 none of these.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.functions.identity import chamber_numbers, vintage
from docket.functions.text import n_tokens, record
from docket.operators import citations, postings, provisions, sections
from docket.operators.postings import Index
from docket.sources.tables import stored_once, table

#: Pieces of a ruling as SQL over the columns of an order (shape, o_orderkey, yy, day, c_name, o_custkey, body).
_OWN = "'KIO ' || CAST(o_orderkey % 99999 + 1 AS STRING) || '/' || yy"
_HEAD = (
    f"CASE WHEN shape = 7 THEN '' ELSE 'Sygn. akt: ' || {_OWN} || chr(10) || 'WYROK' || chr(10) || 'z dnia ' || day || ' r.' || chr(10) END"
    " || 'Krajowa Izba Odwoławcza, odwołujący: ' || c_name || ', po rozpoznaniu na rozprawie '"
)
_SIGNED = "'Przewodnicząca: ………' || CASE WHEN shape = 9 THEN '' ELSE chr(10) END"
_RULING = f"CASE WHEN shape = 8 THEN 'po stana wia:' ELSE 'orzeka:' END || chr(10) || '1. oddala odwołanie;' || chr(10) || '2. kosztami obciąża odwołującego.' || chr(10) || CASE WHEN shape = 6 THEN {_SIGNED} ELSE '' END"
_APPEAL = f"CASE WHEN shape = 6 THEN '' ELSE 'Stosownie do art. 579 ust. 1 ustawy z dnia 11 września 2019 r. Prawo zamówień publicznych na niniejszy wyrok przysługuje skarga.' || chr(10) || {_SIGNED} END"
_TITLE = f"CASE shape WHEN 1 THEN 'Uz as adnienie' || chr(10) WHEN 2 THEN 'Sygn. akt: ' || {_OWN} || chr(10) WHEN 3 THEN '' ELSE 'Uzasadnienie' || chr(10) END"
_CLOSING = "' Izba podziela te poglądy i oddala odwołanie w całości, ponieważ zarzuty nie znalazły potwierdzenia w zebranym materiale, a koszty ponosi odwołujący zgodnie z wynikiem sprawy.'"
_UNREAD, _BARE = "'sygn. akt nieznana'", "'77/' || yy"
_MORE = f"CASE shape WHEN 8 THEN ' Por. także ' || {_UNREAD} || ', oraz sygn. akt ' || {_BARE} || '.' WHEN 4 THEN chr(10) ELSE '' END"
_AGAINST = "'KIO ' || CAST(o_custkey % 9999 + 1 AS STRING) || '/' || yy"
_DISSENT = f"CASE WHEN shape = 4 THEN 'Zdanie odrębne' || chr(10) || 'Nie podzielam tego stanowiska, por. wyrok ' || {_AGAINST} || '.' ELSE '' END"
_TEXT = f"{_HEAD} || {_RULING} || {_APPEAL} || {_TITLE} || body || {_CLOSING} || {_MORE} || {_DISSENT}"
#: One sentence for each line of an order: a citation and a provision.
_FAMILY = "CASE WHEN shape <> 7 THEN 0 ELSE l_linenumber % 5 END"
_SMALL = "CAST(l_partkey % 1000 + 1 AS STRING)"
_CITED = f"CASE {_FAMILY} WHEN 0 THEN 'KIO ' || CAST(l_partkey AS STRING) WHEN 1 THEN 'II CSK ' || CAST(l_partkey AS STRING) WHEN 2 THEN 'II SA/Wa ' || CAST(l_partkey AS STRING) WHEN 3 THEN 'C-' || {_SMALL} ELSE 'UZP/ZO/0-' || {_SMALL} END || '/' || yy"
#: A chamber's number has at most five digits and a court's six; a longer one, as large tables have, is no case number and has no kind.
_COURT = f"CASE {_FAMILY} WHEN 0 THEN CASE WHEN l_partkey <= 99999 THEN 'kio' END WHEN 1 THEN CASE WHEN l_partkey <= 999999 THEN 'sn' END WHEN 2 THEN CASE WHEN l_partkey <= 999999 THEN 'wsa' END WHEN 3 THEN 'tsue' ELSE 'uzp_zo' END"
_LEAD = "'Tak orzekła Izba' || CASE WHEN shape = 5 THEN chr(10) || chr(12) ELSE ' ' END || 'w sprawie '"
_FORM = "'art. ' || CAST(l_suppkey AS STRING) || ' ust. ' || CAST(l_linenumber AS STRING) || CASE WHEN l_linenumber % 4 = 3 THEN ' pkt 5 lit. b' ELSE '' END"
_STATUTE = "CASE l_linenumber % 3 WHEN 0 THEN 'ustawy Pzp' WHEN 1 THEN 'kodeksu cywilnego' ELSE 'Kodeksu postępowania cywilnego' END"
_ACT = "CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN shape = 6 THEN 'nieustalone' ELSE 'pzp2019' END WHEN 1 THEN 'kc' ELSE 'kpc' END"
_SENTENCE = f"{_LEAD} || {_CITED} || ', na podstawie ' || {_FORM} || ' ' || {_STATUTE} || '.'"

#: Composed as it stands by DuckDB; Spark differs in how it joins the sentences in order.
DUCKDB = f"""
WITH years AS (SELECT o_orderkey, o_custkey, CAST(o_orderkey % 10 AS INT) AS shape, substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 3, 2) AS yy, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM orders),
spread AS (
  SELECT *, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, shape, yy, {_CITED} AS canon, {_COURT} AS kind, {_LEAD} AS lead_in, {_FORM} AS form, {_ACT} AS act, {_SENTENCE} AS sentence
    FROM lineitem JOIN years ON o_orderkey = l_orderkey)),
bodies AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS body, count(*) AS n_lines FROM spread GROUP BY doc_id),
rulings AS (
  SELECT doc_id, shape, yy, n_lines, {_OWN} AS own, {_HEAD} AS head, {_RULING} AS ruling, {_APPEAL} AS appeal, {_TITLE} AS title, {_TITLE} || body || {_CLOSING} || {_MORE} AS reasons, {_DISSENT} AS dissent,
    {_TEXT} AS text, length({_HEAD} || {_RULING} || {_APPEAL}) AS spot, length(body || {_CLOSING}) AS told, {_AGAINST} AS against
  FROM years JOIN customer ON c_custkey = o_custkey JOIN bodies ON doc_id = o_orderkey),
found AS (
  SELECT s.doc_id, spot + length(title) + before + length(lead_in) AS a, length(canon) AS l, canon AS raw, s.kind, canon FROM spread s JOIN rulings USING (doc_id) WHERE s.kind IS NOT NULL
  UNION ALL SELECT doc_id, spot + length(title) + told + length(' Por. także '), length({_UNREAD}), {_UNREAD}, 'inne', NULL FROM rulings WHERE shape = 8
  UNION ALL SELECT doc_id, spot + length(title) + told + length(' Por. także ' || {_UNREAD} || ', oraz sygn. akt '), length({_BARE}), {_BARE}, 'kio_bez_repertorium', 'KIO ' || {_BARE} FROM rulings WHERE shape = 8
  UNION ALL SELECT doc_id, spot + length(reasons) + length('Zdanie odrębne' || chr(10) || 'Nie podzielam tego stanowiska, por. wyrok '), length(against), against, 'kio', against FROM rulings WHERE shape = 4),
cites AS (SELECT f.*, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS ord FROM found f JOIN rulings USING (doc_id) WHERE NOT (kind = 'kio' AND canon = own)),
cut AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS ord, substring(text, (a + 1)::BIGINT, (b - a)::BIGINT) AS part FROM (
    SELECT doc_id, text, CASE WHEN shape = 7 THEN 'nieprzypisane' ELSE 'naglowek' END AS kind, 0 AS a, length(head) AS b FROM rulings
    UNION ALL SELECT doc_id, text, 'sentencja', length(head), length(head || ruling) FROM rulings
    UNION ALL SELECT doc_id, text, 'pouczenie', length(head || ruling), spot FROM rulings WHERE appeal <> ''
    UNION ALL SELECT doc_id, text, 'uzasadnienie', spot, spot + length(reasons) FROM rulings
    UNION ALL SELECT doc_id, text, 'zdanie_odrebne', spot + length(reasons), length(text) FROM rulings WHERE dissent <> '')),
forms AS (
  SELECT doc_id, 'tresc' AS source, form, act FROM spread
  UNION ALL SELECT doc_id, 'tresc', 'art. 579 ust. 1', 'pzp2019' FROM rulings WHERE appeal <> ''
  UNION ALL SELECT doc_id, 'kanal', form, 'nieustalone' FROM spread)
""".replace("AS STRING", "AS VARCHAR")


def compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, yy, number, text, listed: a ruling for each order with lines; number is its own case number, listed what a channel would list of its provisions."""
    return composed(spark, sf_dir).select("doc_id", "yy", "number", "listed", "text")


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compose with the day of issue and what the pieces hold: shape, sizes of the pieces, and in order of the lines sentences as lead, canon, kind, form, act, size."""
    orders, lines, customer = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    years = orders.selectExpr("o_orderkey", "o_custkey", "cast(o_orderkey % 10 as int) as shape", "substring(cast(cast(o_orderdate as date) as string), 3, 2) as yy", "cast(cast(o_orderdate as date) as string) as day")
    named = years.join(customer.select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    # As many tasks as the session names: the keys are few bytes, by which Spark would leave few tasks, but texts are long to make and to read
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    # Keys alone are shuffled; sentences and texts are made where they have met
    each = lambda x: "transform(lines, l -> " + re.sub(r"\bl_(linenumber|partkey|suppkey)\b", r"l.l_\1", x) + ")"
    told = f"struct(l_linenumber, l_partkey, l_suppkey, {_SENTENCE} as sentence, length({_LEAD}) as lead_in, {_CITED} as canon, {_COURT} as kind, {_FORM} as form, {_ACT} as act)"
    rows = named.repartition(n, "o_orderkey").join(keys, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("*", f"{each(told)} as told", f"{each(_FORM)} as listed", f"array_join({each(_SENTENCE)}, ' ') as body")
    sizes = [f"length({x}) as {n}" for x, n in ((_HEAD, "n_head"), (_RULING, "n_ruling"), (_APPEAL, "n_appeal"), (_TITLE, "n_title"), (_MORE, "n_more"), (_DISSENT, "n_dissent"), (f"body || {_CLOSING}", "n_told"))]
    return rows.selectExpr("o_orderkey as doc_id", "shape", "yy", "day", f"{_OWN} as number", f"{_AGAINST} as against", "told", *sizes, "listed", f"{_TEXT} as text")


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number of compose, from orders, customers and lines without a text."""
    orders, lines, customer = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    rows = orders.join(customer.select("c_custkey"), F.col("c_custkey") == F.col("o_custkey")).join(lines.select("l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return rows.selectExpr("o_orderkey", "substring(cast(cast(o_orderdate as date) as string), 3, 2) as yy").selectExpr("o_orderkey as doc_id", f"{_OWN} as number")


def sections_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.segment(compose(spark, sf_dir)).select("doc_id", "ord", "kind", "start", "end", "sha256")


def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.section_coverage(sections.segment(compose(spark, sf_dir)))


def split_text_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dissents are left out of the sections, so their text comes as a gap."""
    docs = sections.with_spans(compose(spark, sf_dir))
    known = F.transform(F.filter("spans", lambda s: s["kind"] != "zdanie_odrebne"), lambda s: F.named_struct(F.lit("start"), s["start"], F.lit("end"), s["end"], F.lit("kind"), s["kind"]))
    parts = docs.select("doc_id", sections.split_text(F.col("text"), known).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["part"]), "")
    gaps = F.size(F.filter("p", lambda x: x["kind"].isNull()))
    return parts.select("doc_id", F.size("p").alias("n_parts"), gaps.alias("n_gaps"), F.length(joined).alias("n_chars"), F.sha2(joined, 256).alias("sha256"))


def headed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a heading before each section."""
    docs = sections.with_spans(compose(spark, sf_dir))
    known = F.transform("spans", lambda s: F.named_struct(F.lit("start"), s["start"], F.lit("end"), s["end"], F.lit("kind"), s["kind"]))
    parts = docs.select("doc_id", sections.split_text(F.col("text"), known).alias("p"))
    return parts.select("doc_id", F.sha2(sections.with_headings(F.col("p"), LABELS), 256).alias("sha256"))


def selective_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of all sections, with the text of operative parts and dissents alone."""
    return sections.selective_read(sections.with_spans(compose(spark, sf_dir)), ("sentencja", "zdanie_odrebne"), found="spans").select("doc_id", "ord", "kind", "start", "end", "part")


def citations_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir).select("doc_id", "ord", "start", "end", "raw", "kind", "canon")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.citations(compose(spark, sf_dir).withColumn("own", F.array("number")), own="own")


def citation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.citation_kinds(cited(spark, sf_dir))


def case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compose(spark, sf_dir).select("doc_id", "number", chamber_numbers(F.col("text")).alias("numbers"))
    first = F.get("numbers", F.lit(0))
    return rows.select("doc_id", (first == F.col("number")).alias("own_first"), vintage(F.col("number")).alias("vintage"), F.size("numbers").alias("n_numbers"))


def _provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provisions.from_both(compose(spark, sf_dir), "listed")


def provision_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provisions.collapsed(_provisions(spark, sf_dir))


def statute_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provisions.by_source(_provisions(spark, sf_dir))


def provision_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provisions.containment(_provisions(spark, sf_dir))


def _by_section(spark: SparkSession, sf_dir: str) -> Index:
    """The index of rulings with a field for each section."""

    def build(path: str) -> Index:
        docs = sections.with_spans(compose(spark, sf_dir))
        parts = F.transform("spans", lambda s: record(field=s["kind"], text=F.substr("text", s["start"] + 1, s["end"] - s["start"])))
        covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
        return Index(spark, path).add(postings.fields(docs.withColumns({"chars": F.length("text"), "covered": covered, "in_text": n_tokens(F.col("text"))}), parts, keep=("chars", "covered", "in_text")))

    return stored_once(spark, sf_dir, "sections", build)


def search_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase in the sections of rulings: how often in each, and the best section's rank."""
    index = _by_section(spark, sf_dir)
    rows = postings.by_section(postings.phrase_hits(index, "ustawy"), index)
    return rows.select(F.col("key").alias("doc_id"), "score", F.array_join(F.transform(F.map_entries("sections"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";").alias("sections"))


def section_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index by sections holds of all texts: characters and words, and rulings where they differ."""
    docs = _by_section(spark, sf_dir).live()
    total = lambda c: F.sum(c).cast("long")
    return docs.agg(F.count("*").alias("rulings"), total("covered").alias("chars"), total("size").alias("words"), F.count_if((F.col("covered") != F.col("chars")) | (F.col("size") != F.col("in_text"))).alias("differ"))


LABELS = {"naglowek": "Nagłówek", "sentencja": "Sentencja", "pouczenie": "Pouczenie", "uzasadnienie": "Uzasadnienie"}
QUERIES = {f.__name__: f for f in (
    sections_map, section_coverage, split_text_lossless, headed_text, selective_read, citations_offsets, citation_kinds, case_numbers, provision_forms, statute_by_context, provision_containment, search_sections, section_guard,
)}

_TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> '')"
_TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
ORACLE_SQL = {
    "sections_map": DUCKDB + 'SELECT doc_id, ord, kind, a::INT AS start, b::INT AS "end", sha256(part) AS sha256 FROM cut',
    "section_coverage": DUCKDB + "SELECT " + ", ".join(f"coalesce(sum(CASE WHEN kind = '{k}' THEN b - a END), 0)::BIGINT AS {k}" for k in sections.KINDS) + " FROM cut",
    "split_text_lossless": DUCKDB + "SELECT doc_id, count(*)::INT AS n_parts, count(*) FILTER (kind = 'zdanie_odrebne')::INT AS n_gaps, length(any_value(text))::INT AS n_chars, sha256(any_value(text)) AS sha256 FROM cut GROUP BY doc_id",
    "headed_text": DUCKDB + f"SELECT doc_id, sha256(string_agg('## ' || CASE kind {_TITLES} ELSE kind END || chr(10) || part, '' ORDER BY ord)) AS sha256 FROM cut GROUP BY doc_id",
    "selective_read": DUCKDB + "SELECT doc_id, ord, kind, a::INT AS start, b::INT AS \"end\", CASE WHEN kind IN ('sentencja', 'zdanie_odrebne') THEN part END AS part FROM cut",
    "citations_offsets": DUCKDB + 'SELECT doc_id, ord, a::INT AS start, (a + l)::INT AS "end", raw, kind, canon FROM cites',
    "search_sections": DUCKDB
    + f""", w AS (SELECT doc_id, kind, {_TOKENS.format("part")} AS w FROM cut), m AS (SELECT doc_id, kind, len(w) AS n_words, len(list_filter(w, lambda y: y = 'ustawy')) AS tf FROM w),
    d AS (SELECT doc_id, sum(n_words) AS size FROM m GROUP BY doc_id), st AS (SELECT count(*) AS n, (SELECT count(DISTINCT doc_id) FROM m WHERE tf > 0) AS df, sum(size)::DOUBLE / count(*) AS a FROM d)
    SELECT doc_id, max(round(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * size / a))), 9)) AS score, string_agg(kind || ':' || tf, ';' ORDER BY kind) AS sections
    FROM m JOIN d USING (doc_id), st WHERE tf > 0 GROUP BY doc_id""",
    "section_guard": DUCKDB + f"SELECT count(*) AS rulings, sum(length(text))::BIGINT AS chars, sum(len({_TOKENS.format('text')}))::BIGINT AS words, 0::BIGINT AS differ FROM rulings",
    "citation_kinds": DUCKDB + "SELECT CASE WHEN canon IS NULL THEN 'nierozpoznane' ELSE kind END AS kind, count(*) AS n FROM cites GROUP BY 1",
    "case_numbers": DUCKDB
    + ", every AS (SELECT doc_id, canon AS c FROM spread WHERE kind = 'kio' UNION SELECT doc_id, own FROM rulings WHERE shape <> 7 UNION SELECT doc_id, against FROM rulings WHERE shape = 4), heads AS (SELECT doc_id, CASE WHEN shape = 7 THEN min_by(canon, before) FILTER (spread.kind = 'kio') ELSE any_value(own) END AS first FROM rulings JOIN spread USING (doc_id, shape) GROUP BY doc_id, shape) SELECT doc_id, first = own AS own_first, '20' || yy AS vintage, (SELECT count(*) FROM every e WHERE e.doc_id = rulings.doc_id)::INT AS n_numbers FROM rulings JOIN heads USING (doc_id)",
    "provision_forms": DUCKDB + "SELECT doc_id, source, form, act, count(*) AS n FROM forms GROUP BY ALL",
    "statute_by_context": DUCKDB + "SELECT source, act, count(*) AS n FROM forms GROUP BY ALL",
    "provision_containment": DUCKDB
    + ", f AS (SELECT doc_id, form, max((source = 'kanal')::INT) AS c, max((source = 'tresc')::INT) AS t FROM forms GROUP BY ALL) SELECT sum(c)::BIGINT AS channel, sum(t)::BIGINT AS text, sum(c * t)::BIGINT AS \"both\", sum(c * t) / sum(c)::DOUBLE AS in_text, sum(c * t) / sum(t)::DOUBLE AS in_channel FROM f",
}
