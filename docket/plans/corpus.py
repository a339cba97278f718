"""Queries of the version ledger, the filter algebra and phrase search over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.operators import filters, ledger, postings, search
from docket.operators.postings import Index
from docket.sources.tables import stored_once, table

PHRASE, TOP = "of the", 20
NEAR, ANY = "that the on", ("of the", "licensed under", "de la")
FIRST, SECOND = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def _loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two loads of all documents; in the second, licence lines read otherwise, so only some contents changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    second = F.replace("text", F.lit("Licensed under"), F.lit("Available under"))
    return ledger.landed(docs, F.col("text"), FIRST, 1), ledger.landed(docs, second, SECOND, 2)


def version_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _loads(spark, sf_dir)
    known = ledger.new_versions(first)
    return known.unionByName(ledger.new_versions(second, known)).select("doc_id", "sha256", "load")


def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _loads(spark, sf_dir)
    both = first.unionByName(second)
    rows = ledger.current(ledger.documents(both), ledger.new_versions(both))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("doc_id", "current_sha256", "version_load", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"))


def replay_is_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _loads(spark, sf_dir)
    known = ledger.new_versions(first.unionByName(second))
    again = ledger.new_versions(second, known)
    return known.agg(F.count("*").alias("versions")).join(F.broadcast(again.agg(F.count("*").alias("added"))))


def incremental_reparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for metadata: those of good quality have the newest parse version."""
    docs = ledger.documents(_loads(spark, sf_dir)[0])
    done = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    metadata = docs.join(done, "doc_id").select("doc_id", F.col("current_sha256").alias("sha256"), (5 + F.col("q")).alias("parse_version"))
    return ledger.stale(docs, metadata, 6).groupBy("parse_version").agg(F.count("*").alias("n"))


def skip_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates; labelled ones are known."""
    rows = ledger.to_fetch(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"))
    return rows.groupBy("source", "nowy").agg(F.count("*").alias("n"))


CRITERIA = filters.Criteria(since="1995-01-01", until="1997-12-31", outcomes=("F", "P"), kinds=("1-URGENT", "2-HIGH"), presiding="customer#", party="build")
_AT = filters.Columns(parties=("party",))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers; pending ones have no date yet."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    date = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return joined.select(F.col("o_orderkey").alias("doc_id"), date.alias("date"), F.col("o_orderstatus").alias("outcome"), F.col("o_orderpriority").alias("kind"), F.col("c_name").alias("presiding"), F.col("c_mktsegment").alias("party"))


def filter_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.matching(_rows(spark, sf_dir), CRITERIA, _AT).select("doc_id", "date", "outcome", "kind")


def undated_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.counts(_rows(spark, sf_dir), CRITERIA, _AT)


def broadening_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.relaxations(_rows(spark, sf_dir), CRITERIA, _AT)


def unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.unknown_values(_rows(spark, sf_dir), "kind", ("1-URGENT", "9-NONE", "2-HIGH", "0-NOW"))


def lookup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer share a case number, which is asked for in another way of writing; the lookup lists them all."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), F.array(F.concat(F.lit("KIO "), F.col("o_custkey").cast("string"), F.lit("/21"))).alias("numbers"))
    return filters.lookup(rows, "kio  00001 / 2021", "doc_id", "numbers").select("doc_id", "n_matches")


def normalised_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values asked for in capitals, with marks and blanks, against columns in the same plain form."""
    asked = filters.Criteria(outcomes=(" F ", "P", "f"), kinds=("1-ÚRGENT", "2-HIGH ")).normalised()
    rows = _rows(spark, sf_dir).withColumns({"outcome": filters.folded("outcome"), "kind": filters.folded("kind")})
    return filters.matching(rows, asked, _AT).groupBy("outcome", "kind").agg(F.count("*").alias("n"))


def corpus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred orders of the corpus, the undated ones before the others."""
    return filters.in_order(_rows(spark, sf_dir), "date").select("doc_id", "date").limit(100)


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """Documents as they are."""

    def build(path: str) -> Index:
        docs = table(spark, sf_dir, "documents")
        return Index(spark, path).add(postings.fields(docs, postings.text_and_numbers("text"), keep=("source", "lang")))

    return stored_once(spark, sf_dir, "documents", build)


def _current(spark: SparkSession, sf_dir: str) -> Index:
    """Current versions: the first load is a segment, and the versions that the second one changed another. Each has a case number; only English documents have a date."""

    def build(path: str) -> Index:
        first, second = _loads(spark, sf_dir)
        facts = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.when(F.col("lang") == "en", F.format_string("2024-%02d-01", (F.col("doc_id") % 12 + 1).cast("int"))).alias("date"))
        numbers = F.array(F.concat(F.lit("KIO "), F.col("doc_id").cast("string"), F.lit("/24")))
        changed = ledger.new_versions(second, ledger.new_versions(first)).select("doc_id", "sha256")
        segments = (first, second.join(changed, ["doc_id", "sha256"], "left_semi"))
        index = Index(spark, path)
        for k, rows in enumerate(segments):
            docs = rows.join(facts, "doc_id").withColumn("numbers", numbers)
            index.add(postings.fields(docs, postings.text_and_numbers("content", "numbers"), keep=("source", "lang", "date")), k)
        return index

    return stored_once(spark, sf_dir, "current", build)


def _hits(index: Index, phrase: str = PHRASE) -> DataFrame:
    return postings.by_document(postings.phrase_hits(index, phrase))


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("key").alias("doc_id"), *more, F.col("size").alias("n_words"), "tf", "score")


WANTED = filters.Criteria(since="2024-03-01", until="2024-10-31")
_DATED = filters.Columns()


def phrase_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return _shown(postings.page(postings.scored(_hits(index), index), TOP))


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page: what comes after the last row of the first."""
    index = _index(spark, sf_dir)
    rows = postings.scored(_hits(index), index)
    last = postings.page(rows, TOP).agg(F.min(F.struct((-F.col("score")).alias("n"), "key")).alias("first"), F.max(F.struct((-F.col("score")).alias("n"), "key")).alias("last")).first()["last"]
    return _shown(postings.page(rows, TOP, last and (-last["n"], last["key"])))


def search_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words with at most ten others among them, in any order."""
    index = _index(spark, sf_dir)
    return _shown(postings.page(postings.scored(postings.by_document(postings.near_hits(index, NEAR, 10)), index), TOP))


def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase whose last word may go on."""
    index = _index(spark, sf_dir)
    return _shown(postings.page(postings.scored(postings.by_document(postings.phrase_hits(index, "of th", prefix=True)), index), TOP))


def search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold any of three phrases: hits of each phrase, of all, and of those that hold more than one."""
    rows = postings.any_of(_index(spark, sf_dir), list(ANY))
    by_phrase = rows.groupBy("phrase").agg(F.count("*").alias("documents"), F.sum("tf").alias("hits"))
    each = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    all_of = each.agg(F.count("*").alias("documents"), F.coalesce(F.sum("tf"), F.lit(0)).alias("hits"))
    more = each.filter("n > 1").agg(F.count("*").alias("documents"), F.coalesce(F.sum("tf"), F.lit(0)).alias("hits"))
    return by_phrase.unionByName(all_of.select(F.lit("any").alias("phrase"), "*")).unionByName(more.select(F.lit("more than one").alias("phrase"), "*"))


def search_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits among current versions that the filters let through, ranked by the statistics of the whole index, with sources and citations."""
    index = _current(spark, sf_dir)
    live = index.live()
    best = postings.page(postings.scored(_hits(index, "available under"), index, live.filter(filters.all_of(WANTED, _DATED)).select("key")), TOP)
    hits = _shown(best.join(live.select("key", "date"), "key"), "date")
    docs = live.select(F.col("key").alias("doc_id"), F.col("source").alias("_source"))
    return search.attached(hits, docs, F.col("_source"), F.concat(F.lit("KIO "), F.col("doc_id").cast("string"), F.lit("/24; "), F.col("_source")))


def search_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase that stands in a case number."""
    index = _current(spark, sf_dir)
    best = postings.page(postings.scored(_hits(index, "KIO 7/24"), index), TOP)
    return _shown(best.join(index.live().select("key", "source"), "key"), "source").drop("n_words")


def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus, index, hits, shown ones, and hits that only lack a date."""
    index = _current(spark, sf_dir)
    found = postings.found(index, _hits(index))
    return search.counts(found, TOP, table(spark, sf_dir, "documents").select("doc_id"), filters.all_of(WANTED, _DATED), "date", filters.all_but_dates(WANTED, _DATED))


def search_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are there without hits, too."""
    index = _index(spark, sf_dir)
    return search.counts(postings.found(index, _hits(index, "no such phrase anywhere")), TOP)


def phrase_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits among English documents, with their sources; ranked by the statistics of all documents."""
    index = _index(spark, sf_dir)
    live = index.live().select("key", "source", "lang")
    best = postings.page(postings.scored(_hits(index), index, live.filter("lang = 'en'").select("key")), TOP)
    return _shown(best.join(live.drop("lang"), "key"), "source")


def phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents that hold the phrase, by label."""
    found = _hits(_index(spark, sf_dir)).select(F.col("key").alias("doc_id"), "tf")
    return filters.by_phrase(table(spark, sf_dir, "labels"), found).groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def search_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits with the stretch of words that holds most of them, and where it stands; only the texts of hits are read on."""
    index = _index(spark, sf_dir)
    hits = postings.phrase_hits(index, PHRASE).filter("field = 'text'")
    best = postings.page(postings.scored(postings.by_document(hits), index), TOP)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(best.join(hits.select("key", "at"), "key").select(F.col("key").alias("doc_id"), "at"), "doc_id")
    window = postings.best_window(F.col("text"), F.array_sort("at"), len(PHRASE.split()))
    return rows.select("doc_id", window.alias("w")).select("doc_id", "w.start", "w.end", "w.excerpt")


def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of licence lines that the second load replaced, before and after the index is compacted: postings on disk, those that a search reads, and documents."""
    index = _current(spark, sf_dir)
    small = stored_once(spark, sf_dir, "compacted", index.compact)
    rows = lambda i: i.read("postings").filter(F.col("term").isin("licensed", "available"))
    count = lambda i, name: rows(i).groupBy("term").agg(F.count("*").alias("on_disk")).join(i.postings(["licensed", "available"]).groupBy("term").agg(F.count("*").alias("read")), "term", "left").withColumn("index", F.lit(name))
    out = count(index, "two segments").unionByName(count(small, "compacted"))
    return out.select("index", "term", "on_disk", F.coalesce("read", F.lit(0)).alias("read"))


QUERIES = {f.__name__: f for f in (
    version_ledger, current_version, replay_is_noop, incremental_reparse, skip_known, filter_algebra, undated_left_out, broadening_counts, unknown_values, lookup_by_key, normalised_filter, corpus_order,
    phrase_search_topk, search_page, search_near, search_prefix, search_any, search_current, search_by_number, search_counts, search_nothing, phrase_search_filtered, phrase_filter, search_excerpts, index_upkeep,
)}

_LOADS = "WITH first AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), second AS (SELECT doc_id, sha256(replace(text, 'Licensed under', 'Available under')) AS sha256 FROM documents) "
_ROWS = """WITH r AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderstatus AS outcome, o_orderpriority AS kind, c_name AS presiding, c_mktsegment AS party
  FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT *, coalesce(date BETWEEN '1995-01-01' AND '1997-12-31', false) AS d, outcome IN ('F', 'P') AS o, kind IN ('1-URGENT', '2-HIGH') AS k, contains(lower(presiding), 'customer#') AS p, contains(lower(party), 'build') AS y FROM r) """


_WORDS = "list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_COUNT = "len(list_filter(range(1, len({0}) - {1} + 2), lambda i: {2}))::INT"


def _often(words: str, phrase: str) -> str:
    """How often a phrase stands in a list of words."""
    parts = phrase.split()
    return _COUNT.format(words, len(parts), " AND ".join(f"{words}[i + {k}] = '{p}'" for k, p in enumerate(parts)))


def _search(phrase: str = PHRASE, text: str = "text", number: str | None = None) -> str:
    """m: all documents with n_words and tf; r: hits with their scores, by the statistics of all documents."""
    other = _WORDS.format(number) if number else "[]::VARCHAR[]"
    return f"""WITH t AS (SELECT doc_id, source, lang, CASE WHEN lang = 'en' THEN printf('2024-%02d-01', doc_id % 12 + 1) END AS date, {_WORDS.format(text)} AS w, {other} AS v FROM documents),
m AS (SELECT doc_id, source, lang, date, (len(w) + len(v))::INT AS n_words, ({_often("w", phrase)} + {_often("v", phrase)})::INT AS tf FROM t),
s AS (SELECT count(*) AS n, count(*) FILTER (tf > 0) AS df, avg(n_words) AS a FROM m),
r AS (SELECT m.*, round(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * n_words / a))), 9) AS score FROM m, s WHERE tf > 0) """


_SECOND, _NUMBER = "replace(text, 'Licensed under', 'Available under')", "'KIO ' || doc_id || '/24'"
_BETWEEN = "coalesce(date BETWEEN '2024-03-01' AND '2024-10-31', false)"

_NEAR = "('that', 'the', 'on')"


def _scored(tf: str) -> str:
    """The best hits by an own count of them; a text counts w, its words."""
    return _search().split("m AS (")[0] + f"""m AS (SELECT doc_id, len(w)::INT AS n_words, {tf} AS tf FROM t), s AS (SELECT count(*) AS n, count(*) FILTER (tf > 0) AS df, avg(n_words) AS a FROM m),
r AS (SELECT m.*, round(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * n_words / a))), 9) AS score FROM m, s WHERE tf > 0) SELECT doc_id, n_words, tf, score FROM r ORDER BY score DESC, doc_id LIMIT {TOP}"""


ORACLE_SQL = {
    "version_ledger": _LOADS + "SELECT doc_id, sha256, min(load)::INT AS load FROM (SELECT *, 1 AS load FROM first UNION ALL SELECT *, 2 FROM second) GROUP BY ALL",
    "current_version": _LOADS + "SELECT s.doc_id, s.sha256 AS current_sha256, (CASE WHEN f.sha256 = s.sha256 THEN 1 ELSE 2 END)::INT AS version_load, '2024-01-01' AS first_seen, '2024-02-01' AS last_seen FROM second s JOIN first f USING (doc_id)",
    "replay_is_noop": _LOADS + "SELECT count(*) AS versions, 0::BIGINT AS added FROM (SELECT * FROM first UNION SELECT * FROM second)",
    "incremental_reparse": "WITH q AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) SELECT (5 + q)::INT AS parse_version, count(*) AS n FROM documents LEFT JOIN q USING (doc_id) WHERE q IS NULL OR 5 + q < 6 GROUP BY 1",
    "skip_known": "SELECT source, doc_id NOT IN (SELECT doc_id FROM labels) AS nowy, count(*) AS n FROM documents GROUP BY ALL",
    "filter_algebra": _ROWS + "SELECT doc_id, date, outcome, kind FROM f WHERE d AND o AND k AND p AND y",
    "undated_left_out": _ROWS + "SELECT count(*) AS corpus, count(*) FILTER (d AND o AND k AND p AND y) AS hits, count(*) FILTER (o AND k AND p AND y AND date IS NULL) AS undated FROM f",
    "broadening_counts": _ROWS
    + "SELECT 0 AS position, 'presiding' AS dropped, count(*) FILTER (d AND o AND k AND y) AS hits FROM f UNION ALL SELECT 1, 'party', count(*) FILTER (d AND o AND k AND p) FROM f UNION ALL SELECT 2, 'dates', count(*) FILTER (o AND k AND p AND y) FROM f UNION ALL SELECT 3, 'outcomes', count(*) FILTER (d AND k AND p AND y) FROM f",
    "unknown_values": "SELECT value FROM (VALUES ('1-URGENT'), ('9-NONE'), ('2-HIGH'), ('0-NOW')) v(value) WHERE value NOT IN (SELECT o_orderpriority FROM orders)",
    "lookup_by_key": "SELECT o_orderkey AS doc_id, count(*) OVER () AS n_matches FROM orders WHERE o_custkey = 1",
    "phrase_search_topk": _search() + f"SELECT doc_id, n_words, tf, score FROM r ORDER BY score DESC, doc_id LIMIT {TOP}",
    "search_counts": _search(PHRASE, _SECOND, _NUMBER) + f"SELECT (SELECT count(*) FROM documents) AS corpus, count(*) AS indexed, count(*) FILTER (tf > 0 AND {_BETWEEN}) AS hits, least(count(*) FILTER (tf > 0 AND {_BETWEEN}), {TOP}) AS shown, count(*) FILTER (tf > 0 AND date IS NULL) AS undated FROM m",
    "phrase_search_filtered": _search() + f"SELECT doc_id, source, n_words, tf, score FROM r WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT {TOP}",
    "normalised_filter": _ROWS + "SELECT lower(outcome) AS outcome, lower(kind) AS kind, count(*) AS n FROM f WHERE o AND k GROUP BY ALL",
    "corpus_order": _ROWS + "SELECT doc_id, date FROM r ORDER BY date NULLS FIRST, doc_id LIMIT 100",
    "search_current": _search("available under", _SECOND, _NUMBER) + f"SELECT doc_id, date, n_words, tf, score, source, 'KIO ' || doc_id || '/24; ' || source AS citation FROM r WHERE {_BETWEEN} ORDER BY score DESC, doc_id LIMIT {TOP}",
    "search_by_number": _search("kio 7 24", _SECOND, _NUMBER) + f"SELECT doc_id, source, tf, score FROM r ORDER BY score DESC, doc_id LIMIT {TOP}",
    "search_nothing": "SELECT count(*) AS corpus, count(*) AS indexed, 0::BIGINT AS hits, 0::BIGINT AS shown, 0::BIGINT AS undated FROM documents",
    "phrase_filter": _search() + "SELECT quality, toxic, count(*) AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM r) GROUP BY ALL",
    "search_excerpts": _search()
    + f""", b AS (SELECT doc_id FROM r ORDER BY score DESC, doc_id LIMIT {TOP}),
    x AS (SELECT doc_id, text, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+') AS g, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS v, w FROM b JOIN documents USING (doc_id) JOIN t USING (doc_id)),
    p AS (SELECT *, list_filter(range(0, len(w) - 1), lambda i: w[i + 1] = 'of' AND w[i + 2] = 'the') AS ps FROM x),
    c AS (SELECT *, unnest(ps) AS s FROM p),
    n AS (SELECT *, list_filter(ps, lambda q: q >= s AND q + 2 <= s + 16) AS own FROM c),
    best AS (SELECT doc_id, text, g, v, own, s FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(own) DESC, s) = 1),
    f AS (SELECT *, greatest(0, s - (16 - (list_max(own) + 2 - s)) // 2) AS a FROM best),
    z AS (SELECT *, least(a + 16, len(v)) AS e FROM f),
    o AS (SELECT *, (list_sum(list_transform(g[1:a + 1], lambda y: length(y))) + coalesce(list_sum(list_transform(v[1:a], lambda y: length(y))), 0))::INT AS lo,
      (list_sum(list_transform(g[1:e], lambda y: length(y))) + list_sum(list_transform(v[1:e], lambda y: length(y))))::INT AS hi FROM z)
    SELECT doc_id, lo AS start, hi AS "end", substring(text, lo + 1, hi - lo) AS excerpt FROM o""",
    "search_page": _search() + f"SELECT doc_id, n_words, tf, score FROM r ORDER BY score DESC, doc_id LIMIT {TOP} OFFSET {TOP}",
    "search_near": _scored(f"len(list_filter(range(1, len(w) + 1), lambda i: w[i] IN {_NEAR} AND len(list_distinct(list_filter(w[i:i + 12], lambda y: y IN {_NEAR}))) = 3))::INT"),
    "search_prefix": _scored("len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND starts_with(w[i + 1], 'th')))::INT"),
    "search_any": f"""WITH t AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
    m AS (SELECT doc_id, phrase, tf FROM (SELECT doc_id, 'of the' AS phrase, {_often("w", "of the")} AS tf FROM t UNION ALL SELECT doc_id, 'licensed under', {_often("w", "licensed under")} FROM t UNION ALL SELECT doc_id, 'de la', {_often("w", "de la")} FROM t) WHERE tf > 0),
    e AS (SELECT doc_id, count(*) AS n, sum(tf) AS tf FROM m GROUP BY doc_id)
    SELECT phrase, count(*) AS documents, sum(tf)::BIGINT AS hits FROM m GROUP BY phrase UNION ALL SELECT 'any', count(*), coalesce(sum(tf), 0)::BIGINT FROM e UNION ALL SELECT 'more than one', count(*), coalesce(sum(tf), 0)::BIGINT FROM e WHERE n > 1""",
    "index_upkeep": f"""WITH t AS (SELECT {_WORDS.format("text")} AS a, {_WORDS.format(_SECOND)} AS b, contains(text, 'Licensed under') AS changed FROM documents),
    n AS (SELECT unnest(['licensed', 'available']) AS term), k AS (SELECT term, count(*) FILTER (list_contains(a, term)) + count(*) FILTER (changed AND list_contains(b, term)) AS disk, count(*) FILTER (list_contains(b, term)) AS live FROM t, n GROUP BY term)
    SELECT 'two segments' AS index, term, disk AS on_disk, live AS read FROM k WHERE disk > 0 UNION ALL SELECT 'compacted', term, live, live FROM k WHERE live > 0""",
}
