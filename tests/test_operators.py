from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docket.operators import citations, coverage, exports, filters, graph, ledger, provisions, quality, requestlog, runs, search, sections, structure
from docket.sources import records
from docket.sources.tables import shared_folder
from docket.streaming import ingest

RULING = """Sygn. akt: KIO 10/23
WYROK
z dnia 5 stycznia 2023 r.
po rozpoznaniu odwołania
orzeka:
1. oddala odwołanie.
Stosownie do art. 579 ust. 1 ustawy z dnia 11 września 2019 r. – Prawo zamówień publicznych na niniejszy wyrok przysługuje skarga.
Przewodniczący: ………
Uz as adnienie
Izba podziela wyrok KIO 20/22 oraz sygn. akt: 3376/23 i pogląd o sygn. akt nieznana, choć nie ma on wpływu na rozstrzygnięcie w tej sprawie, czyli KIO 10/23.
Zgodnie z art. 226 ust. 1 pkt 5 lit. a ustawy Pzp. Wobec art. 415 k.c. oraz art. 98 kodeksu postępowania cywilnego
"""


@pytest.fixture(scope="module")
def ruling(spark):
    docs = spark.createDataFrame([(1, RULING, ["KIO 10/23"]), (2, "", []), (3, None, None), (4, "bez kotwic", [])], "doc_id long, text string, own array<string>")
    return docs, sections.segment(docs)


def test_sections_cover_the_text(ruling):
    docs, cut = ruling
    rows = cut.filter("doc_id = 1").orderBy("ord").collect()
    assert [r.kind for r in rows] == ["naglowek", "sentencja", "pouczenie", "uzasadnienie"]
    assert RULING[rows[1].start :].startswith("orzeka:") and RULING[rows[2].start :].startswith("Stosownie") and RULING[rows[3].start :].startswith("Uz as")
    assert all(not RULING[a.end : b.start].strip() for a, b in zip(rows, rows[1:]))
    assert [(r.doc_id, r.kind) for r in cut.filter("doc_id <> 1").collect()] == [(4, "nieprzypisane")]
    totals = sections.section_coverage(cut).first()
    assert totals.zdanie_odrebne == 0 and totals.nieprzypisane == 10


OTHERS = {  # texts and the kinds of their sections
    "bez\nSygn. akt: KIO 1/20\npostanawia: odrzuca.\nPrzewodniczący: ……\nSygn. akt: KIO 1/20\n" + "Izba uznała, że odwołanie nie jest zasadne. " * 6: ["naglowek", "sentencja", "uzasadnienie"],
    "Sygn. akt: KIO 1/20\norzeka: oddala.\nPrzewodniczący: ……\n….……\n12\n" + "Izba uznała, że odwołanie nie jest zasadne. " * 6: ["naglowek", "sentencja", "uzasadnienie"],
    "Sygn. akt: KIO 1/20\norzeka: oddala.\nPrzewodniczący: ……\nZa krótko.": ["naglowek", "sentencja"],
    "Sygn. akt: KIO 1/20\no rzeka: oddala.\nPrzewodniczący: ………Uzasadnienie\nTak.\nZ danie odrębne\nNie.": ["naglowek", "sentencja", "uzasadnienie", "zdanie_odrebne"],
    "Wstęp bez numeru\norzeka 1. oddala.\nUzasadnienie:\nTak.": ["nieprzypisane", "sentencja", "uzasadnienie"],
    "Uzasadnienie do wyroku z dnia\nTak.\nPouczenie: na orzeczenie przysługuje skarga.": ["nieprzypisane", "pouczenie"],  # an instruction after which no reasons come
}


def test_sections_by_every_fallback(spark):
    docs = spark.createDataFrame(list(enumerate(OTHERS)), "doc_id int, text string")
    rows = sections.segment(docs).orderBy("doc_id", "ord").collect()
    for k, (text, kinds) in enumerate(OTHERS.items()):
        own = [r for r in rows if r.doc_id == k]
        assert [r.kind for r in own] == kinds, text
        assert own[0].start == len(text) - len(text.lstrip()) and all(a.end <= b.start and not text[a.end : b.start].strip() for a, b in zip(own, own[1:])) and not text[own[-1].end :].strip()


def test_split_text_loses_nothing(spark):
    df = spark.sql("select 'abcdefghij' as t, array(named_struct('start', 2, 'end', 5, 'kind', 'x'), named_struct('start', 4, 'end', 7, 'kind', 'y')) as s")
    parts = df.select(sections.split_text(F.col("t"), F.col("s")).alias("p"))
    assert [(p.kind, p.part) for p in parts.first().p] == [(None, "ab"), ("x", "cde"), ("y", "fg"), (None, "hij")]
    text = parts.select(sections.with_headings(F.col("p"), {"x": "X"}).alias("t")).first().t
    assert text.replace("## X\n", "").replace("## y\n", "") == "abcdefghij"


def test_citations_and_unread_ones(ruling):
    docs, cut = ruling
    rows = citations.citations(docs, own="own").orderBy("ord").collect()
    assert [(r.kind, r.canon) for r in rows] == [("kio", "KIO 20/22"), ("kio_bez_repertorium", "KIO 3376/23"), ("inne", None)]
    assert all(RULING[r.start : r.end] == r.raw for r in rows) and [r.ord for r in rows] == [0, 1, 2]


def test_provisions_with_statutes(ruling):
    docs, cut = ruling
    rows = provisions.from_text(docs).orderBy("ord").collect()
    assert [(r.form, r.act) for r in rows] == [("art. 579 ust. 1", "pzp2019"), ("art. 226 ust. 1 pkt 5 lit. a", "pzp2019"), ("art. 415", "kc"), ("art. 98", "kpc")]
    listed = docs.filter("doc_id = 1").withColumn("przepisy", F.array(F.lit("art. 226 ust. 1 Pzp"), F.lit(" inne ")))
    assert [(r.form, r.act) for r in provisions.from_channel(listed).orderBy("ord").collect()] == [("art. 226 ust. 1", "pzp2019"), ("inne", "nieustalone")]


def test_versions(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    first = ledger.landed(docs, F.col("text"), "2024-01-01", 1)
    known = ledger.new_versions(first)
    second = ledger.landed(docs, F.concat("text", F.when(F.col("doc_id") == 2, "!").otherwise("")), "2024-02-01", 2)
    assert known.count() == 2 and ledger.new_versions(first, known).count() == 0
    assert [r.doc_id for r in ledger.new_versions(second, known).collect()] == [2]
    state = {r.doc_id: r for r in ledger.documents(first.unionByName(second)).collect()}
    assert state[2].first_seen_at < state[2].last_seen_at and state[1].current_sha256 == known.filter("doc_id = 1").first().sha256
    good, bad = ledger.checked(first.withColumn("said", F.when(F.col("doc_id") == 1, F.col("sha256"))), "said")
    assert good.count() == 2 and bad.count() == 1


def test_filters(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "A", "Łucja 50%", ["art. 1"]), (2, None, "A", "ŁUCJA", None), (3, "2025-01-01", "B", "x_y", ["Art. 2"])], "id int, date string, outcome string, presiding string, provisions array<string>")
    at = filters.Columns()
    ids = lambda **c: sorted(r.id for r in filters.matching(df, filters.Criteria(**c), at).collect())
    assert ids(since="2024-01-01", until="2024-12-31") == [1] and ids(presiding="łucja") == [] and ids(presiding="ŁucJA") == [1, 2] and ids(presiding="50%") == [1] and ids(presiding="_") == [3] and ids(provision="art") == [1, 3]
    counted = filters.counts(df, filters.Criteria(since="2024-01-01", outcomes=("A",)), at).first()
    assert (counted.corpus, counted.hits, counted.undated) == (3, 1, 1)
    assert [(r.dropped, r.hits) for r in filters.relaxations(df, filters.Criteria(since="2026-01-01", outcomes=("A",)), at).orderBy("position").collect()] == [("dates", 2), ("outcomes", 0)]
    assert filters.Criteria(kinds=("b", "a", "a")).canonical() == '{"kinds":["a","b"]}' and len(filters.Criteria().fingerprint()) == 16
    with pytest.raises(ValueError):
        filters.Criteria(since="2025", until="2024")
    plain = filters.Criteria(outcomes=(" Łąka", "łĄKA ", ""), presiding=" x ").normalised()
    assert plain.outcomes == ("laka",) and plain.presiding == "x"
    numbered = spark.createDataFrame([(1, ["KIO 10/23"]), (2, ["KIO 010 / 2023", "x"]), (3, None)], "doc_id long, numbers array<string>")
    asked = lambda q: sorted((r.doc_id, r.n_matches) for r in filters.lookup(numbered, q, "doc_id", "numbers").collect())
    assert asked("kio 10/2023") == [(1, 2), (2, 2)] and asked("3") == [(3, 1)] and asked("x") == [(2, 1)] and asked("y") == []
    assert [r.id for r in filters.in_order(df, "date", "id").collect()] == [2, 1, 3]


def test_search(spark):
    docs = spark.createDataFrame([(1, "Ala ma kota, ma kota"), (2, "kota ma Ala"), (3, None), (4, "ma KOTA i psa oraz wiele innych zwierząt")], "doc_id long, text string")
    found = search.matches(docs, "ma kota")
    assert [r.doc_id for r in search.top(found).collect()] == [1, 4] and search.counts(found, 1).first().asDict() == {"corpus": 4, "indexed": 4, "hits": 2, "shown": 1, "undated": 0}
    repeated = spark.createDataFrame([(1, "a a a")], "doc_id long, text string")
    assert search.matches(repeated, "a a").first().tf == 2
    assert docs.filter("doc_id = 4").select(search.excerpt(F.col("text"), "psa", 3).alias("x")).first().x == "… i psa oraz …"
    with pytest.raises(ValueError):
        search.matches(docs, " * ")
    # Case numbers are searched too, a phrase doesn't run on from one to the next, and filters leave the statistics alone
    numbered = docs.withColumn("numbers", F.when(F.col("doc_id") < 3, F.array(F.lit("KIO 7/24"), F.lit("KIO 8/24"))))
    hits = lambda phrase: [r.doc_id for r in search.top(search.matches(numbered, phrase, numbers="numbers")).collect()]
    assert hits("kio 8 24") == [2, 1] and hits("24 kio") == [] and hits("Ala ma") == [1]
    whole = {r.doc_id: r.score for r in search.ranked(found).collect()}
    assert {r.doc_id: r.score for r in search.ranked(found, F.col("doc_id") > 1).collect()} == {4: whole[4]}
    dated = found.withColumn("date", F.when(F.col("doc_id") == 1, "2024-01-01"))
    row = search.counts(dated, 5, docs, F.coalesce(F.col("date") > "2023", F.lit(False)), "date", F.lit(True)).first()
    assert (row.corpus, row.indexed, row.hits, row.shown, row.undated) == (4, 4, 1, 1, 1)


def test_runs(spark):
    links = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 3), (2, 7, 4)], "run_id int, doc_id int, ts int")
    assert [(r.doc_id, r.position) for r in runs.first_links(links, ("ts",)).filter("run_id = 1").orderBy("position").collect()] == [(7, 1), (8, 2)]
    assert runs.union_of_runs(links, ("ts",)).count() == 2
    requests = spark.createDataFrame([(3, "x", 2), (3, "y", 1), (3, "z", 3)], "run_id int, sha256 string, ts int")
    versions = spark.createDataFrame([("x", 5), ("y", 6), ("z", 1), ("z", 2)], "sha256 string, doc_id int")
    with pytest.raises(ValueError):
        runs.selected(links, None, (), None)
    assert not exports.write_if_any(links.filter("doc_id = 99"), lambda _: 1 / 0) and exports.write_if_any(links, lambda df: df.count())
    all_runs = spark.createDataFrame([(1,), (3,)], "run_id int")
    assert [(r.doc_id, r.position) for r in runs.rebuilt_lineage(all_runs, links, requests, versions).orderBy("position").collect()] == [(6, 1), (5, 2)]


def test_request_log(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    log = spark.createDataFrame([(1, t(0), 404), (2, t(1), 404), (3, t(2), 200), (4, t(3), 429), (5, t(4), 200), (6, t(30), 200)], "id int, ts timestamp_ntz, status int").withColumn("run", F.lit(1))
    assert [(r.first, r.length) for r in requestlog.streaks(log, F.col("status") == 404, F.col("status") == 200, 2, ("run",), ("id",)).collect()] == [(1, 2)]
    assert [r.in_window for r in requestlog.rolling(log, 2, 1, ("run",)).orderBy("id").collect()] == [1, 2, 2, 2, 2, 1]
    assert [r.blocked for r in requestlog.cooldown(log, F.col("status") == 429, F.lit(None).cast("double"), 10.0, ("run",), ("id",)).orderBy("id").collect()] == [False] * 4 + [True, False]
    plan = spark.createDataFrame([(250, 100, 1), (None, 1, 1)], "listed long, known long, pages_read long")
    cost = requestlog.load_cost(plan).collect()
    assert (cost[0].docs_left, cost[0].pages_left, cost[0].requests, cost[0].ask_first) == (150, 2, 152, True) and cost[1].requests is None


def test_shapes(spark):
    df = spark.createDataFrame([('{"data": [{"a": 1}]}',), ('{"data": []}',), ('{"data": [',), ("x",), (None,)], "body string")
    rows = quality.list_shape(df, "body", "data", allow_empty=False).collect()
    assert [(r.ok, r.transient) for r in rows] == [(True, False), (False, False), (False, True), (False, False), (False, False)]
    rows = quality.record_shape(spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"data": {"a": 1, "b": 2}}',), ('{"a": 1}',)], "body string"), "body", ("a", "b")).collect()
    assert [(r.ok, r.place, r.missing) for r in rows] == [(True, "$", []), (True, "$.data", []), (False, None, ["b"])]
    assert [(r.marker, r.n) for r in quality.marker_counts(spark.createDataFrame([(1, "abAB")], "id int, t string"), "id", "t", ("ab", "x")).collect()] == [("ab", 2), ("x", 0)]


def test_records(spark):
    raw = [b'{"slug": " s ", "primary_signature": "KIO 1/23", "signatures": ["", 3], "ruling_date": 5, "costs_total": "7", "full_text": " x "}', b"[1]", b"\xff", b'{"slug": "t", "costs_total": 7.5, "signatures": ["a"]}']
    rows = records.decode(spark.createDataFrame([(bytearray(r),) for r in raw], "content binary")).collect()
    assert [r.decoded for r in rows] == [True, False, False, True]
    assert (rows[0].source_ref, rows[0].sygnatury, rows[0].data_wydania, rows[0].koszty, rows[0].tresc) == ("s", ["KIO 1/23"], None, None, " x ") and (rows[3].koszty, rows[3].sygnatury) == (7.5, ["a"])
    checks = records.page_checks(spark.createDataFrame([(1, '{"has_more": true}'), (9, '{"has_more": "no"}')], "page int, body string"), 5).first()
    assert (checks.pages, checks.bad_flags, checks.runaway) == (2, 1, True)


def test_gold(ruling):
    docs, cut = ruling
    cited, named = citations.citations(docs), provisions.from_text(docs)
    read = coverage.structures(docs.withColumn("sha", F.sha2("text", 256)), cut, cited, named, "sha")
    assert read.count() == 4 and coverage.gold_check(read, read).filter("checked and not conforms").count() == 0
    other = read.withColumn("citations", F.slice("citations", 1, 1))
    bad = coverage.gold_check(other, read).filter("doc_id = 1").first()
    assert bad.checked and not bad.conforms and bad.reasons == ["citations"]
    with pytest.raises(ValueError):
        coverage.gold_gate(coverage.gold_check(other, read))


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "=x"), (2, None, None)], "doc_id int, tags array<string>, t string")
    rows = exports.cells(df, {"id": "doc_id", "tags": "tags", "text": "t"}, {"organ": "KIO"})
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, "a; b", "'=x", "KIO"), (2, None, None, "KIO")]
    exports.write_csv(rows, f"{tmp_path}/out")
    assert spark.read.option("header", True).option("sep", ";").csv(f"{tmp_path}/out").count() == 2


def test_graph(spark):
    cited = spark.createDataFrame([(1, "KIO 1/20", "kio"), (2, "KIO 1/20", "kio"), (1, "KIO 9/20", "kio")], "doc_id long, canon string, kind string")
    numbers = spark.createDataFrame([(5, "KIO 1/20")], "doc_id long, number string")
    assert {(r.citing, r.cited) for r in graph.resolved(cited, numbers).collect()} == {(1, 5), (2, 5)}
    assert [(r.canon, r.n) for r in graph.missing(cited, numbers, 5).collect()] == [("KIO 9/20", 1)]


def test_stream_replay_adds_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    for k in (1, 2):
        stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in").withColumn("seen_at", F.to_timestamp(F.lit("2024-01-01")))
        ingest.start(stream, f"{tmp_path}/out", f"{tmp_path}/check{k}").awaitTermination()
    assert ingest.committed(spark, f"{tmp_path}/out").count() == 2


def test_batch_of_a_second_stream_that_is_cut_off_is_not_there(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/one")
    docs.withColumn("text", F.lit("other")).write.parquet(f"{tmp_path}/two")

    def load(folder):
        stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/{folder}").withColumn("seen_at", F.to_timestamp(F.lit("2024-01-01")))
        return ingest.start(stream, f"{tmp_path}/out", f"{tmp_path}/check-{folder}")

    load("one").awaitTermination()
    ranged = type(spark).range
    with monkeypatch.context() as m:  # the second stream's batch 0 writes its versions and fails before its commit
        m.setattr(type(spark), "range", lambda *_, **__: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivisionError"):
            load("two").awaitTermination()
    assert type(spark).range is ranged and spark.read.parquet(f"{tmp_path}/out/versions").count() == 2 and ingest.committed(spark, f"{tmp_path}/out").count() == 1
    load("two").awaitTermination()  # the batch runs again
    assert spark.read.parquet(f"{tmp_path}/out/versions").count() == 3 and ingest.committed(spark, f"{tmp_path}/out").count() == 2


def test_budget_leaves_late_rows_out(spark, tmp_path):
    row = lambda m, k: (datetime(2024, 1, 1, 10, m), k)
    for k, rows in enumerate(([row(0, 1), row(1, 1), row(50, 1)], [row(2, 1), row(45, 2), row(59, 3)], [row(59, 3)])):
        spark.createDataFrame(rows, "ts timestamp, run_id int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("ts timestamp, run_id int").parquet(f"{tmp_path}/in")
        query = ingest.budget(stream, 600, 1).writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        query.trigger(availableNow=True).start().awaitTermination()
    got = {(r.window.start.minute, r.run_id): (r.n, r.over) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, 1): (2, True)} or got == {(0, 1): (2, True), (40, 2): (1, False)}


def test_local_folders_are_refused_on_a_cluster(spark):
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="app", _jvm=spark._jvm, _jsc=spark.sparkContext._jsc))
    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077"), "x")
    assert shared_folder(session("local[2]"), "x").startswith("file:///")


def test_structure_of_a_text_in_one_pass(ruling):
    docs, cut = ruling
    read = structure.read(docs, own="own").persist()
    parts = lambda name, *columns: sorted((r.doc_id, *[r[c] for c in columns]) for r in structure.exploded(read, name).collect())
    rows = lambda df, *columns: sorted((r.doc_id, *[r[c] for c in columns]) for r in df.collect())
    assert parts("sections", "ord", "start", "end", "kind", "sha256") == rows(cut, "ord", "start", "end", "kind", "sha256")
    assert parts("citations", "ord", "start", "end", "kind", "raw") == rows(citations.citations(docs, own="own"), "ord", "start", "end", "kind", "raw")
    assert parts("provisions", "ord", "start", "end", "form", "act") == rows(provisions.from_text(docs), "ord", "start", "end", "form", "act")
    assert {r.doc_id: (r.sections, r.citations, r.provisions) for r in read.filter("doc_id in (2, 3)").collect()} == {2: ([], [], []), 3: ([], [], [])}
    read.unpersist()


def test_reports_as_text(spark):
    report = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "name string, n int, share double")
    assert sorted(r.value for r in coverage.as_json(report).collect()) == ['{"name":"a","n":1,"share":0.5}', '{"name":"b","n":2,"share":null}']
    assert [r.value for r in coverage.as_markdown(report, "T", "name").orderBy("position").collect()] == ["## T", "", "| name | n | share |", "|---|---|---|", "| a | 1 | 0.5 |", "| b | 2 | – |"]
    whole = spark.range(1000).select(F.col("id").cast("string").alias("e"))
    assert coverage.digest(whole, F.col("e")).collect() == coverage.digest(whole.orderBy(F.rand()), F.col("e"), (6, 3)).collect() and coverage.digest(whole, F.col("e")).first().n == 1000


def test_stored_criteria_are_read_back_and_compared_as_a_column(spark):
    C = filters.Criteria
    odd = ['a"b', "c\\d", "\u0105\u017c\U0001f600", "x\ny\tz", "/", " ", "\u2028", "{}", "%_"]
    all_of = [C(), C(since="2024-01-01", until="2024-12-31", outcomes=("b", "a", "b"), kinds=("\uffff", "\U00010000", "z"), text="t"), C(party="")] + [C(presiding=v, kinds=(v, "k")) for v in odd]
    assert all(C.read(c.canonical()).canonical() == c.canonical() for c in all_of)
    texts = [c.canonical() for c in all_of] + ['{"kinds": ["b", null, "a", "b"], "party": null, "text": "q"}', ' {"until": "2024"}']
    got = {r.t: r for r in spark.createDataFrame([(t,) for t in [*texts, "", "[]", "no", "null", '{"kinds": 5}', None]], "t string").select("t", filters.canonical(F.col("t")).alias("c"), filters.fingerprint(F.col("t")).alias("f")).collect()}
    assert all((got[t].c, got[t].f) == (C.read(t).canonical(), C.read(t).fingerprint()) for t in texts)
    assert all(got[t].c is None and got[t].f is None for t in ("", "[]", "no", "null", '{"kinds": 5}', None))
    for bad in ("[]", "no", '{"colour": "red"}'):
        with pytest.raises(ValueError):
            C.read(bad)
