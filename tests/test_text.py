import random

from pyspark.sql import functions as F

from docket.functions.identity import bare_number, case_numbers, chamber_number, chamber_numbers, document_id, file_name, vintage
from docket.functions.text import find_all, fold, labelled, mask, neutral, strip_controls, tokens, without_overlaps
from docket.functions.view import origin, place, view

TEXT = "Sygn. akt:  KIO  233/18\r\n\n WYROK\nz dnia 5 stycznia\n 2020 r. \fIzba  w składzie\n1. oddala,\nodwołanie 🙂 i\n16.01.2024 dalej"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first().x


def test_find_all_gives_offsets_of_code_points(spark):
    text = "ż 🙂 art. 1, ART. 22 i art. 3"
    hits = one(spark, find_all(F.col("t"), r"(?i)\bart\. \d+"), text)
    assert [text[h.start : h.end] for h in hits] == ["art. 1", "ART. 22", "art. 3"]
    assert one(spark, find_all(F.col("t"), "x"), "") == []
    assert one(spark, find_all(F.col("t"), "x"), None) is None


def test_longer_of_two_that_start_together_wins_and_overlaps_go(spark):
    df = spark.sql("select array(named_struct('start', 3, 'end', 6), named_struct('start', 0, 'end', 2), named_struct('start', 0, 'end', 4), named_struct('start', 6, 'end', 7)) as t")
    assert [(h.start, h.end) for h in df.select(without_overlaps(F.col("t")).alias("x")).first().x] == [(0, 4), (6, 7)]


def test_view_joins_lines_and_maps_back(spark):
    seen = one(spark, view(F.col("t")), TEXT)
    assert seen.text == "Sygn. akt: KIO 233/18\nWYROK\nz dnia 5 stycznia 2020 r. Izba w składzie\n1. oddala, odwołanie 🙂 i 16.01.2024 dalej"
    v = view(F.col("t"))
    offs = one(spark, F.transform(F.sequence(F.lit(0), v["n"]), lambda i: origin(v, i)), TEXT)
    assert len(offs) == len(seen.text) + 1 and offs[-1] == len(TEXT)
    assert all(c == TEXT[o] for c, o in zip(seen.text, offs) if c not in " \n")
    at = seen.text.index("Izba")
    df = spark.createDataFrame([(TEXT,)], "t string").select(view(F.col("t")).alias("v"))
    a, b = df.select(F.struct(*place(F.col("v"), F.lit(at), F.lit(at + 4))).alias("x")).first().x
    assert TEXT[a:b] == "Izba"


def test_every_character_of_a_view_is_one_of_the_original(spark):
    pick = random.Random(3)
    some = ["a", "Ab", "ABC", "Ł", "ż", "12", "1.", "12. ", "3.5", ".", ":", ",", ")", "–", "-", "\n", "\n", "\n", " ", "  ", "\t", "\f", "\r", "\u00a0", "🙂", "WYROK", "x!", "ŻÓŁĆ KIO\n", "\n\f"]
    texts = ["".join(pick.choice(some) for _ in range(pick.randint(0, 25))) for _ in range(2000)]
    v = view(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", v["text"].alias("v"), F.transform(F.sequence(F.lit(0), v["n"]), lambda i: origin(v, i)).alias("o")).collect()
    white = " \t\u00a0\n\f\r"
    for r in rows:
        assert r.o == sorted(set(r.o)) and r.o[-1] == len(r.t) and len(r.o) == len(r.v) + 1
        assert all(r.t[o] == c or (c in " \n" and r.t[o] in white) for c, o in zip(r.v, r.o))
        assert "".join(c for c in r.t if c not in white) == "".join(c for c in r.v if c not in " \n")
        assert not any(x in r.v for x in ("  ", " \n", "\n ", "\n\n")) and r.v == r.v.strip(" \n")


def test_case_numbers_of_all_families(spark):
    text = "KIO/UZP 1482 / 08, KIO 1234/23do, XXIII zs 1/22, XXIII ZS 012/2022, III CZP 56/17, X Qq 7/10, II SA/oP 4/18, VI GSK/Wa 1/20, UZP/ZO/0-62/07, C-652/22, beton C12/15, KIO/582/11"
    assert [(h.kind, h.canon) for h in one(spark, case_numbers(F.col("t")), text)] == [
        ("kio", "KIO/UZP 1482/08"), ("kio", "KIO 1234/23"), ("so", "XXIII Zs 12/22"), ("sn", "III CZP 56/17"), ("inne", "X Qq 7/10"),
        ("wsa", "II SA/Op 4/18"), ("nsa", "VI GSK/Wa 1/20"), ("uzp_zo", "UZP/ZO/0-62/07"), ("tsue", "C-652/22"), ("kio", "KIO 582/11"),
    ]


def test_one_case_number_and_lists(spark):
    assert one(spark, chamber_number(F.col("t")), "  kio/uzp  01482 / 2008 ") == "KIO/UZP 1482/08"
    assert one(spark, chamber_number(F.col("t")), "nic") is None
    assert one(spark, chamber_numbers(F.col("t")), "KIO 233/18, KIO 234/18, KIO 0233/18") == ["KIO 233/18", "KIO 234/18"]
    assert one(spark, bare_number(F.col("t")), ": 3376/23") is None
    assert one(spark, bare_number(F.col("t")), " 3376/23 i") == "KIO 3376/23"
    assert one(spark, vintage(F.col("t")), "KIO 1/09") == "2009" and one(spark, vintage(F.col("t")), None) == "brak"


def test_identity(spark):
    assert one(spark, document_id(F.lit("Atlas"), F.col("t"), True), " Ab-1 ") == "atlas:ab-1"
    assert one(spark, document_id(F.lit("a b"), F.col("t"), True), "x") is None
    assert one(spark, file_name(F.col("t")), "a/b: ż") == "a_b_"


def test_cleaning(spark):
    assert one(spark, strip_controls(F.col("t")), "a\x00\t\n​b\x9f‮") == "a\t\nb"
    assert one(spark, neutral(F.col("t")), "​=1+1") == "'=1+1" and one(spark, neutral(F.col("t")), "1=1") == "1=1"
    assert one(spark, mask(F.col("t"), {"abc": "KEY", "abcd": "LONG"}), "abcd abc") == "<LONG> <KEY>"
    assert one(spark, labelled(F.col("t"), {"a": "Ala"}), "a") == "Ala (a)" and one(spark, labelled(F.col("t"), {"a": "Ala"}), "b") == "b"
    assert one(spark, fold(F.col("t")), "ŻÓŁĆ é") == "zolc e"
    assert one(spark, tokens(F.col("t")), "Źle, ŁÓDŹ-2 x_y") == ["zle", "łodz", "2", "x", "y"] and one(spark, tokens(F.col("t")), None) == []
