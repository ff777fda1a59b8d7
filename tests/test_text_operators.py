import pytest
from pyspark.sql import functions as F
from quillspark.config import ChunkConfig
from quillspark.functions import dates, fuzzy, text
from quillspark.operators import chunking, classify, fields, tables


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_last_group_is_null_without_a_match(spark):
    df = fields.parse_fields(spark.createDataFrame([("Sponsor: Acme, Inc.\nPhase IIIV\nRevised: 3/2019",), ("nothing",)], "text string"))
    a, b = sorted(df.collect(), key=lambda r: r.text)
    assert (a.sponsor, a.document_date, a.protocol_number) == ("Acme, Inc.", "3/2019", None)
    assert set(b.asDict().values()) == {"nothing", None}


def test_indication_is_case_sensitive_and_leftmost_wins(spark):
    t = "Indications and Usage changed 04/2023\nINDICATIONS AND USAGE treats much pain\nNDA 123456 protocol no. ABCD"
    row = fields.parse_fields(spark.createDataFrame([(t,)], "text string")).first()
    assert row.indication == "treats much pain" and row.protocol_number == "NDA 123456"


def test_tags_go_by_the_order_of_patterns(spark):
    df = classify.tag_page(spark.createDataFrame([("Informed Consent of a Clinical Study Report, RESULTS and Synopsis, août 5, 2024",), ("Protocol Number 7",)], "text string"))
    rows = {r.text[:3]: r for r in df.collect()}
    assert (rows["Inf"].doc_type, rows["Inf"].section, rows["Inf"].date) == ("CSR", "synopsis", "août 5, 2024")
    assert rows["Pro"].doc_type is None


@pytest.mark.parametrize("scores,starts", [((1, 2, 2), [0, 1]), ((3, 3), [0, 1]), ((0, 0, 2), [0, 2]), ((2, 1, 2), [0, 2]), ((0, 1, 1), [0])])
def test_boundaries(spark, scores, starts):
    signals = ["CONFIDENTIAL", "Study Number: AB-1234", "Table of Contents"]
    df = spark.createDataFrame([("d", i, "\n".join(signals[:s])) for i, s in enumerate(scores)], "doc_id string, page_num int, text string")
    assert sorted(r.start_page for r in classify.detect_boundaries(df).collect()) == starts


def test_no_pages_no_boundaries(spark):
    assert classify.detect_boundaries(spark.createDataFrame([], "doc_id string, page_num int, text string")).count() == 0


def test_table_records(spark):
    df = spark.createDataFrame([([["a", "a"], ["1", "2"], ["3"]],), ([["x"]],), ([],)], "rows array<array<string>>")
    got = [r[0] for r in df.select(tables.records(F.col("rows"))).collect()]
    assert got == [[{"a": "2"}, {"a": "3"}], [], []]
    assert [r[0] for r in df.select(tables.header(F.col("rows"))).collect()] == [["a", "a"], ["x"], []]


@pytest.mark.parametrize(
    "truth,seen,want",
    [("1/2014", "since 2014", "2014"), ("8/2014", "8/20 14", None), ("1/2014", "13/2014", None), ("2014", "5/2014", "5/2014"), ("October 2025", "10/1/2025", "10/1/2025"), ("bad", "2014", None), ("3/4/2020", "on 3/5/2020, 3/4/2020", "3/4/2020")],
)
def test_dates(spark, truth, seen, want):
    df = spark.createDataFrame([(truth, seen)], "t string, s string")
    assert df.select(F.try_element_at(dates.matching(F.col("t"), F.col("s")), F.lit(1))).first()[0] == want


def test_fuzzy_order_and_windows():
    assert fuzzy.similarity("tide", "diet") == 0.25 and fuzzy.similarity("diet", "tide") == 0.5
    assert fuzzy.best_window("blue whale", "a Blue Whale sings") == 1.0
    assert fuzzy.best_window("one two three", "one two") == fuzzy.similarity("one two three", "one two")
    assert fuzzy.best_window("", "x") == 0.0


def test_pruned_windows_equal_all_windows():
    import random

    r = random.Random(1)
    for _ in range(200):
        hay = " ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(12))
        need = " ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(3))
        w = hay.split()
        assert fuzzy.best_window(need, hay) == max(fuzzy.similarity(need, " ".join(w[i : i + 3])) for i in range(10))


def test_chunks(spark):
    df = spark.createDataFrame([("d", " ".join(str(i) for i in range(10))), ("e", ""), ("f", None)], "doc_id string, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", chunking.fixed_chunks(F.col("text"), 4, 1).alias("c")).collect()}
    assert got["d"] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"] and not got["e"] and not got["f"]
    with pytest.raises(ValueError):
        chunking.build_chunks(df, ChunkConfig(strategy="semantic"))
    s = spark.createDataFrame([("d", "a b. c d e. f g? h")], "doc_id string, text string")
    assert [r.text for r in chunking.sentence_chunks(s, size=5, overlap=3).collect()] == ["a b. c d e.", "c d e. f g?", "f g? h"]


def test_metadata_by_position(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x", "y"]), (["a"], [])], "t array<string>, m array<string>")
    got = [[(p.text, p.meta) for p in r[0]] for r in df.select(chunking.zip_metadata(F.col("t"), F.col("m"))).collect()]
    assert got == [[("a", "x"), ("b", "y")], [("a", None)]]


def test_strip_takes_all_white_space(spark):
    assert [r[0] for r in column(spark, ["\t a b \n", "", " "]).select(text.strip(F.col("v"))).collect()] == ["a b", "", ""]


def test_window_bounds_never_cut_the_best_window():
    import random

    r = random.Random(12)
    some = lambda n: " ".join("".join(r.choice("abcİΣσß'é😀A") for _ in range(r.randint(1, 5))) for _ in range(n))
    for _ in range(300):
        hay = some(r.randint(1, 60))
        w = hay.split()
        need = r.choice([some(r.randint(1, 4)), some(20), "  ".join(w[:3]), " ".join(w[2:5]).upper() or "a"])
        k = len(need.split())
        want = max(fuzzy.similarity(need, " ".join(w[i : i + k])) for i in range(len(w) - k + 1)) if len(w) > k else fuzzy.similarity(need, hay)
        assert fuzzy.best_window(need, hay) == want


@pytest.mark.parametrize("value,want", [
    ("Sept 2014", "2014-09-01"), ("Oct. 3 2014", "2014-10-03"), ("october 3rd, 2014", "2014-10-03"), ("2014/08/01", "2014-08-01"), ("3 Mar 2012", "2012-03-03"), ("12-jan-2020", "2020-01-12"), ("1/2014", "2014-01-01"),
    ("1800", "1800-01-01"), ("Friday 5 June 2015", "2015-06-05"), ("March", "2000-03-01"), ("no date", None), ("", None), (None, None),
])
def test_lenient_dates(spark, value, want):
    got = spark.createDataFrame([(value,)], "v string").select(dates.parse_any(F.col("v")).cast("string").alias("d")).first().d
    assert got == want


def test_years_are_of_two_centuries(spark):
    rows = [("1800", "day"), ("1999", "year"), ("2099", "year"), ("2100", "day"), (" 2001 ", "year"), ("1/2014", "month")]
    df = spark.createDataFrame(rows, "v string, want string")
    assert df.where(dates.granularity(F.col("v")) != F.col("want")).count() == 0


def test_an_empty_needle_equals_an_empty_text_alone():
    assert [fuzzy.best_window(" ", t) for t in ("", " ", "a", "a b c")] == [1.0, 1.0, 0.0, 0.0]
