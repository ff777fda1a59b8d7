import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from quillspark.operators import layout


def fragments(spark, rows):
    return spark.createDataFrame([("d", 0, i, float(y), float(x), t) for i, (y, x, t) in enumerate(rows)], "doc_id string, page_num int, frag_idx int, y0 double, x0 double, text string")


def order(spark, rows):
    return layout.reading_order(fragments(spark, rows)).first().text


def test_rows_are_anchored_to_their_first_fragment(spark):
    assert order(spark, [(0, 0, "a"), (1.5, 0, "b"), (3.0, 0, "c")]) == "a b\nc"


@pytest.mark.parametrize("gap,want", [(2.0, "a b"), (2.25, "a\nb")])
def test_the_tolerance_itself_still_belongs_to_the_row(spark, gap, want):
    assert order(spark, [(0, 0, "a"), (gap, 1, "b")]) == want


def test_a_row_is_sorted_by_x(spark):
    assert order(spark, [(0, 5, "a"), (0, 1, "b")]) == "b a"


def test_one_fragment_and_no_fragment(spark):
    assert order(spark, [(7, 1, "a")]) == "a"
    assert layout.reading_order(fragments(spark, [(0, 0, "a")]).where("false")).count() == 0


def plain(rows):
    out, anchor = [], None
    for y, x, _, t in sorted((y, x, i, t) for i, (y, x, t) in enumerate(rows)):
        if anchor is None or abs(y - anchor) > 2.0:
            anchor = y
            out.append([])
        out[-1].append((x, t))
    return "\n".join(" ".join(t for _, t in sorted(r)) for r in out)


quarter = st.integers(0, 40).map(lambda n: n / 4)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(quarter, quarter, st.sampled_from("abcd")), min_size=1, max_size=25))
def test_fold_and_arrow_agree_with_the_specification(spark, rows):
    assert order(spark, rows) == plain(rows)


def test_blocks_pages_and_blank_pages(spark):
    spans = spark.createDataFrame(
        [("d", 0, 0, 0, "text", "a"), ("d", 0, 0, 1, "text", "b "), ("d", 0, 1, 0, "text", "  "), ("d", 0, 2, 0, "image", "x"), ("d", 2, 0, 0, "text", "c")],
        "doc_id string, page_num int, block_idx int, span_idx int, block_type string, text string",
    )
    blocks = layout.blocks_from_spans(spans)
    assert {(r.page_num, r.block_idx, r.text, r.block_type) for r in blocks.collect()} == {(0, 0, "a b", "text"), (0, 2, "", "image"), (2, 0, "c", "text")}
    assert layout.full_text(blocks).first().text == "a b\nc"
    docs = spark.createDataFrame([("d", 4), ("e", 1), ("f", 0)], "doc_id string, num_pages int")
    got = sorted((r.doc_id, r.page_num, r.text) for r in layout.iter_pages(blocks, docs).collect())
    assert got == [("d", 0, "a b"), ("d", 1, ""), ("d", 2, "c"), ("d", 3, ""), ("e", 0, "")]
