import random
import re

from quillspark.operators import sections


def chunks(spark, text):
    lines = sections.lines_of(spark.createDataFrame([("d", text)], "doc_id string, text string")).withColumnRenamed("line_no", "line_no")
    return [(r.section, r.text) for r in sorted(sections.section_chunks(lines).collect(), key=lambda r: r.chunk_idx)]


def test_a_wrapped_warning_is_merged_and_takes_its_first_line(spark):
    got = chunks(spark, "WARNING: (A) X Y\nTHROMBOTIC EVENTS\nprose here\nCONTRAINDICATIONS\nnone")
    assert got == [("WARNING: (A) X Y THROMBOTIC EVENTS prose here", "WARNING: (A) X Y\nTHROMBOTIC EVENTS\nprose here"), ("CONTRAINDICATIONS", "CONTRAINDICATIONS\nnone")]


def test_boilerplate_is_not_taken_into_the_label(spark):
    assert chunks(spark, "WARNING: BLEEDING\nSee full prescribing information\nx")[0][0] == "WARNING: BLEEDING"


def test_headers_without_a_body_and_text_before_the_first_header_vanish(spark):
    assert chunks(spark, "pre\nCONTRAINDICATIONS\n\nDOSAGE FORMS\nnone\nADVERSE REACTIONS") == [("DOSAGE FORMS", "DOSAGE FORMS\nnone")]
    assert chunks(spark, "no header at all") == []


def test_what_is_no_header(spark):
    for line in ("PD, PTSD, SAD (", "CONTENTS OF IT*", "CONTRAINDICATIONS\r", "SHORT"):
        assert chunks(spark, f"{line}\nbody") == []


def sequential(text):
    """The rules of a run, line by line."""
    head = re.compile(r"^(WARNING:[A-Z0-9 ,:/&\-()]{2,112}|[A-Z][A-Z0-9 ,:/&\-]{9,120})$")
    runs, seen = [], None
    for line in text.split("\n"):
        is_head = bool(head.match(line))
        if is_head and seen is not True:
            runs.append([])
        if line.strip():
            seen = is_head
        if runs:
            runs[-1].append((line, is_head))
    out = []
    for run in runs:
        heads = [i for i, (_, h) in enumerate(run) if h]
        start = next((i for i in heads if run[i][0].startswith("WARNING:")), heads[-1])
        body = "\n".join(x for x, _ in run[heads[-1] + 1 :]).strip()
        if body:
            label = " ".join(run[i][0].strip() for i in heads if i >= start)
            first = body.splitlines()[0].strip()
            if label.startswith("WARNING:") and not first.lower().startswith("see full prescribing"):
                label += " " + first
            out.append((label, "\n".join(x for x, _ in run[start:]).strip()))
    return out


def test_against_the_sequential_rules(spark):
    r = random.Random(3)
    kinds = ["WARNING: (A) BAD", "WARNING: OTHER", "CONTRAINDICATIONS", "DOSAGE AND USE", "", "  ", "prose", "See full prescribing info", "more prose"]
    texts = ["\n".join(r.choice(kinds) for _ in range(r.randint(0, 14))) for _ in range(300)]
    lines = sections.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got: dict = {}
    for row in sections.section_chunks(lines).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(row.doc_id, []).append((row.section, row.text))
    assert all(got.get(i, []) == sequential(t) for i, t in enumerate(texts))
