import math
import random
import re
from itertools import permutations

import pytest
from quillspark.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(rows[x][0]), find(rows[y][0])))
                root[q] = p
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))


def corpus(seed, count, near):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(5, 90))] for _ in range(count)]
    out = []
    for k, b in enumerate(bases):
        if k % 3 == 0:
            b = b + passage
        out.append(b)
        for _ in range(near if k == 1 else r.choice([0, 0, 1, 2])):
            c = list(b)
            for _ in range(r.randint(0, 4)):
                c[r.randrange(len(c))] = r.choice(vocabulary)
            out.append(c)
    r.shuffle(out)
    rows = [(10 * i + 3, " ".join(w.upper() if r.random() < 0.05 else w for w in words)) for i, words in enumerate(out)]
    return rows + [(1, ""), (2, None), (4, " \n"), (5, "One two"), (6, "one  TWO"), (7, "one")]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", 8)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 5)
    rows = corpus(n, 60, 40)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, id int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(df, n=n, percent=percent).collect())
    assert got == brute(rows, n, percent)


def test_an_id_with_two_texts_joins_both_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y")]
    for order in list(permutations(rows))[::11]:
        df = spark.createDataFrame(order, "doc_id long, text string")
        assert sorted((r.doc_id, r.component_id) for r in jaccard.join_components(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def thue_morse(n):
    low = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return low, low.translate(str.maketrans("ab", "ba"))


def test_texts_that_fool_polynomial_hashes_stay_apart(spark):
    x, y = thue_morse(1024)
    lines = [" ".join(["w", *t, "w"]) for t in (x, y)]
    rows = [(1, x), (2, y), (3, x + " q"), (4, y + " q"), *((5 + i, t) for i, t in enumerate(lines))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(df).collect()) == brute(rows, 4, 85)


def test_sizes_that_may_link_lie_in_neighbouring_ranges():
    for percent in (80, 85, 99):
        width = math.log(100 / percent) * (1 + 1e-9)
        for n in range(1, 5000):
            assert math.floor(math.log(n * 100 // percent) / width) - math.floor(math.log(n) / width) <= 1


def test_columns_of_other_tables_do_not_clash(spark):
    base = " ".join(f"a{i}" for i in range(50))
    df = spark.createDataFrame([(3, base, 1, 2, 3), (9, base, 1, 2, 3)], "doc_id long, text string, __gone0 int, id int, node int")
    assert [tuple(r) for r in jaccard.keep_one(df).collect()] == [(3, base, 1, 2, 3)]
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_keep_one_leaves_a_row_of_each_group(spark):
    base = " ".join(f"a{i}" for i in range(50))
    rows = [(3, base), (9, base), (5, base + " more"), (7, "else where is it now then"), (8, None), (None, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in jaccard.keep_one(df).collect()) == [0, 3, 7, 8]


def test_empty_table_and_repeated_rows(spark):
    kind = "doc_id long, text string"
    assert jaccard.join_components(spark.createDataFrame([], kind)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], kind)
    assert sorted(str(r.component_id) for r in jaccard.join_components(df).collect()) == ["1", "1", "None"]
