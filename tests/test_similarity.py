import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.operators import link

TEXT = st.text(alphabet="abcé 😀", max_size=12)


def table_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_lcs_equals_the_table(a, b):
    assert similarity.lcs(a, b) == table_lcs(a, b) == similarity.lcs(b, a)
    assert 0 <= similarity.ratio_of(a, b) <= 100


def test_native_equals_udf(spark):
    rows = [("abc", "abd"), ("", "x"), ("", ""), ("fama french", "french fama"), ("crédit", "credit"), ("a", "a")]
    got = spark.createDataFrame(rows, "a string, b string").select(similarity.ratio("a", "b").alias("x"), similarity.native_ratio(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(abs(r.x - r.y) < 1e-9 for r in got)


def test_blocks_lose_no_pair(spark):
    import random

    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdef gh") for _ in range(rnd.randint(1, 25))).strip() or "a" for _ in range(60)]
    keys = sorted({*base, *(s[: len(s) // 2] + rnd.choice("xyz") + s[len(s) // 2 :] for s in base), *(s[1:] or "q" for s in base)})
    d = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    for t in (80, 88, 93):
        got = {(r.left_id, r.right_id) for r in link.similar(d, d, t).collect()}
        assert got == {(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys) if similarity.ratio_of(a, b) >= t}


def test_many_pairs_at_once_equal_single_ones():
    import random

    import numpy as np

    rnd = random.Random(1)
    keys = ["".join(rnd.choice("abcdé😀") for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 128, 129, 200]))) for _ in range(40)]
    m, n = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40), indexing="ij"))
    assert similarity.lcs_of_pairs(keys, keys, m, n).tolist() == [similarity.lcs(keys[i], keys[j]) for i, j in zip(m, n)]


def test_few_pairs_of_unlike_keys_are_verified(monkeypatch):
    import random

    rnd = random.Random(5)
    parts = [x + y for x in "bcdfghklmnprst" for y in "aeiou"]
    left, right = ([" ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(9)) for _ in range(300)] for _ in range(2))
    right[:20] = [k[:30] + "x" + k[31:] for k in left[:20]]
    asked = []
    monkeypatch.setattr(link, "lcs_of_pairs", lambda a, b, m, n: asked.append(len(m)) or similarity.lcs_of_pairs(a, b, m, n))
    got = {(i, j) for m, n, _ in link.similar_pairs(left, right, 88) for i, j in zip(m.tolist(), n.tolist())}
    assert got == {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if similarity.ratio_of(a, b) >= 88} and len(got) >= 20
    assert sum(asked) < 300 * 300 // 10


def test_groups_follow_the_number_of_keys(spark, monkeypatch):
    import random

    rnd = random.Random(9)
    keys = sorted({"".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 14))) for _ in range(80)})
    d = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    few = link.similar(d, d, 85)
    # A small table is one group, not a thousand.
    assert few.rdd.getNumPartitions() <= 4
    want = {(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys) if similarity.ratio_of(a, b) >= 85}
    assert {(r.left_id, r.right_id) for r in few.collect()} == want
    monkeypatch.setattr(link, "LEAST", 20)
    monkeypatch.setattr(link, "PART", 8)
    assert {(r.left_id, r.right_id) for r in link.similar(d, d.where("id < 30"), 85).collect()} == {(i, j) for i, j in want if j < 30}


def test_pairs_of_very_many_occurrences():
    # More than 255 occurrences, which one byte does not hold.
    keys = ["ab" * n for n in (1, 400, 420, 700)] + ["a" * 500]
    got = {(i, j) for m, n, _ in link.similar_pairs(keys, keys, 93) for i, j in zip(m.tolist(), n.tolist())}
    assert got == {(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys) if similarity.ratio_of(a, b) >= 93}


def test_only_keys_of_one_group_are_compared(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    rows = sorted({(rnd.choice("ppppqrs"), "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 14)))) for _ in range(120)})
    d = spark.createDataFrame([(g, i, k) for i, (g, k) in enumerate(rows)] + [(None, 900, "abc")], "by string, id long, key string")
    want = {(i, j) for i, (g, a) in enumerate(rows) for j, (h, b) in enumerate(rows) if g == h and similarity.ratio_of(a, b) >= 85}
    assert {(r.left_id, r.right_id) for r in link.similar_within(d, d, 85).collect()} == want
    # A large group is cut, and its parts all meet.
    monkeypatch.setattr(link, "PART", 24)
    got = [(r.left_id, r.right_id) for r in link.similar_within(d, d.where("id < 60 and by <> 's'"), 85).collect()]
    assert sorted(got) == sorted((i, j) for i, j in want if j < 60 and rows[j][0] != "s")
    assert link.similar_within(d.where("by = 'p'"), d.where("by = 'q'"), 85).collect() == []


@pytest.mark.parametrize("threshold, most", [(85, 6000), (88, 1000), (93, 60)])
def test_bits_leave_few_pairs_to_score(monkeypatch, threshold, most):
    import random

    rnd = random.Random(6)
    parts = [x + y for x in "bdmnrst" for y in "aeiou"]
    left, right = ([" ".join(sorted("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(9))) for _ in range(300)] for _ in range(2))
    right[:40] = [k[: i % 20] + "xy"[: i % 3] + k[i % 20 + i % 4 :] for i, k in enumerate(left[:40])]
    asked = []
    monkeypatch.setattr(link, "lcs_of_pairs", lambda a, b, m, n: asked.append(len(m)) or similarity.lcs_of_pairs(a, b, m, n))
    got = {(i, j) for m, n, _ in link.similar_pairs(left, right, threshold) for i, j in zip(m.tolist(), n.tolist())}
    assert got == {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if similarity.ratio_of(a, b) >= threshold} and len(got) >= 20
    assert sum(asked) <= most, sum(asked)


@pytest.mark.parametrize("threshold", [75, 88, 93])
def test_cells_and_tiles_lose_no_pair(monkeypatch, threshold):
    import random

    rnd = random.Random(8)
    tongues = [[x + y for x in a for y in b] for a, b in (("bdmnr", "aei"), ("sxkzt", "ouy"), ("жшд", "іа😀"))]
    base = [" ".join(sorted("".join(rnd.choice(t) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 9)))) for t in tongues for _ in range(70)]
    left = sorted({*base, *(k[: len(k) // 2] for k in base), "a", "ab" * 400})
    right = sorted({k[:i] + "xyж"[i % 3] * (i % 3) + k[i + i % 4 :] for i, k in enumerate(base)} | {*base[::5], "a", "ab" * 410})
    want = {(i, j): similarity.ratio_of(a, b) for i, a in enumerate(left) for j, b in enumerate(right) if similarity.ratio_of(a, b) >= threshold}
    laid, near = [], link._near_letters
    monkeypatch.setattr(link, "_near_letters", lambda x, y, *more: laid.append(len(x) * len(y)) or near(x, y, *more))
    for name, value in (("LEAF", 8), ("TILE", 32), ("ROWS", 3), ("WAITING", 50), ("HASHED", 30)):
        monkeypatch.setattr(link, name, value)
    found = [(i, j, s) for m, n, score in link.similar_pairs(left, right, threshold) for i, j, s in zip(m.tolist(), n.tolist(), score.tolist())]
    assert len(found) == len(want) > 100 and {(i, j): s for i, j, s in found} == want
    # Keys of other letters are not laid side by side.
    assert sum(laid) < len(left) * len(right) / 2


def test_the_best_of_a_key_are_those_of_all_pairs(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    keys = sorted({"".join(rnd.choice("ab ") for _ in range(rnd.randint(4, 12))) for _ in range(90)})
    d = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    monkeypatch.setattr(link, "LEAST", 30)
    monkeypatch.setattr(link, "KEPT", 40)
    monkeypatch.setattr(link, "LEAF", 8)
    order = lambda r: (r.left_id, -r.score, r.right_id)
    every, some = (sorted(link.similar(d, d, 70, top).collect(), key=order) for top in (None, 3))
    best = lambda rows: [r for k, r in enumerate(rows) if k < 3 or rows[k - 3].left_id != r.left_id]
    assert best(some) == best(every) and len(best(every)) < len(some) < len(every)
