import math

import duckdb
import pytest

from tessera import plans
from tessera.plans.registry import TABLES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(plans.oracle_sql()[name])
    got = plans.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    places = [want.columns.index(c) for c in order]
    expected = sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == expected


#: Texts with other cases of ASCII letters, spaces and control characters that engines class apart; rows without a text or a source.
ODD = ["ration", "RATION", "Ratıon", "ratİon", "raſion", "thing", "Thıng of", "thing and", "und der", "und dıe", "dans", "leſ", "les", "K", "ſ", " ", "\n", "\v", " ", " ", "\x85", "\x1c", "​", ".", "́", "é", "x", "_", "9", "ß"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    import random

    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice(ODD) + rnd.choice(["", " ", " "]) for _ in range(rnd.choice([1, 4, 9, 30, 200])))
    rows = [(i, None if i % 97 == 0 else text(), "en", None if i % 11 == 0 else f"src{i % 7}", 1) for i in range(600)]
    # Six sources, one of them unknown, with one hit each of a rule that no other text has.
    rows = [(i, t if t is None else t.replace("dans", "dan"), *more) for i, t, *more in rows] + [(1000 + i, "dans tous les", "en", s, 13) for i, s in enumerate([None, "a", "b", "c", "d", "e"])]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def equals_sql_on(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(plans.oracle_sql()[name])
    expected = sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in want.columns) for r in plans.queries()[name](spark, folder).collect()) == expected
    return expected


def test_sources_of_equal_hits_are_listed_as_in_sql(spark, odd):
    assert ("dans_les", "a:1; b:1; c:1; d:1") in equals_sql_on(spark, odd, "cand_top_sources")


def test_longest_contexts_of_odd_texts_are_those_of_sql(spark, odd):
    assert len(equals_sql_on(spark, odd, "canon_context")) > 50


def test_mentions_in_odd_texts_are_those_of_sql(spark, odd):
    assert len(equals_sql_on(spark, odd, "canon_count")) > 2


def test_rows_of_odd_texts_are_those_of_sql(spark, odd):
    assert len(equals_sql_on(spark, odd, "canon_row")) > 50
