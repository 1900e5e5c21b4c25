"""The extractor hook, paged services, workbooks and nested records."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import extract, flatten
from tessera.sources import files, paged, workbook


def answered(spark, rows, extractor, **how):
    d = spark.createDataFrame(rows, "doc_id int, text string")
    return {r.doc_id: r for r in extract.answers(d, "doc_id", F.col("text"), extractor, wait=0.0, **how).collect()}


def test_states_of_an_extractor(spark):
    asked = []

    def extractor(texts):
        out = []
        for t in texts:
            asked.append(t)
            if t == "busy":
                raise extract.RateLimited
            if t == "down":
                raise OSError("no route")
            out.append({"fenced": '```json\n{"source": {"title": "T"}}\n```', "plain": ' {"citations": [{"m": 1}, {"m": null}]} ', "broken": "{", "list": "[1]", "": "{}"}.get(t))
        return out

    texts = ["fenced", "plain", "broken", "list", "busy", "down", None, "other", "skipped"]
    skip = F.when(F.col("text") == "skipped", "skipped_no_text")
    got = answered(spark, list(enumerate(texts)), extractor, skip=skip, tries=3, size=4)
    state = [(got[i].llm_status, got[i].json_valid, got[i].retry_count) for i in range(9)]
    assert state == [("ok", True, 0), ("ok", True, 0), ("json_error", False, 0), ("json_error", False, 0), ("max_retries", False, 3), ("api_error", False, 0), ("ok", True, 0), ("json_error", False, 0), ("skipped_no_text", None, 0)]
    assert got[5].extraction_error == "OSError: no route" and json.loads(got[1].answer)["citations"][1] == {"m": None}


def test_waits_grow_and_answers_after_refusals():
    waits, turns = [], iter([1, 1, 0])

    def extractor(texts):
        if next(turns):
            raise extract.RateLimited
        return ["{}"]

    assert extract._one(extractor, "t", 5, 30.0, waits.append)[:3] == ("ok", True, 2) and waits == [30.0, 60.0]


def test_rows_of_documents_and_citations(spark):
    d = spark.createDataFrame([(1, "a", "s"), (2, "b", "t"), (2, "b", "u")], "doc_id int, text string, source string")
    reply = json.dumps({"source": {"title": ""}, "citations": [{"m": "x"}, {"m": "y", "more": 1}]})
    found = extract.parsed(extract.answers(d.dropDuplicates(["doc_id"]), "doc_id", F.col("text"), lambda ts: [reply if t == "a" else '{"citations": 7}' for t in ts]), "title: string", "m: string")
    rows = {r.doc_id: r for r in extract.document_rows(found, "doc_id", F.lit("stem")).collect()}
    assert (rows[1].title, rows[1].n_citations, rows[2].title, rows[2].n_citations) == ("stem", 2, "stem", 0)
    assert sorted((r.doc_id, r.place, r.m, r.source) for r in extract.citation_rows(found, d, "doc_id", ("source",)).collect()) == [(1, 0, "x", "s"), (1, 1, "y", "s")]


def test_cursor_walk(spark):
    keys = list(range(5, 47))

    def fetch(request):
        after = request["from"] - 1 if request["cursor"] == "*" else int(request["cursor"])
        page = [k for k in keys if after < k < request["below"]][:4]
        return {"results": [{"k": k, "other": 1} for k in page], "next_cursor": str(page[-1]) if page else None}

    got = paged.by_cursor(spark, fetch, "k int, missing string", paged.key_ranges(5, 46, 3))
    assert got.rdd.getNumPartitions() == 3 and sorted((r.k, r.missing) for r in got.collect()) == [(k, None) for k in keys]
    assert paged.key_ranges(1, 2, 5) == [(1, 2), (2, 3)]
    with pytest.raises(ValueError, match="twice"):
        list(paged.cursor_rows(lambda r: {"results": [1], "next_cursor": "a"}, {}, 1, 0, print))


def test_refusals_are_bounded():
    waits, left = [], [paged.Again(), paged.Again()]

    def fetch(request):
        if left:
            raise left.pop()
        return {"results": [{"k": 1}]}

    assert list(paged.cursor_rows(fetch, {}, 3, 60.0, waits.append)) == [{"k": 1}] and waits == [60.0, 60.0]
    left[:] = [paged.Again()] * 3
    with pytest.raises(paged.Again):
        list(paged.cursor_rows(fetch, {}, 3, 0.0, waits.append))


@pytest.mark.parametrize("end", ["empty", "pages", "last"])
def test_numbered_pages(spark, end):
    def fetch(request):
        k = request["page"]
        out = {"results": [{"k": 10 * k + i} for i in range(3)] if k < 7 else []}
        return out | ({"pages": 7} if end == "pages" else {"last": k >= 6} if end == "last" else {})

    got = paged.by_page(spark, fetch, "k int", 3, name=f"numbered_{end}")
    assert sorted(r.k for r in got.collect()) == [10 * k + i for k in range(7) for i in range(3)]


def test_workbooks(spark, tmp_path):
    odd = ["plain", "", None, " two  spaces ", "<a & b>", "line\nfeed\ttab", "return\r\n", "bell\x07", "_x000D_ as it stands", "é 中 😀", "0123", "1.0"]
    d = spark.createDataFrame([(i, t, i / 4, i % 2 == 0 if i else None) for i, t in enumerate(odd)], "n long, t string, x double, b boolean").repartition(3)
    done = workbook.write_sheets(d, str(tmp_path / "w"), "audit & more", most=3).collect()
    assert sum(r.rows for r in done) == len(odd) and all(r.rows <= 3 for r in done)
    back = workbook.read_sheets(spark, str(tmp_path / "w"), "t string, n long, b boolean, absent int, x double", "audit & more")
    got = sorted(back.collect(), key=lambda r: r.n)
    assert [r.t for r in got] == odd and [r.x for r in got] == [i / 4 for i in range(len(odd))] and [r.b for r in got][:3] == [None, False, True] and {r.absent for r in got} == {None}
    with pytest.raises(ValueError, match="no sheet"):
        workbook.sheet_path(zipfile.ZipFile(tmp_path / "w" / done[0].file), "other")


def test_shared_strings_and_gaps(spark, tmp_path):
    """A workbook as other writers make them: shared strings of several runs, cells left out, errors, numbers in several forms."""
    m = workbook.MAIN
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{workbook.DOCUMENT}"><sheets><sheet name="first" sheetId="1" r:id="r1"/><sheet name="second" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbook.RELATIONS}"><Relationship Id="r2" Target="/xl/worksheets/b.xml"/><Relationship Id="r1" Target="worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>k</t></si><si><r><t>so</t></r><r><t xml:space="preserve"> many</t></r><rPh><t>no</t></rPh></si><si/></sst>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{m}"><sheetData/></worksheet>')
        rows = '<row><c t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>v</t></is></c></row><row><c r="A2"><v>3.0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="A3"><v>1E2</v></c><c r="C3" t="e"><v>#N/A</v></c></row><row><c r="A4"><v>2.5</v></c><c r="B4"><v>9</v></c></row><row/><row><c r="A6" t="str"><v>7</v></c><c r="C6" t="s"><v>2</v></c></row>'
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{m}"><sheetData>{rows}</sheetData></worksheet>')
    got = [tuple(r) for r in workbook.read_sheets(spark, str(tmp_path), "k int, v string", "second").collect()]
    assert got == [(3, "so many"), (100, None), (None, None), (None, None), (7, "")]
    assert workbook.read_sheets(spark, str(tmp_path), "k int", 0).count() == 0
    assert [workbook.column_name(workbook.column_number(c)) for c in ("A", "Z", "AA", "AZ", "BA", "XFD")] == ["A", "Z", "AA", "AZ", "BA", "XFD"]


def test_flatten(spark):
    work = {"id": "https://w/W1", "authorships": [{"author": {"id": "https://w/A1", "display_name": "Ann B. Cee"}}, {"author": None}, {"author": {"display_name": ""}}], "concepts": [{"display_name": "low", "score": 0.1}, {"display_name": "none"}, {"display_name": "high", "score": 0.9}, {"display_name": "tie", "score": 0.1}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}}
    d = spark.createDataFrame([(json.dumps(work),), ("{}",), ("no json",)], "w string").select(F.from_json("w", flatten.WORK).alias("w"))
    got = d.select(*(c.alias(n) for n, c in flatten.work_columns(F.col("w"), F.lit("J"), "https://w/").items())).collect()
    assert (got[0].openalex_id, got[0].abstract, got[0].top_concept, got[0].is_oa, got[0].doi) == ("W1", "a b a", "high", False, "")
    assert [json.loads(got[0][c]) for c in ("author_names", "author_lastnames", "author_ids", "all_concepts")] == [["Ann B. Cee", "", ""], ["Cee", "", ""], ["A1"], ["high", "low", "tie", "none"]]
    assert all((r.openalex_id, r.author_names, r.all_concepts, r.cited_by_count, r.year) == ("", "[]", "[]", 0, None) for r in got[1:])


def test_walk_of_arrays_in_arrays(spark):
    d = spark.createDataFrame([('{"a": {"b": [{"c": [{"d": 1}, {"d": null}], "e": "x"}, {"e": "y"}]}, "f": 2}',)], "w string")
    d = d.select(F.from_json("w", "a struct<b: array<struct<c: array<struct<d: int>>, e: string>>>, f int").alias("w"))
    kind = d.schema["w"].dataType
    assert flatten.leaves(kind) == [("a", "b", "c", "d"), ("a", "b", "e"), ("f",)]
    row = d.select(*flatten.flat(F.col("w"), kind, ".", {"a.b.e": "names"})).first()
    assert row.asDict() == {"a.b.c.d": [[1, None], None], "names": ["x", "y"], "f": 2}
    with pytest.raises(ValueError, match="no field"):
        flatten.reach(F.col("w"), kind, ("a", "zz"))
    with pytest.raises(ValueError, match="two fields"):
        flatten.flat(F.col("w"), kind, rename={"f": "a_b_e"})


def test_readers_by_kind_and_cache(spark, tmp_path):
    d = spark.createDataFrame([(b"a", "TXT"), (b"%PDF", "pdf"), (b"c", "doc"), (b"d", None)], "c binary, k string")
    assert [r[0] for r in d.select(files.text_of(F.col("c"), F.col("k"), {"PDF": lambda c: F.lit("layer")})).collect()] == ["a", "layer", None, None]
    path = str(tmp_path / "cache")
    assert files.cached(spark.range(3), path).count() == 3 and files.cached(spark.range(9), path).count() == 3
    (tmp_path / "cache" / "_SUCCESS").unlink()
    assert files.cached(spark.range(9), path).count() == 9
    assert files.first_rows(spark.range(9), 0, "id").count() == 9 and [r.id for r in files.first_rows(spark.range(9), 2, "id").collect()] == [0, 1]
