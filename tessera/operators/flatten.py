"""Nested records as flat rows, by a walk over their schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reach(value: Column, kind: T.DataType, path: tuple[str, ...]) -> tuple[Column, T.DataType]:
    """(column, type) of what a path leads to. Below an array of records the result is an array, aligned by place with it: a record
    without the field has a null there, and a null record too."""
    if not path:
        return value, kind
    if isinstance(kind, T.ArrayType):
        below = reach(F.lit(None).cast(kind.elementType), kind.elementType, path)[1]
        return F.transform(value, lambda x: reach(x, kind.elementType, path)[0]), T.ArrayType(below)
    if isinstance(kind, T.MapType):
        return reach(F.get(F.map_values(F.map_filter(value, lambda k, v: k == path[0])), F.lit(0)), kind.valueType, path[1:])
    if not isinstance(kind, T.StructType) or path[0] not in kind.names:
        raise ValueError(f"no field {path[0]!r} in {kind.simpleString()}")
    return reach(value.getField(path[0]), kind[path[0]].dataType, path[1:])


def leaves(kind: T.DataType, at: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """The paths of all fields that are no records; records in arrays are walked, arrays of plain values are leaves."""
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in leaves(f.dataType, (*at, f.name))]
    return [at]


def flat(value: Column, kind: T.StructType, separator: str = "_", rename: dict[str, str] | None = None, only: Callable[[str], bool] | None = None) -> list[Column]:
    """A column for each leaf, named by its path. rename: other names by path; two leaves of one name are an error."""
    out: dict[str, Column] = {}
    for path in leaves(kind):
        name = (rename or {}).get(".".join(path), separator.join(path))
        if only is not None and not only(".".join(path)):
            continue
        if name in out:
            raise ValueError(f"two fields are named {name!r}; give one another name")
        out[name] = reach(value, kind, path)[0].alias(name)
    return list(out.values())


def without_prefix(value: Column, prefix: str) -> Column:
    return F.replace(value, F.lit(prefix), F.lit(""))


def last_word(value: Column) -> Column:
    """The last of the words of a text; an empty text for none."""
    return F.coalesce(F.try_element_at(F.filter(F.split(F.coalesce(value, F.lit("")), r"\s+"), lambda w: w != ""), F.lit(-1)), F.lit(""))


def by_score(records: Column, name: str = "display_name", score: str = "score") -> Column:
    """Names of records, the highest score first, of equals the first; a null score counts as 0."""
    placed = F.transform(F.coalesce(records, F.array()), lambda r, i: F.struct((-F.coalesce(r[score].cast("double"), F.lit(0.0))).alias("less"), i.alias("place"), F.coalesce(r[name], F.lit("")).alias("name")))
    return F.transform(F.array_sort(placed), lambda r: r["name"])


#: The schema of a bibliographic work as its service sends it.
WORK = "id string, doi string, title string, publication_year int, cited_by_count int, authorships array<struct<author: struct<id: string, display_name: string>>>, concepts array<struct<display_name: string, score: double>>, abstract_inverted_index map<string, array<int>>, open_access struct<is_oa: boolean>"


def work_columns(work: Column, journal: Column, ids: str) -> dict[str, Column]:
    """The flat row of a work (a struct of WORK). ids: the prefix that is taken off ids. Lists are JSON text; an author without an id has a name but no
    place in author_ids; texts that are missing are empty."""
    from ..functions.text import abstract

    kind = T.StructType.fromDDL(WORK)
    at = lambda *path: reach(work, kind, path)[0]
    text = lambda c: F.coalesce(c, F.lit(""))
    names = F.coalesce(F.transform(at("authorships", "author", "display_name"), text), F.array())
    own = F.filter(F.coalesce(at("authorships", "author", "id"), F.array()), lambda i: i.isNotNull() & (i != ""))
    concepts = by_score(at("concepts"))
    return {
        "openalex_id": without_prefix(text(at("id")), ids), "doi": text(at("doi")), "title": text(at("title")), "year": at("publication_year"), "journal": journal,
        "cited_by_count": F.coalesce(at("cited_by_count"), F.lit(0)), "abstract": abstract(at("abstract_inverted_index")), "top_concept": text(F.get(concepts, F.lit(0))),
        "all_concepts": F.to_json(concepts), "author_names": F.to_json(names), "author_lastnames": F.to_json(F.transform(names, last_word)), "author_ids": F.to_json(F.transform(own, lambda i: without_prefix(i, ids))),
        "is_oa": F.coalesce(at("open_access", "is_oa"), F.lit(False)),
    }
