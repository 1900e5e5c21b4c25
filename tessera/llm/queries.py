"""Queries over the operators, with production parameters, over whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, decontaminate, exactdup, hardneg, langid, linededup, mixing, neardup, packing, pii, prefixtrie, store, toxicity
from .common import cut, documents, held_out, remove_path

_VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    return importlib.import_module("public_tokenizers").path(_VOCABULARY)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), vocabulary_path(), capacity=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "class")


def op2_content_addressed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_store(documents(spark, sf_dir), vocabulary_path())
    sums = cut(store.document_checksums(spark, path))
    remove_path(spark, path)
    return sums


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, ~held_out(F.col("doc_id")))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(documents(spark, sf_dir), percent=80)


def op5_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(documents(spark, sf_dir), vocabulary_path(), rule="first")


def op7_block_naming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(documents(spark, sf_dir))


OP7_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


def op8_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), percent=85, shingle=5)


def op9_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.sensitive_terms(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.filter("spans", lambda x: x["kind"] != "term")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    scored = mixing.score(documents(spark, sf_dir), F.coalesce(remainder != 0, F.lit(True)))
    return scored.select("doc_id", (~F.col("trains")).alias("held_out"), *scored.columns[2:])


def op12_bit_sliced_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_louds_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""

#: crc32 of a decimal: each byte, then eight steps of one bit (marked -1).
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)"""

OP13_SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
k AS (SELECT z.conv_id, z.conv_id - z.conv_id % 100 AS base, h, least(h, coalesce(b.n, 0)) AS taken FROM (SELECT conv_id, {_CRC} % 6 AS h FROM z) x JOIN z USING (conv_id) LEFT JOIN z b ON b.conv_id = z.conv_id - z.conv_id % 100),
r AS (
  SELECT k.conv_id, pos AS d, role, text FROM k JOIN o ON o.conv_id = base WHERE pos <= taken
  UNION ALL SELECT k.conv_id, pos - h + taken AS d, role, text FROM k JOIN o ON o.conv_id = k.conv_id WHERE pos > h),
s AS (SELECT k.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS path FROM k LEFT JOIN r USING (conv_id) GROUP BY k.conv_id),
p AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM s),
nodes AS (SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '') AS ends FROM p GROUP BY ALL),
ups AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN ups USING (node)),
below AS (
  SELECT a.node, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * CASE WHEN b.depth > 0 THEN length(b.node[b.depth].text) ELSE 0 END) AS saved_tokens
  FROM nodes a JOIN full_nodes b ON b.node[1:a.depth] = a.node AND b.depth >= a.depth GROUP BY a.node)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN u.conv_id END AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN below USING (node) LEFT JOIN nodes u ON n.depth > 0 AND u.node = n.node[1:n.depth - 1]
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
places AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS p FROM places),
sizes AS (SELECT DISTINCT n FROM phrases),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM spots),
found AS (SELECT g.doc_id, g.i, g.n, f.item_id FROM grams g JOIN phrases f ON g.n = f.n AND g.p = f.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM spots),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least_of USING (doc_id)
"""


#: All lines with their 5-shingles; pairs meet in the shingles of each that are rarest, of which a linked pair shares one.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS line_no FROM d),
l AS (SELECT * FROM o WHERE regexp_matches(line, '\S')),
u AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM l)),
s AS (SELECT DISTINCT id, g FROM (SELECT id, unnest(CASE WHEN length(line) < 5 THEN [line] ELSE list_transform(range(1, length(line) - 3), lambda i: substr(line, i, 5)) END) AS g FROM u)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
p AS (SELECT id, g, n FROM (SELECT s.id, s.g, n, row_number() OVER (PARTITION BY s.id ORDER BY df, s.g) AS k FROM s JOIN n USING (id) JOIN f USING (g)) WHERE k <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b ON a.g = b.g AND a.id < b.id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
m AS (SELECT x, y, count(*) AS c FROM c JOIN s a ON a.id = x JOIN s b ON b.id = y AND a.g = b.g GROUP BY ALL),
links AS (SELECT x, y FROM m JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT id, id FROM u UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
parts AS (SELECT a AS id, min(b) AS part FROM reach GROUP BY a),
placed AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY part ORDER BY doc_id, line_no) AS place FROM l JOIN u USING (line) JOIN parts USING (id)),
gone AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (place > 1) AS n, list(line_no ORDER BY line_no) FILTER (place > 1) AS nos FROM placed GROUP BY doc_id)
SELECT documents.doc_id, coalesce(lines, 0) AS n_lines, coalesce(n, 0) AS n_dropped, coalesce(nos, []) AS dropped_lines FROM documents LEFT JOIN gone USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_harmonic_packing, op2_content_addressed_store, op3_language_id, op4_fuzzy_line_dedup, op5_fm_index_decontamination, op6_token_attribution, op7_block_naming_exact_dedup, op8_bottom_k_near_dedup, op9_disclosure_pii, op10_toxicity, op11_context_mixing, op12_bit_sliced_hard_negatives, op13_louds_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op4_fuzzy_line_dedup": OP4_SQL, "op5_fm_index_decontamination": OP5_SQL, "op7_block_naming_exact_dedup": OP7_SQL, "op8_bottom_k_near_dedup": OP8_SQL, "op12_bit_sliced_hard_negatives": OP12_SQL, "op13_louds_prefix_trie": OP13_SQL}
