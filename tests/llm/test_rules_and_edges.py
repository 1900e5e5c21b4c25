"""Token attribution by rule, packing and attribution on odd rows, and naive Bayes against a plain one."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import attribution, langid, packing, queries
from test_operators import LONG, ODD, docs_of, ids_of

SECTIONED = ["a\n\nb", "a\n\n\n\nb\n", "x\n  y\n\n  z", "\n\n\n", "one two\n\tthree\n\n\nfour", "no end", "\r\n\r\n a", "a \n \n b"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    t.encode_special_tokens = True
    return t


def plain_counts(tokenizer, text, rule):
    """Tokens by section from the library's own offsets (in texts of one byte a character)."""
    lines = re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]
    bounds = np.cumsum([len(x) for x in lines])
    counts, crossing = [0] * len(lines), [0] * len(lines)
    for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
        head, tail = int(np.searchsorted(bounds, a, "right")), int(np.searchsorted(bounds, b - 1, "right"))
        inside = [min(b, bounds[s]) - max(a, bounds[s] - len(lines[s])) for s in range(head, tail + 1)]
        own = {"first": head, "last": tail, "most": head + int(np.argmax(inside))}[rule]
        counts[own] += 1
        crossing[own] += tail > head
    return list(zip(counts, crossing))


def test_rules_equal_offsets(spark, tokenizer):
    d, by_rule = docs_of(spark, list(enumerate(SECTIONED))), {}
    for rule in attribution.RULES:
        got = {}
        for r in attribution.attribute(d, queries.vocabulary_path(), rule).orderBy("doc_id", "section_no").collect():
            got.setdefault(r.doc_id, []).append((r.n_tokens, r.n_crossing))
        by_rule[rule] = got
        assert got == {i: plain_counts(tokenizer, t, rule) for i, t in enumerate(SECTIONED)}
    assert by_rule["first"] != by_rule["last"] and by_rule["most"] != by_rule["last"]


def test_attribution_on_odd_rows(spark, tokenizer):
    rows = attribution.attribute(docs_of(spark, ODD), queries.vocabulary_path()).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.doc_id] += r.n_tokens
    want = Counter()
    for i, t in ODD:
        want[i] += len(ids_of(tokenizer, t)) - 1
    assert tokens == want and sum(r.doc_id in (1, 2) for r in rows) == 2 and sum(r.doc_id == 4 for r in rows) == 2
    assert attribution.attribute(docs_of(spark, []), queries.vocabulary_path()).count() == 0


def test_packing_on_odd_rows(spark, tokenizer):
    pieces = packing.pack(docs_of(spark, ODD), queries.vocabulary_path(), capacity=128).collect()
    got, want = Counter(), Counter()
    for p in pieces:
        for i, x in enumerate(np.frombuffer(bytes(p.ids), "<u4").tolist()):
            got[p.doc_id, p.doc_tokens, p.start + i, x] += 1
    for i, t in ODD:
        ids = ids_of(tokenizer, t)
        for place, x in enumerate(ids):
            want[i, len(ids), place, x] += 1
    assert got == want and LONG in dict(ODD).values()
    assert packing.pack(docs_of(spark, []), queries.vocabulary_path()).count() == 0


def test_language_equals_plain_bayes(spark):
    texts = [("en", "The cat and the dog"), ("en", "that this then"), ("de", "der Hund und die Katze"), ("fr", "le chat é où"), ("de", ""), ("de", None)]
    asked = ["the end", "und über", "où est", "katze chat dog", "é"]
    d = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.train(d, F.lit(True))

    def grams(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [low[i : i + n] for n in langid.ORDERS for i in range(len(low) - n + 1)]

    counts, rows = {}, Counter()
    for lang, t in texts:
        rows[lang] += 1
        counts.setdefault(lang, Counter()).update(grams(t))
    # Buckets are many and the texts few, so no two n-grams of these share one unless the hash says so.
    raw = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    bucket = {}
    for t in [*(t for _, t in texts if t), *asked]:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        for n, b in zip(langid.ORDERS, langid.grams(*raw(t))[0]):
            for i in range(len(low) - n + 1):
                assert bucket.setdefault(low[i : i + n], int(b[i])) == b[i]
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    by_bucket = {lang: Counter() for lang in counts}
    for lang, c in counts.items():
        for g, n in c.items():
            by_bucket[lang][bucket[g]] += n
    got = langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, t in zip(got, asked):
        log = {lang: math.log(rows[lang] / len(texts)) + sum(math.log((by_bucket[lang][bucket[g]] + 0.5) / (total[lang] + 0.5 * langid.BUCKETS)) for g in grams(t)) for lang in counts}
        best = max(sorted(log), key=log.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - log[best]) for v in log.values()))

