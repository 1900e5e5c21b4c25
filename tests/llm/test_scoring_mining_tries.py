"""Context mixing, hard negatives and prefix tries against plain versions, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import hardneg, mixing, prefixtrie

# ---- prefix tries

TURNS = "conv_id long, turn long, role string, text string, key string, depth long, n long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, 1) for r in rows], TURNS)


def plain_trie(rows):
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            conv.setdefault(c, []).append((turn is not None, turn or 0, name, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in conv.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    nodes, children, leaves, saved, out = {}, {}, {}, {}, []
    for c, v in paths.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(paths[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df, **kw):
    return sorted((tuple(r) for r in prefixtrie.prefix_trie(df, **kw).collect()), key=str)


def odd_turns():
    rnd = random.Random(5)
    rows = [(1, None, None, None), (1, 3, "user", "😀 é"), (1, 3, "user", "😀 é"), (2, 5, "user", ""), (-7, 1, "a", "b"), (None, 1, "user", "x"), (205, 1, "user", "no base")]
    rows += [(c, t, rnd.choice("ab"), rnd.choice(["x", "yy", "zzz"])) for c in range(300, 420) for t in range(rnd.randrange(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in range(500, 540) for t in range(4)]
    return rows + [(700, t, "user", str(t % 3)) for t in range(60)]


@pytest.mark.parametrize("sizes", [{}, {"tier": 4, "band": 3}, {"tier": 2, "band": 7}])
def test_trie_equals_plain(spark, sizes):
    rows = odd_turns()
    assert trie(conversations(spark, rows).repartition(7), **sizes) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie(conversations(spark, [])) == trie(conversations(spark, [(None, 1, "a", "b")])) == []


def test_long_conversation_spans_partitions(spark):
    rows = [(9, t, "u", f"{t % 5}") for t in range(3000)] + [(9 + 100 * k, 0, "u", "0") for k in range(1, 5)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert trie(conversations(spark, rows), band=500) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_louds():
    # Two tops; the first has two children, of which the second has one.
    up = np.array([-1, -1, 0, 0, 3])
    f = prefixtrie.Forest(up, np.array([5, 9, 6, 6, 7]))
    assert "".join(str(int(b)) for b in f.bits) == "11011000100"
    assert f.parent.tolist() == [-1, -1, 0, 0, 3] and f.degree().tolist() == [2, 0, 0, 1, 0]
    assert f.rollup(np.array([1, 2, 4, 8, 16])[f.order]).tolist() == [29, 2, 4, 24, 16]


# ---- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, slot long, score string"


def plain_negatives(rows):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for a, la, qa in kept:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, lb) for i, lb, q in kept)
        for minus, i, _ in [x for x in scored if x[2] == la and x[1] != a][:5]:
            rest = [x for x in scored if x[2] != la and 80 * -minus <= 100 * -x[0] <= 100 * -minus][:5]
            out += [(a, i, r + 1, x[1], -minus, -x[0]) for r, x in enumerate(rest)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in hardneg.mine(df, **kw).collect())


def odd_vectors():
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(0, 0.2, 12)], int(rnd.integers(0, 3))) for i in range(600)]
    rows += [(700, [0.1] * 12, 1), (700, [0.1] * 12, 1), (701, [0.1] * 12, 1), (701, [0.1] * 12, 1), (702, [0.1] * 12, 2), (800, [0.0] * 12, 0), (801, [0.0] * 12, 0), (802, [0.0] * 12, 1)]
    rows += [(900, None, 1), (901, [0.1] * 12, None), (902, [None] + [0.1] * 11, 1), (903, [math.nan] * 12, 1), (904, [math.inf] * 12, 1), (None, [9.0] * 12, 1)]
    return rows + [(1000, [], 4), (1001, [0.5], 4), (1002, [0.5, 0.5], 5), (1100, [-0.3] * 12, 2)]


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 200, "seed_part": 2}])
def test_negatives_equal_plain(spark, sizes):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], VECTORS).repartition(5)
    assert mined(df, **sizes) == plain_negatives(rows) and len(plain_negatives(rows)) > 50


def test_negatives_of_nothing(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == mined(spark.createDataFrame([(100, [1.0], 1, 1, "s")], VECTORS)) == []


def test_products_drop_only_what_cannot_qualify():
    rnd = np.random.default_rng(1)
    for spread in (3, 200, 5000):
        a, r = rnd.integers(-spread, spread, (20, 16)), rnd.integers(-spread, spread, (3000, 16))
        s = a @ r.T
        low, high = np.quantile(s, 0.95, axis=1).astype(np.int64), np.quantile(s, 0.99, axis=1).astype(np.int64)
        i, j, got = hardneg.products(a, r, np.ones(s.shape, bool), low, high)
        want = (s >= low[:, None]) & (s <= high[:, None])
        assert (got == s[i, j]).all() and sorted(zip(i, j)) == sorted(zip(*np.nonzero(want)))
        i, j, got = hardneg.products(a, r, np.ones(s.shape, bool), np.full(20, -(1 << 60)), np.full(20, 1 << 60), best=5)
        for k in range(20):
            assert sorted(got[i == k])[-5:] == sorted(s[k])[-5:]


# ---- context mixing

TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "the cat The dog the cat"), (5, "le chat le chien"), (6, "x" * 3000 + " é 😀"), (7, "the cat sat"), (7, "the cat sat"), (None, "no id the"), (8, "a b a b a b c"), (10, "unseen words here the cat")]


def texts(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "w") for i, t in rows], "doc_id long, text string, slice long, k long, word string")


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)] + [b""]


def test_scores_and_base(spark):
    train = F.coalesce(F.col("doc_id") != 10, F.lit(True))
    got = sorted(mixing.score(texts(spark, TEXTS), train).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    c = Counter(w for i, t in TEXTS if i != 10 for w in tokens(t))
    total = sum(c.values())
    for r, (i, t) in zip(got, sorted(TEXTS, key=lambda x: (str(x[0]), len(tokens(x[1]))))):
        w = tokens(t)
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.trains) == (i, len(w), sum(x in c for x in w), total, i != 10)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (len(c) + 1))) for x in w))
        assert r.score < 0 and math.isfinite(r.score)
        size = len((t or "").encode())
        assert r.bits_per_byte == (pytest.approx(-r.score * math.log2(10) / size) if size else None)


def test_nothing_to_learn(spark):
    assert mixing.score(texts(spark, []), F.lit(True)).count() == 0
    got = mixing.score(texts(spark, TEXTS), F.lit(False)).collect()
    assert len(got) == len(TEXTS) and all(r.train_tokens == r.n_known == 0 and math.isfinite(r.score) for r in got)


def words_of(spark, counted):
    rows = [(bytearray(w), *[n if i == 0 else 0 for i in range(mixing.CLASSES)], n) for w, n in counted.items()]
    return spark.createDataFrame(rows, "word binary, " + ", ".join(f"n{i} long" for i in range(mixing.CLASSES)) + ", c long")


WORDS = {b"": 9, b"the": 5, b"then": 2, b"thesis": 1, b"cat": 4, b"cats": 1, "é".encode(): 1, b"the the": 0, b"zz": 0}


def plain_contexts(word):
    """For each bit: the four contexts with the bits before it, and the bit."""
    x = word + b" "
    for i, byte in enumerate(x):
        before = b" " * 3 + x[:i]
        for j in range(8):
            node = (1 << j) | (byte >> (8 - j))
            yield [(0, before[-1:], node), (1, before[-2:], node), (2, before[-3:], min(i, 3), node), (3, x[:i], node)], byte >> (7 - j) & 1


def test_counts_of_bits_equal_plain(spark):
    table = np.zeros((mixing.SLOTS, 2), np.int64)
    for r in mixing._counted(words_of(spark, WORDS)).collect():
        own = np.frombuffer(bytes(r.counts), "<u2").reshape(-1, 2)
        table[r.block * mixing.BLOCK :][: mixing.BLOCK] = own[: mixing.SLOTS - r.block * mixing.BLOCK]
    plain = Counter()
    for w, n in WORDS.items():
        for contexts, bit in plain_contexts(w):
            for c in contexts:
                plain[c, bit] += n
    for w in WORDS:
        t = mixing.Bytes(pa.array([w]))
        want = list(plain_contexts(w))
        for j in range(8):
            slots, bits = t.slots(j)
            for i in range(len(w) + 1):
                contexts, bit = want[8 * i + j]
                assert bits[i] == bit
                assert [table[s[i]].tolist() for s in slots] == [[plain[c, 0], plain[c, 1]] for c in contexts]


def test_all_words_of_a_byte_have_a_probability_of_one_at_most(spark):
    table = np.zeros((mixing.SLOTS, 2), "<u2")
    for r in mixing._counted(words_of(spark, WORDS)).collect():
        at = r.block * mixing.BLOCK
        table[at : at + mixing.BLOCK] = np.frombuffer(bytes(r.counts), "<u2").reshape(-1, 2)[: mixing.SLOTS - at]
    w = np.random.default_rng(3).normal(0.3, 0.2, (mixing.INPUTS, mixing.GATES))
    shared = spark.sparkContext.broadcast((table.tobytes(), w, np.random.default_rng(4).normal(0, 1, mixing.GATES * mixing.STEPS)))
    # The first byte of a word is any of 256; the end mark first is the empty word.
    firsts = {b"": 1} | {bytes([b]): 0 for b in range(256) if b != 0x20}
    totals = np.array([1] + [0] * (mixing.CLASSES - 1))
    got = mixing._by_word(words_of(spark, firsts), shared).toArrow()
    by_class = mixing._unpacked(got.column("classes"))
    assert by_class.sum() == 1 and (by_class.sum(1) == got.column("c").to_numpy()).all()
    logs = mixing._experts(got.column("c").to_numpy(), got.column("spelling").to_numpy(), by_class, totals, 1)
    assert (0 < np.exp(logs).sum(0)).all() and (np.exp(logs).sum(0) <= 1 + 1e-6).all()
    # The end mark alone closes the empty word: with all that may follow a first byte, probabilities sum to one.
    t = mixing.Bytes(pa.array([bytes([b]) for b in range(256)]))
    first = np.zeros(256)
    for j in range(8):
        x, gate, bit = mixing._inputs(table.view("<u4").ravel(), t, j, False)
        z = mixing._mixed(w, x, gate)
        z = np.clip((z + shared.value[2][gate * mixing.STEPS + mixing._step(z)]) / 2, -mixing.LIMIT, mixing.LIMIT)
        first += -np.log1p(np.exp(np.where(bit == 1, -z, z)))[t.starts]
    assert np.exp(first).sum() == pytest.approx(1)


def test_gate_equals_plain(monkeypatch):
    monkeypatch.setattr(mixing, "TOKENS_AT_ONCE", 7)
    monkeypatch.setattr(mixing, "MEMORY", 5)
    rnd = np.random.default_rng(2)
    n, kinds = 60, 9
    logs = np.log(rnd.uniform(1e-7, 0.3, (kinds, len(mixing.EXPERTS) - 1)))
    token, text = rnd.integers(0, kinds, n), np.repeat([0, 1, 2], [1, 29, 30])
    place = np.arange(n) - np.array([0, 1, 30])[text]
    before = np.array([(token[i - place[i] : i] == token[i]).sum() for i in range(n)])
    assert (mixing._repeats(text, token, kinds) == before).all()
    so_far = before / np.maximum(place, 1)
    got = mixing._log_p(logs, token, so_far, place)
    experts = lambda i: [math.exp(logs[token[i], 0]), math.exp(logs[token[i], 1]), so_far[i], *np.exp(logs[token[i], 2:])]
    for i in range(n):
        past = range(i - min(place[i], 5), i)
        weight = [e * math.exp(mixing.PACE * sum(math.log(max(experts(x)[k], mixing.FLOOR)) for x in past) / math.sqrt(max(len(past), 1))) for k, e in enumerate(mixing.EXPERTS)]
        if not place[i]:
            weight[2] = 0
        want = sum(a * b for a, b in zip(weight, experts(i))) / sum(weight)
        assert got[i] == pytest.approx(math.log(want))


def test_known_words_beat_noise(spark):
    rnd = random.Random(1)
    good = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))) for i in range(60)]
    noise = [(1000, " ".join("".join(rnd.choice("qxzjkv") for _ in range(6)) for _ in range(30)))]
    got = {r.doc_id: r for r in mixing.score(texts(spark, good + noise), F.col("doc_id") % 10 != 0).collect()}
    assert all(got[i].score > got[1000].score + 20 for i in range(0, 60, 10))
    assert sum(got[i].score for i in range(0, 60, 10)) > sum(got[i].base_score for i in range(0, 60, 10)) - 5


def test_weights_follow_the_errors_of_a_words_bits(spark):
    rnd = np.random.default_rng(8)
    table = rnd.integers(0, 40, (mixing.SLOTS, 2)).astype("<u2")
    w, fix = rnd.normal(0.3, 0.2, (mixing.INPUTS, mixing.GATES)).astype(np.float32), rnd.normal(0, 1, mixing.GATES * mixing.STEPS).astype(np.float32)
    # The last one is longer than what is worked on at once.
    spelled = {b"": 1, b"a": 1, b"word": 1, b"another": 1, bytes(rnd.integers(97, 100, mixing.BYTES_AT_ONCE + 99).astype(np.uint8)): 1}
    got = {bytes(r.word): r.spelling for r in mixing._by_word(words_of(spark, spelled), spark.sparkContext.broadcast((table.tobytes(), w, fix))).collect()}
    for word in spelled:
        t = mixing.Bytes(pa.array([word]))
        bits = [mixing._inputs(table.view("<u4").ravel(), t, j, False) for j in range(8)]
        x = np.stack([np.stack(b[0], 1) for b in bits], 1).reshape(-1, mixing.INPUTS).astype(np.float64)
        gate, bit = (np.stack([b[k] for b in bits], 1).ravel() for k in (1, 2))
        moved, total = np.zeros(mixing.INPUTS), 0.0
        z0 = (w.T[gate] * x).sum(1)
        for i, (z, y, g, one) in enumerate(zip(z0, x, gate, bit)):
            # Steps of the correction are rounded, so what lies at an edge may go either way.
            s = z + mixing.RATE / np.sqrt(max(i, 1)) * (moved @ y)
            v = np.clip((s + fix[g * mixing.STEPS + mixing._step(s)]) / 2, -mixing.LIMIT, mixing.LIMIT)
            total -= np.log1p(np.exp(-v if one else v))
            moved = moved + (one - mixing._squash(z)) * y
        assert got[word] == pytest.approx(total, rel=1e-4, abs=1e-3)
