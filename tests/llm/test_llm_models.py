from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from edge_rows import edge_documents, edge_labels, empty_documents

from listweave.llm import ctw, langid, lm_scoring, quality

SF_DIR = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


class PlainTree:
    """Context-tree weighting as a recursion over counts, one decision node at a time."""

    def __init__(self, texts: list[bytes]) -> None:
        self.counts: dict[tuple[bytes, int], list[int]] = {}
        for text in texts:
            data = b"\xff" * ctw.DEPTH + text + b"\xff"
            for i in range(ctw.DEPTH, len(data)):
                node = 1
                for k in range(7, -1, -1):
                    bit = data[i] >> k & 1
                    for depth in range(ctw.DEPTH + 1):
                        key = (data[i - depth : i], node)
                        self.counts.setdefault(key, [0, 0])[bit] += 1
                    node = node << 1 | bit
        self.children: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        for context, node in self.counts:
            if context:
                self.children.setdefault((context[1:], node), []).append((context, node))
        self.known: dict[tuple[bytes, int], float] = {}

    def weighted(self, key) -> float:
        if key not in self.known:
            a, b = self.counts[key]
            own = (
                math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi)
                - math.lgamma(a + b + 1)
            )
            if len(key[0]) < ctw.DEPTH:
                below = sum(self.weighted(c) for c in self.children[key])
                own = np.logaddexp(own, below) - math.log(2)
            self.known[key] = own
        return self.known[key]

    def one(self, context: bytes, node: int, depth: int = 0) -> float:
        key = (context[len(context) - depth :], node)
        a, b = self.counts.get(key, (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if depth == ctw.DEPTH:
            return estimate
        if key not in self.counts:
            share = 0.5
        else:
            own = (
                math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi)
                - math.lgamma(a + b + 1)
            )
            share = math.exp(own - math.log(2) - self.weighted(key))
        return share * estimate + (1 - share) * self.one(context, node, depth + 1)

    def score(self, text: bytes) -> float:
        data = b"\xff" * ctw.DEPTH + text + b"\xff"
        total = 0.0
        for i in range(ctw.DEPTH, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                p = self.one(data[i - ctw.DEPTH : i], node)
                total += math.log10(p if bit else 1 - p)
                node = node << 1 | bit
        return total


def lowered(text):
    return (text or "").encode().lower()


def plain_scores(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows if i is not None}
    learned = [lowered(t) for i, t in rows if i is not None and not held[i]]
    counts: dict[bytes, int] = {}
    for text in learned:
        for w in text.split():
            counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values()) + len(learned)
    v = len(counts) + bool(learned)
    tree = PlainTree(learned)
    out = []
    for i, t in rows:
        text = lowered(t)
        c = [*(counts.get(w, 0) for w in text.split()), len(learned)]
        base = sum(math.log10((x + 1) / (n + v + 1)) for x in c)
        out.append((i, held.get(i, False), len(c), sum(x > 0 for x in c), n, base, tree.score(text)))
    return out


def assert_scores(got, expected):
    got = sorted(got, key=lambda r: (r["doc_id"] or -1, r["n_tokens"]))
    expected = sorted(expected, key=lambda r: (r[0] or -1, r[2]))
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert tuple(g)[:5] == e[:5]
        assert g["base_score"] == pytest.approx(e[5], rel=1e-9)
        assert g["score"] == pytest.approx(e[6], rel=1e-9)


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("n_chars < 700")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert len(rows) > 20
    assert_scores(lm_scoring.scored(docs.repartition(3)).collect(), plain_scores(rows))


def test_score_edges(spark):
    docs = edge_documents(spark).filter("text is null or length(text) < 6000")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert_scores(lm_scoring.scored(docs).collect(), plain_scores(rows))
    assert lm_scoring.scored(edge_documents(spark)).count() == edge_documents(spark).count()
    assert lm_scoring.scored(empty_documents(spark)).count() == 0


def test_small_blocks_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    whole = {r["doc_id"]: r["score"] for r in lm_scoring.scored(docs).collect()}
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lm_scoring, "TEXT_BYTES", 5_000)
    for r in lm_scoring.scored(docs).collect():
        assert r["score"] == pytest.approx(whole[r["doc_id"]])


def test_probabilities_of_a_symbol_sum_to_one():
    texts = pa.array(["banana band", "bandana"], pa.large_string())
    grams, _ = lm_scoring.grams_of(texts)
    unique, counts = np.unique(grams, return_counts=True)
    levels = ctw.subtrees(unique, counts.astype(float), 0).levels
    for context in (unique >> 8).tolist():
        every = (context << 8) + np.arange(256)
        assert (10 ** ctw.log10_probabilities(every, levels)).sum() == pytest.approx(1)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 7.9, 8, 20.5, 1e6, 1e9])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.predicted(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    docs = edge_documents(spark)
    rows = langid.predicted(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    for i in (4, 5, 6):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[11]["lang_pred"] == "und" and by[10]["lang_pred"] in ("en", "fr")
    assert langid.predicted(empty_documents(spark)).count() == 0
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.predicted(unlabelled).collect()} == {"und"}


def test_network_equals_plain_convolution():
    rng = np.random.default_rng(0)
    net = langid.train([b"abcabc" * 20, b"xyzxyz" * 20], np.array([0, 1]), 2)
    codes = rng.integers(97, 123, (5, langid.WINDOW)).astype(np.uint8)
    codes[3, 40:] = 0
    got = langid.probabilities(net, codes)
    for row in range(5):
        padded = np.concatenate([codes[row], np.zeros(3, np.uint8)])
        top = np.full(net.kernel.shape[1], -np.inf)
        for p in range(langid.WINDOW):
            patch = net.embedding[padded[p : p + 4]].reshape(-1)
            top = np.maximum(top, patch @ net.kernel)
        score = np.maximum(top + net.shift, 0) @ net.out + net.bias
        assert got[row] == pytest.approx(np.exp(score) / np.exp(score).sum(), rel=1e-4, abs=1e-6)


def test_quality_tells_junk_from_clean(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.quality_report(docs, labels).collect()
    assert len(rows) == docs.count()
    judged = [(r["kept"], good[r["doc_id"]]) for r in rows if r["doc_id"] in good]
    assert np.mean([kept for kept, q in judged if q == 1]) >= 0.98
    assert np.mean([not kept for kept, q in judged if q == 0]) >= 0.95
    again = quality.quality_report(docs, labels).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_quality_keeps_the_k_highest_keys(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality.quality_report(docs, labels).collect()
    kept = [r["key"] for r in rows if r["kept"]]
    gone = [r["key"] for r in rows if not r["kept"] and r["key"] is not None]
    assert min(kept) > max(gone)


def test_log_weights_equal_a_plain_count(spark):
    import xxhash

    texts = ["Good day, good people", "bad!! bad!! bad!! bad!!", "good DAY", None, " "]
    grams, counts = quality.gram_buckets(pa.array(texts), 1 << 16)
    assert counts.tolist() == [10, 16, 4, 0, 0]
    token = xxhash.xxh64_intdigest("good") & (2**64 - 1)
    token ^= token >> 32
    assert grams[0] == token % (1 << 16) and grams[14 + 12] == grams[0]
    assert quality.log_ratios(np.array([[5, 3], [0, 0]])).tolist() == [0, 0]
    ratio = quality.log_ratios(np.array([[5, 3], [1, 2]]))
    assert ratio == pytest.approx([math.log(2 / 5) - math.log(6 / 10), math.log(3 / 5) - math.log(4 / 10)])


@pytest.mark.parametrize("k", [0, 1, 7, 500, 2999, 3000])
def test_kth_highest(spark, k):
    values = [float((i * 7919) % 1000) * 1e-6 + (i % 3) for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    expected = sorted(values, reverse=True)[k - 1] if k else None
    assert quality.kth_highest(df, k) == expected


def test_quality_edges(spark):
    docs = edge_documents(spark)
    rows = quality.quality_report(docs, edge_labels(spark)).collect()
    assert len(rows) == docs.count()
    assert all(not r["kept"] and r["log_weight"] is None for r in rows if r["doc_id"] in (4, 5, 6))
    kept = quality.quality_documents(docs, edge_labels(spark))
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in rows)
    none = edge_labels(spark).limit(0)
    assert quality.quality_documents(docs, none).filter("text is null").count() == 0
    assert quality.quality_documents(docs, none).count() == docs.count() - 4
    assert quality.quality_report(empty_documents(spark), edge_labels(spark)).count() == 0


@pytest.mark.parametrize("depth", [2, 3, 4, 5, 6])
def test_sequences_of_every_depth(depth):
    texts = ["", "a", "héé", "abcdefgh" * 3, ""]
    grams, sizes = lm_scoring.grams_of(pa.array(texts, pa.large_string()), depth)
    expected = []
    for text in texts:
        data = b"\xff" * depth + text.encode() + b"\xff"
        expected += [int.from_bytes(data[i : i + depth + 1]) for i in range(len(data) - depth)]
    assert grams.tolist() == expected
    assert sizes.tolist() == [len(t.encode()) + 1 for t in texts]


def test_sequences_are_looked_up_in_order(monkeypatch):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 55, 5_000))
    values = rng.random(len(keys))
    place = rng.integers(0, len(keys), 12_345)
    orders = []

    def noted(known, sought, search=np.searchsorted):
        orders.append(bool((np.diff(sought) >= 0).all()))
        return search(known, sought)

    monkeypatch.setattr(lm_scoring, "LOOKUPS_AT_ONCE", 1_000)
    monkeypatch.setattr(np, "searchsorted", noted)
    assert np.array_equal(lm_scoring.looked_up(keys[place], keys, values), values[place])
    assert len(orders) == 13 and all(orders)
    assert len(lm_scoring.looked_up(keys[:0], keys, values)) == 0
