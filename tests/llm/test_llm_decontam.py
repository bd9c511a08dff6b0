from __future__ import annotations

import hashlib
import re

import numpy as np
from edge_rows import edge_documents, empty_documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from listweave.llm import decontam, fmindex

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, bench, window=10):
    phrases = {}
    for item, text in bench:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            phrases.setdefault(tuple(words[i : i + window]), set()).add(item)
    lengths = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        words = WORD.findall(lower(text))
        hit, items = [False] * len(words), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                found = phrases.get(tuple(words[i : i + n]))
                if found:
                    hit[i : i + n] = [True] * n
                    items |= {str(x) for x in found if x is not None}
        text = ",".join(sorted(items))
        out.append(
            (doc, len(words), sum(hit), len(items), hashlib.sha256(text.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def report(docs, bench, **kw):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    rows = decontam.decontamination_report(docs, bench, **kw).collect()
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in rows)
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_report_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    expected = brute(pairs(docs, "doc_id", "text"), pairs(bench, "item_id", "text"))
    assert report(docs, bench) == expected
    assert sum(r[2] for r in expected) > 0


def test_edges(spark):
    docs = edge_documents(spark)
    first = prose(1, 60).split()
    items = [
        (1, " ".join(first[5:20])),
        (1, "one"),
        (2, " ".join(first[10:18])),
        (None, " ".join(prose(2, 40).split()[:12])),
        (3, None),
        (4, "..."),
        (5, "Déjà   VU, naïve"),
        (10, "x" * 5000),
        (6, " ".join(first[-12:])),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute(pairs(docs, "doc_id", "text"), items)
    assert report(docs, bench) == expected
    assert {r[0] for r in expected if r[2]} == {1, 2, 3, 8, 9, 12}
    # A benchmark in several broadcasts gives the same.
    found = decontam.with_hits(docs, bench, ["doc_id"], "found", block_bytes=20)
    got = sorted((r["doc_id"] or -1, r["found"]["n_hit"], r["found"]["items"]) for r in found.collect())
    whole = decontam.with_hits(docs, bench, ["doc_id"], "found")
    assert got == sorted(
        (r["doc_id"] or -1, r["found"]["n_hit"], r["found"]["items"]) for r in whole.collect()
    )
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r[2] == 0 for r in report(docs, none))
    assert report(empty_documents(spark), bench) == []


def test_passages_are_cut_out(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    text = f"Start here. {passage.upper()}, and the  end."
    docs = spark.createDataFrame(
        [(1, text, len(text), "x"), (2, "All clean here", 3, None), (3, None, None, None)],
        "doc_id bigint, text string, n_chars bigint, _found string",
    )
    bench = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    clean = decontam.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    cut = "Start here. , and the  end."
    assert sorted(map(tuple, clean.collect())) == [
        (1, cut, len(cut), "x"),
        (2, "All clean here", 3, None),
        (3, None, None, None),
    ]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=80), st.integers(1, 4))
def test_index_finds_all_places(symbols, length):
    text = np.array(symbols, np.int64)
    index = fmindex.FMIndex(text, sample=3)
    phrases = np.array(
        [p for p in np.ndindex(*(6,) * length) if 0 not in p] or [[1] * length], np.int64
    )
    low, high = index.search(phrases, np.full(len(phrases), length))
    place, owner = index.locate(low, high)
    for i, phrase in enumerate(phrases.tolist()):
        expected = [s for s in range(len(symbols)) if symbols[s : s + length] == phrase]
        assert sorted(place[owner == i].tolist()) == expected
