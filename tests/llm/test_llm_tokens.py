from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from edge_rows import edge_documents, empty_documents
from tokenizers import Tokenizer

from listweave.llm import token_counts, tokens
from listweave.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")
RANKS = tokenizer_file("byte_bpe_50k.tiktoken")


def plain(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def loaded():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_round_trip(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    folder = str(tmp_path / "tokens")
    rows = sorted(tokens.token_index(docs, PATH, folder, length=64).collect())
    tokenizer, at = loaded(), 0
    texts = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    every = []
    for (doc, text), row in zip(texts, rows, strict=True):
        ids = plain(tokenizer, text)
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(row)[:4] == (doc, at, len(ids), crc)
        at += len(ids)
        every += ids
    # Sequences read at random from the files, masks taken off, are the same stream.
    files = sorted(p for p in map(str, (tmp_path / "tokens").iterdir()) if "index" not in p)
    stream = []
    for path in files:
        file = tokens.TokenFile(path)
        order = np.random.default_rng(0).permutation(len(file))
        found = {i: file[i] for i in order.tolist()}
        for i in range(len(file)):
            ids, mask = found[i]
            assert len(ids) == len(mask) == 64
            stream += ids[mask.to_numpy(zero_copy_only=False)].tolist()
            assert not ids.flags.owndata
    assert stream == every


def test_edges(spark):
    docs = edge_documents(spark)
    rows = tokens.token_index(docs, PATH).collect()
    assert len(rows) == docs.count()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows[:3]] == [None] * 3
    ids = [r["doc_id"] for r in rows[3:]]
    assert ids == sorted(ids)
    tokenizer = loaded()
    sizes = {r["doc_id"]: r["n_tokens"] for r in rows if r["doc_id"] is not None}
    for r in docs.filter("doc_id is not null").collect():
        assert sizes[r["doc_id"]] == len(plain(tokenizer, r["text"]))
    assert tokens.token_index(empty_documents(spark), PATH).count() == 0


def test_pieces_equal_whole_texts():
    texts = [
        "a  b", " lead", "tail ", "new\n line", "x \t y", "it's <|endoftext|> ok", "", "  z",
        "tab\tin word", "don't stop", "日本 語 ☃", "a  b c", "1 2 3.5,6", "  ", "\x1c a \x1f",
    ]
    ids, sizes = tokens.Encoder(PATH).encode(pa.array(texts))
    tokenizer, at = loaded(), 0
    for text, size in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + size].tolist() == plain(tokenizer, text)[:-1], text
        at += size


def test_added_tokens_as_in_the_unmodified_library(spark):
    texts = [
        "abc <|endoftext|> def", "plain words only", "<|endoftext|>", "a<|endoftext|>b c d",
        "ends with <|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endof text|> no", "z  <|endoftext|>",
    ]
    tokenizer, at = Tokenizer.from_file(PATH), 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(tokens.token_index(docs, PATH).collect())
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [39305, 220, 50256, 825]
    for text, row in zip(texts, rows, strict=True):
        ids = plain(tokenizer, text)
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(row)[1:4] == (at, len(ids), crc), text
        at += len(ids)


def best_count(word: bytes, vocabulary) -> int:
    """By trying every segmentation."""
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        tries = [
            (best[s][0] + vocabulary[word[s:end]], best[s][1] + 1)
            for s in range(end)
            if word[s:end] in vocabulary
        ]
        top = max(t[0] for t in tries)
        best[end] = (top, min(n for s, n in tries if s == top))
    return best[len(word)][1]


def test_counts_equal_brute_force(spark):
    vocabulary = token_counts.zipf_vocabulary(RANKS)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = {}
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, RANKS).collect()}
    for r in docs.select("doc_id", "text").collect():
        words = r["text"].encode().split()
        total = 0
        for w in words:
            if w not in known:
                known[w] = best_count(b" " + w, vocabulary)
            total += known[w]
        assert got[r["doc_id"]][1:] == (len(words), total)


def test_count_edges(spark):
    docs = edge_documents(spark)
    got = sorted(map(tuple, token_counts.token_counts(docs, RANKS).collect()), key=repr)
    assert len(got) == docs.count()
    assert (4, 0, 0) in got and (5, 0, 0) in got and (6, 0, 0) in got
    vocabulary = token_counts.zipf_vocabulary(RANKS)
    trie = token_counts.Trie(vocabulary)
    long = b" " + b"x" * 5000
    assert (12, 1, trie.segment(long)) in got
    assert trie.count(b" abc") == trie.segment(b" abc") and len(trie) == 5
    assert trie.count(b" abd") == trie.segment(b" abd") and len(trie) == 6
    assert token_counts.token_counts(empty_documents(spark), RANKS).count() == 0
