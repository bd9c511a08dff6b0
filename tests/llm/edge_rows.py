"""Rows that every operator must take: nulls, empty and long texts, repeats, clashing names."""

from __future__ import annotations

WORDS = "the quick brown fox jumps over a lazy dog while seven other animals look on".split()


def prose(seed: int, n: int) -> str:
    state, out = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + str((state >> 16) % 50))
    return " ".join(out)


LONG = prose(99, 20_000)
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, "
    "_fp string, fp int, node string, component_id int, found string, block int, size string, "
    "shard string, virtual_slot int, quality double, key string, `_Text` string, row string"
)


def edge_documents(spark):
    texts = [
        (1, prose(1, 60), "en", "b"),
        (2, prose(1, 60), "en", "a"),
        (2, prose(1, 60), "en", "a"),
        (3, prose(2, 40), None, None),
        (4, None, "en", "a"),
        (5, "", "en", "c"),
        (6, " \t\n ", None, "c"),
        (7, LONG, "fr", "b"),
        (8, "ONE", "en", None),
        (9, "one", "en", "a"),
        (None, prose(3, 30), "fr", "a"),
        (None, prose(3, 30), "fr", "a"),
        (None, None, None, None),
        (10, "déjà vu — naïve café ☃ 日本語 text", "fr", "é"),
        (11, "!!! ??? 12345", "en", "b"),
        (12, "x" * 5000, "en", "b"),
    ]
    clash = ("r", "f", 1, "n", 2, "found", 3, "s", "sh", 4, 0.5, "k", "T", "w")
    return spark.createDataFrame([(*t, len(t[1] or ""), *clash) for t in texts], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def edge_labels(spark):
    return spark.createDataFrame(
        [(1, 1, None), (2, 0, 1), (2, 1, 0), (None, 1, 0), (7, None, 1), (11, 0, 0)],
        "doc_id bigint, quality int, toxic int",
    )


def table_rows(df, *order):
    return sorted(map(tuple, df.select(*order).collect()), key=repr)
