"""Rows that every operator must take: nulls, empty and very long texts, repeats, ties, clashing names."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("_words", "_key", "_values", "_range", "_fences", "values", "node", "tokens", "shard", "kept", "score", "sequence_id", "n_entities", "n_words")


def prose(seed, n, words=400):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(min(n, words) if n < words else n))


def documents():
    """About forty rows; ids are unique but for two equal rows and two null ids."""
    base = prose(1, 200)
    edited = base.split()
    edited[100] = "changed"
    rows = [(i, prose(10 + i, 60 + 7 * i), ("en", "fr")[i % 2], f"s{i % 3}") for i in range(24)]
    rows += [(100, base, "en", "s0"), (101, base, "fr", "s1"), (102, " ".join(edited), None, "s0"), (103, base.upper(), "en", None)]
    rows += [(200, None, "en", "s0"), (201, "", "en", "s0"), (202, " \n\t ", None, None), (203, "one", "en", "s0"), (204, "one two three", "en", "s0"), (205, "One TWO three", "en", "s0")]
    rows += [(300, prose(5, 20000, 20000), "en", "s0"), (301, "x" * 200_000, "en", "s0"), (302, "a.b@" + "c." * 30_000 + "com 1-" * 3000, "en", "s0")]
    rows += [(400, "same row", "en", "s0"), (400, "same row", "en", "s0"), (None, "no id", "en", "s0"), (None, None, None, None)]
    rows += [(500, "Ünïcödé 漢字 🙂 Σ é \x00 <|endoftext|>  two  spaces\r\n", "en", "s0")]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})
