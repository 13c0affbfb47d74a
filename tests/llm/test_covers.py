"""op12: against brute force on texts with planted passages, at other lengths and covers, and the defined cases."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from strandline.llm import common, covers

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("block", T.StringType()), T.StructField("Times", T.StringType())])


def brute(rows, length):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = {}
    for _, w in docs:
        for s in range(len(w) - length + 1):
            seen[tuple(w[s : s + length])] = seen.get(tuple(w[s : s + length]), 0) + 1
    out = []
    for i, w in docs:
        gone = {k for s in range(len(w) - length + 1) if seen[tuple(w[s : s + length])] > 1 for k in range(s, s + length)}
        out.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in covers.repeated_words(df, **options).collect())


def corpus(seed, n=60, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, words))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            k, cut = rng.randint(0, len(w)), rng.randint(0, 15)
            w[k:k] = p[cut:]
        rows.append((i, rng.choice([" ", "\n", "\t\v"]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows, 35)


@pytest.mark.parametrize("length,period,cover", [(9, 7, (1, 2, 4)), (7, 7, (1, 2, 4)), (20, 13, (0, 1, 3, 9)), (3, 3, (0, 1))])
def test_other_covers(spark, length, period, cover):
    rng = random.Random(length)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(99, "a " * 50)]
    assert run(spark, rows, length=length, period=period, cover=cover) == brute(rows, length)


def test_every_alignment_is_found():
    """Of two equal windows at any two positions some pair of hashed positions lies at one distance."""
    assert covers.is_cover(covers.PERIOD, covers.COVER) and not covers.is_cover(21, (0, 1, 2))
    for a in range(21):
        for b in range(21):
            assert any((a + k) % 21 in covers.COVER and (b + k) % 21 in covers.COVER for k in range(21))


def test_cover_is_checked(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        covers.repeated_words(df, cover=(0, 1))
    with pytest.raises(ValueError):
        covers.repeated_words(df, length=20)


def test_nulls_repeats_short_and_empty(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(1, None), (2, ""), (3, " \n"), (4, passage), (4, passage), (4, "other"), (None, passage), (None, None), (None, None), (5, "x " + passage[:-5]), (6, " ".join(f"q{k}" for k in range(34))), (7, " ".join(f"q{k}" for k in range(34)))]
    assert run(spark, rows) == brute(rows, 35)
    assert run(spark, []) == []


def test_very_long_text_and_hot_rows(spark):
    rng = random.Random(9)
    long = " ".join(str(rng.randrange(1 << 40)) for _ in range(120_000))
    w = long.split()
    rows = [(1, long), (2, " ".join(["new", *w[70_000:70_050], "end"]))] + [(None, "same text " * 20)] * 300 + [(3, "")] * 300
    assert run(spark, rows) == brute(rows, 35)


def test_equal_rows_are_summed_before_they_are_dealt(spark):
    df = spark.createDataFrame([(1, "a")] * 500 + [(k, f"t{k}") for k in range(100)], "doc_id long, text string")
    got = common.tallied(df, 6).collect()
    assert len(got) == 101 and sum(r["times"] for r in got) == 600


def test_places_do_not_depend_on_the_order_of_rows():
    rows = [(k % 7 if k % 5 else None, f"a{k % 3} b c{k}".encode(), 1 + k % 2) for k in range(40)]
    table = lambda rows: pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "data": [r[1] for r in rows], "times": [r[2] for r in rows]})
    a, b = covers.Words(table(rows)), covers.Words(table(random.Random(1).sample(rows, len(rows))))
    assert a.ids == b.ids and a.data == b.data and (a.hash == b.hash).all() and (a.times == b.times).all()


def test_words_are_hashed_alike_at_any_place(monkeypatch):
    import numpy as np

    words = [b"a", b"b" * 70, b"\xc3\xa9t", b"a", b"\xff\x00", b"c" * 300, b"ab", b"ba", b"c" * 299]
    text = b" \t".join(words * 40) + b" "
    s, h = covers.word_hashes(np.frombuffer(text, np.uint8))
    assert [text[k:].split(None, 1)[0] for k in s.tolist()] == words * 40
    assert len(set(h.tolist())) == len(set(words)) and (h.reshape(40, -1) == h[: len(words)]).all()
    monkeypatch.setattr(covers, "CHUNK", 100)
    covers._powers.cache_clear()
    _, g = covers.word_hashes(np.frombuffer(text, np.uint8))
    covers._powers.cache_clear()
    assert len(set(g.tolist())) == len(set(words)) and (g.reshape(40, -1) == g[: len(words)]).all()
