"""Periodic runs against the definition, tried for every period."""

import hashlib
import random
import zlib
from fractions import Fraction

from fieldloom.llm import periodic_runs, queries

SCHEMA = "doc_id long, text string, runs string, start string, best int"


def runs_of(words, least=6, repeats=4):
    found, n = [], len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if j > i and length >= max(least, repeats * q) and not any(part[: length - r] == part[r:] for r in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words)
    dropped = {k for a, length, q in runs for k in range(a + q, a + length)}
    collapsed = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())


def texts(r):
    for k in range(250):
        n = r.choice((0, 1, 3, 8, 30, 90))
        words = [r.choice(("a", "b", "é", "漢字")[: r.randint(1, 4)]) for _ in range(n)]
        if k % 3 == 0 and n:
            p = r.randint(1, 6)
            words += [words[i % min(p, n)] for i in range(r.randint(0, 40))] + ["z"]
        yield k, r.choice((" ", "\t", " \n")).join(words)


def test_runs_equal_the_definition(spark, tmp_path):
    r = random.Random(3)
    rows = [*texts(r), (None, "x x x x x x x"), (None, None), (7, ""), (8, " \t\n"), (8, " \t\n"), (9, "x " * 30_000), (10, " ".join(f"w{k % 977}" for k in range(20_000)))]
    spark.createDataFrame([(i, t, "r", "s", 1) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    want = [expected(i, t) if len(t or "") < 20_000 else None for i, t in rows]
    long = {9, 10}
    assert sorted((x for x in got if x[0] not in long or x[1] != 1), key=str) == sorted((x for x in want if x), key=str)
    by = {x[0]: x for x in got if x[0] in long and x[1] == 1}
    for i, words in ((9, ["x"] * 30_000), (10, [f"w{k % 977}" for k in range(20_000)])):
        if zlib.crc32(str(i).encode()) % 10:
            assert by[i][2:5] == (0, len(words), len(set(words)))
    assert len(got) == len(rows)
    assert len({key(x) for x in got if x[1]}) > 50


def test_ties_and_equal_ends():
    for text in ("a a a a a a", "b a b a b a b a b b b b b b", "a b a b a b a b c a b a b a b a b", "a a b " * 9, "x " + "a " * 9 + "b " + "a " * 9):
        words = text.encode().split()
        s, at = periodic_runs.numbered([words])
        assert periodic_runs.maximal_runs(s, 6, 4) == runs_of(words)


def test_best_takes_the_smallest_start_of_ties(spark):
    df = spark.sql("SELECT array(named_struct('start', 3L, 'length', 9L, 'period', 2L), named_struct('start', 5L, 'length', 18L, 'period', 4L), named_struct('start', 1L, 'length', 8L, 'period', 2L)) AS runs")
    assert df.select(periodic_runs.best().alias("b")).first()["b"]["start"] == 3


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_periodic_runs(spark, str(tmp_path)).collect() == []
