"""Spelling variants against the definition, all pairs tried."""

import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import queries, spelling

SCHEMA = "doc_id long, text string, word string, n string, form int"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    forms, out = {}, []
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        out.append([w, forms[w], w, n, len(close), words[best] if forms[w] else None])
    for row in out:
        while forms[row[2]]:
            row[2] = forms[row[2]]
    return sorted(map(tuple, out), key=str)


def corpus():
    r = random.Random(9)
    base = ["abcdefg", "abcdefgh", "aaaaaaa", "aaaaaaaa", "naïveté", "Überfluss", "ÀÁÂÃÄÅÆ", "mississippi", "x" * 6000, "x" * 5999, "y" * 3000 + "z"]
    heavy = {w: c for w, c in zip(base, (900, 70, 300, 20, 40, 30, 5, 200, 3, 2, 2), strict=True)}
    rows = []
    pool = [w for w, c in heavy.items() for _ in range(c)]
    for w in base[:8]:
        for _ in range(25):
            k = r.randrange(len(w))
            v = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice("abxé") + w[k:], w[:k] + r.choice("abxé") + w[k + 1 :]))
            pool += [v] * r.choice((1, 2, 2, 3, 8))
    r.shuffle(pool)
    for k in range(0, len(pool), 8):
        rows.append((k, r.choice((" ", "-", "1", "\n")).join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in pool[k : k + 8])))
    return [*rows, (None, "abcdefg abcdefgh short"), (None, None), (3, None), (4, ""), (5, "1 2 3"), (0, rows[0][1]), (0, rows[0][1]), (6, "\x00abcdefg퟿漢字abcdefg")]


@pytest.mark.parametrize(("chars", "sent"), [(spelling.SHARD_CHARS, spelling.BROADCAST_BYTES), (400, 4000)])
def test_variants_equal_the_definition(spark, tmp_path, monkeypatch, chars, sent):
    monkeypatch.setattr(spelling, "SHARD_CHARS", chars)
    monkeypatch.setattr(spelling, "BROADCAST_BYTES", sent)
    rows = corpus()
    spark.createDataFrame([(i, t, "w", "n", 1) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in queries.op11_spelling_variants(spark, str(tmp_path)).collect()), key=str)
    want = expected(rows)
    assert got == want
    assert sum(x[1] is not None for x in want) > 20 and any(x[2] not in (x[0], x[1]) for x in want)


def test_no_rows_and_no_words(spark, tmp_path):
    for name, rows in (("a", []), ("b", [(1, "few short", "w", "n", 1)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert queries.op11_spelling_variants(spark, f"{tmp_path}/{name}").collect() == []


def test_a_trie_finds_all_neighbours_once():
    r = random.Random(2)
    for _ in range(150):
        letters = "abé"[: r.randint(1, 3)]
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 50))})
        trie = pickle.loads(pickle.dumps(spelling.Trie(pa.array(words), np.arange(len(words)))))
        asked = words + ["".join(r.choice(letters + "😀") for _ in range(r.randint(1, 8))) for _ in range(20)]
        w, other = trie.near(*spelling.code_points(pa.array(asked)))
        assert sorted(zip(w.tolist(), other.tolist(), strict=True)) == sorted((i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if near(a, b))


def test_counts_are_the_same_in_small_bites(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_COUNTED", 10)
    df = spark.createDataFrame([(k, f"wordnumber{'abcdefghij'[k % 10]} Repeated repeated") for k in range(100)], "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == {"repeated": 200} | {f"wordnumber{c}": 10 for c in "abcdefghij"}
