import hashlib
import random
import zlib

import pytest
from helpers import AWKWARD, docs, words_of
from pyspark.sql import functions as F

from reelsift.llm import queries
from reelsift.llm.periodic import periodic_runs, runs_of


def brute(s, exponent=4, least=6):
    """Runs by trying every period at every place."""
    out = []
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            smaller = (p for p in range(1, q) if all(s[k] == s[k + p] for k in range(i, i + size - p)))
            if j > i and size >= max(least, exponent * q) and next(smaller, None) is None:
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, size, q in runs for i in range(start + q, start + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def edited(doc_id, text):
    h, words = zlib.crc32(str(doc_id).encode()), words_of(text)
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def some_texts(n):
    draw = random.Random(5)
    texts = []
    for k in range(n):
        words = [draw.choice("abc") if k % 2 else f"w{draw.randint(0, 40)}" for _ in range(draw.randint(0, 60))]
        for _ in range(k % 4):
            at, unit = draw.randint(0, len(words)), [draw.choice("xyzé") for _ in range(draw.randint(1, 6))]
            words[at:at] = unit * draw.randint(2, 7) + unit[: draw.randint(0, len(unit))]
        texts.append(draw.choice([" ", "\n", "\t\x0b "]).join(words))
    return texts


@pytest.mark.parametrize("exponent,least", [(2, 2), (3, 5), (4, 6)])
def test_runs_against_brute_force(exponent, least):
    draw = random.Random(exponent)
    for _ in range(600):
        s = [draw.randint(1, draw.choice([1, 2, 3, 9])) for _ in range(draw.randint(1, 70))]
        assert list(map(tuple, runs_of(s, exponent, least).tolist())) == brute(s, exponent, least), s
    for word in ("abaab" * 9, "a" * 50, "ab" * 30 + "a" * 9, "abcabcab" * 5 + "x"):
        s = [ord(c) for c in word]
        assert list(map(tuple, runs_of(s, exponent, least).tolist())) == brute(s, exponent, least), word


def test_texts_against_brute_force(spark):
    texts = some_texts(200) + AWKWARD
    got = {r["doc_id"]: r for r in periodic_runs(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        if len(words := words_of(text)) > 5000:
            continue
        runs = brute(words)
        assert list(map(tuple, got[i]["runs"])) == runs and got[i]["collapsed_text"] == collapsed(words, runs)
    k = len(texts) - len(AWKWARD) + AWKWARD.index("a b " * 20_000)
    assert list(map(tuple, got[k]["runs"])) == [(0, 40_000, 2)] and got[k]["collapsed_text"] == "a b"


def test_query_against_brute_force(spark, tmp_path):
    texts = some_texts(300) + [None, "", "one"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    planted = 0
    for i, text in enumerate(texts):
        words = edited(i, text)
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        planted += words != words_of(text) and bool(runs)
        want = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        r = got[i]
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want and r["n_runs"] == len(runs)
        assert r["runs_sha256"] == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r["collapsed_sha256"] == sha(collapsed(words, runs))
    assert planted > 5


def test_empty_table_clashing_names_and_repeated_rows(spark):
    assert periodic_runs(docs(spark, [])).count() == 0
    clash = docs(spark, ["a a a a a a"] * 2, [None, None]).withColumns({"runs": F.lit(1), "_text": F.lit("mine"), "odd.name": F.lit(2)})
    for r in periodic_runs(clash).collect():
        assert list(map(tuple, r["runs"])) == [(0, 6, 1)] and r["collapsed_text"] == "a" and r["odd.name"] == 2 and r["_text"] == "mine"
