import random

import xxhash
from helpers import AWKWARD, docs, lowered, sentences, words_of
from pyspark.sql import functions as F

from reelsift.llm.components import components
from reelsift.llm.simhash import _merged, links, near_copies, one_of_each, simhash_components
from reelsift.session import materialise


def fingerprint(text):
    w = words_of(lowered(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_against_brute_force(spark):
    base = sentences(40, size=60)
    draw = random.Random(3)
    texts = []
    for k in range(160):
        w = base[k % 40].split()
        if k >= 40 and k % 2:
            w[draw.randrange(len(w))] = "changed"
        texts.append(" ".join(w).upper() if k % 5 == 0 else "  ".join(w))
    texts += AWKWARD + AWKWARD[:3]
    ids = [*range(len(texts) - 3, 3, -1), None, 4, 4, 3, 2, 1][: len(texts)]
    got = sorted((tuple(r) for r in simhash_components(docs(spark, texts, ids)).collect()), key=repr)
    assert got == grouped(list(zip(ids, texts, strict=True)))


def test_links_are_exact_in_crowded_halves(spark):
    draw = random.Random(5)
    prints = {draw.getrandbits(64) for _ in range(60)}
    center = draw.getrandbits(64)
    prints |= {center ^ (1 << i) for i in range(64)} | {center ^ (3 << i) for i in range(63)} | {0, center}
    prints |= {(7 << 32) | draw.getrandbits(32) for _ in range(80)}  # one half in common
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in sorted(prints)]
    df = spark.createDataFrame(signed, "fp long")
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for hot in (1, 20, 10_000):
        got = [tuple(r) for r in links(df, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_the_index_is_never_broadcast(spark):
    half = [(7 << 32 | i * 2654435761 % (1 << 32),) for i in range(40)]
    written = materialise(spark.createDataFrame(half, "fp long"))
    for hot in (1, 10_000):
        plan = links(written, hot)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "Inner" in x]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 164)]
    star = [(7, k) for k in range(300, 340)] + [(339, 5)]
    found = components(spark.createDataFrame(chain + star, "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in found}
    assert len(found) == len(got)
    assert all(got[i] == 100 for i in range(100, 165)) and all(got[k] == 5 for k in [5, 7, *range(300, 340)])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_links_merge_components(spark):
    draw = random.Random(3)
    first, more = ([(draw.randrange(80), draw.randrange(80)) for _ in range(30)] for _ in range(2))
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = {r["node"]: r["root"] for r in _merged(components(table(first)), table(more)).collect()}
    want = {r["node"]: r["root"] for r in components(table(first + more)).collect()}
    assert got == want
    assert _merged(components(table([])), table(more)).count() == components(table(more)).count()
    assert _merged(components(table(first)), table([])).count() == components(table(first)).count()


def test_one_of_each_and_edges(spark):
    assert simhash_components(docs(spark, [])).count() == 0
    df = docs(spark, ["a b c d", "A b c d", "x y z w", None], [3, 1, 2, None]).withColumn("fp", F.lit(1))
    kept = one_of_each(df)
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, None} and kept.columns == df.columns


def alike(rows, least=0.8):
    """Smallest id reachable over texts whose sets of five-word shingles are alike."""
    grams = []
    for _, t in rows:
        w = words_of(lowered(t))
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both and both >= least * len(grams[i] | grams[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return [smallest.get(find(i)) for i in range(len(rows))]


def edited(text, edits, draw):
    w = text.split()
    for at in draw.sample(range(len(w)), edits):
        w[at] = f"new{draw.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_against_brute_force(spark):
    draw, base = random.Random(7), [t for t in sentences(60, seed=21, size=400) if len(t.split()) > 100]
    texts = [*base]
    for t in base:
        texts += [edited(t, max(1, len(t.split()) // 120), draw), t.upper(), edited(t, len(t.split()) // 4, draw)]
    texts += AWKWARD + AWKWARD[:3]
    ids = [*range(len(texts) - 3, 0, -1), None, 0, 0]
    rows = list(zip(ids, texts, strict=True))
    want = alike(rows)
    got = near_copies(docs(spark, texts, ids)).collect()
    assert len(got) == len(rows)
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], r["component_id"])
    held = [(found[i], w) for (i, _), w in zip(rows, want, strict=True) if i is not None]
    assert not [x for x in held if x[0] < x[1]]  # nothing is joined that is not alike
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_a_large_group_of_near_copies_is_one(spark):
    draw = random.Random(8)
    base = " ".join(f"w{draw.randrange(5000)}" for _ in range(300))
    texts = [edited(base, 3, draw) for _ in range(400)] + sentences(100, seed=22, size=200)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs(spark, texts)).collect()}
    assert sum(got[i] == 0 for i in range(400)) >= 396
    assert all(got[i] >= 400 for i in range(400, 500))


def test_every_pair_just_above_the_threshold_is_linked(spark):
    draw, texts = random.Random(9), []
    for i in range(400):
        base = [f"w{draw.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        if i % 2:
            other = base + [f"x{draw.randrange(10**6)}" for _ in range(50)]  # 200 of 250: a likeness of 0.8
        else:
            other = base.copy()
            for at in range(10, 50, 10):  # four edits: 180 of 220
                other[at] = f"new{draw.randrange(10**6)}"
        texts += [" ".join(base), " ".join(other)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(800)}


def test_repeats_within_a_text_do_not_hide_a_link(spark):
    draw = random.Random(10)
    base = " ".join(f"w{draw.randrange(10**6)}" for _ in range(200))
    line = " ".join(f"line{k}" for k in range(12))
    got = near_copies(docs(spark, [f"{base} {line}", f"{base} {' '.join([line] * 40)}"])).collect()
    assert {r["component_id"] for r in got} == {0}


def test_texts_alike_meet_where_the_least_is_like_neither(spark):
    draw, texts = random.Random(11), []
    for _ in range(60):
        template = [f"t{draw.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        for own in (60, 20, 20):  # the last two are alike to 200 of 240, the first to them to 200 of 280
            texts.append(" ".join(template + [f"w{draw.randrange(10**6)}" for _ in range(own)]))
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs(spark, texts)).collect()}
    assert got == {i: i - (i % 3 == 2) for i in range(180)}


def test_one_of_each_takes_what_simhash_links(spark):
    """Texts whose fingerprints are two bits apart or less, though few of their different shingles are common."""
    draw = random.Random(12)
    line = " ".join(["one two three four five six seven eight nine ten eleven"] * 300)
    texts = [f"{line} {' '.join(f'w{draw.randrange(10**6)}' for _ in range(30))}" for _ in range(3)]
    assert all((fingerprint(texts[0]) ^ fingerprint(t)).bit_count() <= 2 for t in texts)
    assert len(set(alike(list(enumerate(texts))))) == 3
    base = " ".join(f"v{draw.randrange(10**6)}" for _ in range(200))
    texts += [base, edited(base, 3, draw)]
    assert (fingerprint(texts[3]) ^ fingerprint(texts[4])).bit_count() > 2
    assert {r["doc_id"] for r in one_of_each(docs(spark, texts)).collect()} == {0, 3}
