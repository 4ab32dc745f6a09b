import math
from collections import Counter, defaultdict

from helpers import AWKWARD, docs, sentences, table, words_of
from pyspark.sql import functions as F

from reelsift.llm import mixing


def targets(sizes):
    """By sharing the excess again and again; exact enough for sums of words."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, got, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while True:
        rest = total - sum(got[s] for s in names if s not in open_)
        share = rest / max(sum(weight[s] for s in open_), 1)
        over = {s for s in open_ if weight[s] * share > 3 * sizes[s]}
        if not over:
            return got | {s: weight[s] * share for s in open_}
        for s in over:
            got[s] = 3.0 * sizes[s]
        open_ -= over


def check(spark, rows, **options):
    df = table(spark, rows)
    got = mixing.taken_words(df, **options).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, len(words_of(r[1]))) for r in rows)
    again = mixing.taken_words(df.repartition(5), **options).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_targets_and_draws(spark):
    texts = sentences(300, size=90)
    rows = [(k, t, "en", ("a", "b", "c", "é", "Z", None)[min(k % 11, 5)], 0) for k, t in enumerate(texts)]
    check(spark, rows, block_words=64, shards=7)
    check(spark, rows, block_words=1000, shards=1)


def test_small_sources_are_repeated_at_most_three_times(spark):
    texts = sentences(100, size=30)
    check(spark, [(k, t, "en", "tiny" if k < 2 else "a", 0) for k, t in enumerate(texts)], block_words=16)


def test_awkward_rows(spark):
    rows = [(k, t, "en", f"s{k % 2}", 0) for k, t in enumerate(AWKWARD * 2)]
    check(spark, [*rows, rows[3], rows[3], (None, "no id at all", None, None, None), (None, None, None, None, None)], block_words=100)
    check(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])
    assert mixing.taken_words(docs(spark, [])).count() == 0
    clash = docs(spark, ["a b", "c"]).withColumns({"size": F.lit(1), "target": F.lit(2), "nth": F.lit(3), "slice": F.lit(4)})
    assert mixing.taken_words(clash).count() == 2


def test_draws_are_disjoint_and_shards_even(spark):
    rows = [(k, t, "en", f"s{k % 3}", 0) for k, t in enumerate(sentences(200, size=90))]
    drawn = mixing.draws(table(spark, rows), block_words=32, shards=8).filter("words > 0").collect()
    spans, blocks = defaultdict(list), defaultdict(set)
    for r in drawn:
        spans[r["doc_id"], r["epoch"]].append((r["first_word"], r["words"]))
        blocks[r["shard"]].add((r["source"], r["place"]))
    for pieces in spans.values():
        at = 0
        for first, n in sorted(pieces):
            assert first >= at
            at = first + n
    sizes = [len(b) for b in blocks.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    assert sum(sizes) == len(set().union(*blocks.values()))


def test_shards_get_what_the_tree_gives_them(spark, monkeypatch):
    rows = [(k, t, "en", f"s{k % 4}", 0) for k, t in enumerate(sentences(300, size=90))]
    leaves, tree = [], mixing.splitting_tree

    def kept(*args):
        done = tree(*args)
        leaves.extend(done.collect())
        return done

    monkeypatch.setattr(mixing, "splitting_tree", kept)
    got = mixing.draws(table(spark, rows), block_words=16, shards=6).filter("words > 0").collect()
    quota = {(r["shard"], s): q for r in leaves for s, q in enumerate(r["quotas"]) if q}
    blocks = defaultdict(set)
    for r in got:
        blocks[r["shard"], int(r["source"][1])].add(r["place"])
    assert {k: len(v) for k, v in blocks.items()} == quota
    shares = {k: q / sum(n for (s, _), n in quota.items() if s == k[0]) for k, q in quota.items()}
    assert len({round(v, 3) for k, v in shares.items() if k[1] == 0}) > 1  # drawn, not dealt out evenly


def test_rows_tell_their_shards_and_places(spark):
    df = table(spark, [(k // 2, t, "en", f"s{k % 3}", 0) for k, t in enumerate(sentences(60, size=90))])
    pieces = defaultdict(list)
    for r in mixing.draws(df, block_words=16, shards=4).filter("words > 0").collect():
        pieces[r["doc_id"], r["source"], r["of"]].append((r["shard"], r["words"]))
    want = Counter()
    for (doc, source, _), own in pieces.items():
        by_shard = Counter()
        for shard, n in own:
            by_shard[shard] += n
        want[doc, source, tuple(sorted(by_shard.items()))] += 1
    got = mixing.taken_words(df, block_words=16, shards=4).filter("taken > 0").collect()
    assert Counter((r["doc_id"], r["source"], tuple(tuple(map(int, s.split(":"))) for s in r["shards"].split())) for r in got) == want
    other = mixing.taken_words(df, block_words=16, shards=4, seed=12).filter("taken > 0").collect()
    assert {r["places"] for r in got} != {r["places"] for r in other}


def test_mix_gives_the_words_drawn(spark):
    """Every id twice, rows that repeat throughout, and no id: each source gets its target in words."""
    texts = sentences(150, size=120)
    rows = [(k // 2, t, "en", ("a", "b", "b", "c", None)[k % 5], 0) for k, t in enumerate(texts)]
    rows += [rows[7]] * 3 + [(None, texts[5], "en", "a", 0)] * 2 + [(k, t, "en", "d", 0) for k, t in enumerate(AWKWARD)]
    df = table(spark, rows).withColumns({"shard": F.lit("mine"), "pieces": F.lit(1), "of": F.lit(2)})
    got = mixing.mixed(df, block_words=50, shards=3).collect()
    sizes, given = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    for r in got:
        assert len(words_of(r["text"])) == r["words"] and 0 <= r["shard"] < 3 and r["of"] == 2
        given[r["source"]] += r["words"]
    want = targets(sizes)
    assert all(abs(given[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    texts_of = defaultdict(list)
    for r in rows:
        texts_of[r[0], r[3]].append(" ".join(words_of(r[1])))
    assert all(any(r["text"] in t for t in texts_of[r["doc_id"], r["source"]]) for r in got)


def test_permutation_and_tree(spark):
    n = spark.range(500).select("id", F.lit(500).cast("long").alias("n"))
    moved = [r[0] for r in n.select(mixing.permuted(F.col("id"), F.col("n"), F.lit(3), F.lit(1))).collect()]
    assert sorted(moved) == list(range(500)) and moved != list(range(500))
    quotas = [1000, 0, 1, 37, 100_000]
    one = spark.createDataFrame([(quotas,)], "quotas array<long>")
    leaves = mixing.splitting_tree(one, 13, 4).collect()
    assert sorted(r["shard"] for r in leaves) == list(range(13))
    assert [sum(c) for c in zip(*(r["quotas"] for r in leaves), strict=True)] == quotas
    sums = [sum(r["quotas"]) for r in leaves]
    assert max(sums) - min(sums) <= 1


def test_hypergeometric_distribution(spark):
    df = spark.range(20_000).select(
        mixing.hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), mixing._uniform(F.col("id"))).alias("x")
    )
    got = {r["x"]: r["count"] for r in df.groupBy("x").count().collect()}
    for k in range(11):
        p = math.comb(20, k) * math.comb(30, 10 - k) / math.comb(50, 10)
        assert abs(got.get(k, 0) / 20_000 - p) < 4 * math.sqrt(p / 20_000) + 1e-4


def test_writes_shards(spark, tmp_path):
    df = docs(spark, sentences(50, size=40))
    mixing.write_mix(df, str(tmp_path / "mix"), block_words=32, shards=4)
    written = spark.read.parquet(str(tmp_path / "mix"))
    assert {r["shard"] for r in written.select("shard").distinct().collect()} == {0, 1, 2, 3}
    want = mixing.taken_words(df, block_words=32, shards=4).agg(F.sum("taken")).first()[0]
    assert written.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == want
