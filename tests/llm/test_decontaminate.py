import random

import pytest
from helpers import AWKWARD, docs, sentences
from pyspark.sql import functions as F

from reelsift.llm.decontaminate import decontaminate, item_classes, item_windows

ITEMS = [
    (1, "A train leaves Boston at 9 and travels 120 km to meet Alice in 3 hours before dinner is served"),
    (2, "what is the colour of the sky when the evening sun goes down behind the old hills"),
    (3, "too short"),
    (4, "six words only stand in here"),
    (None, "an item without any id is never found in any of the many documents"),
    (6, None),
    (7, ""),
]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def found(spark, texts, ids=None):
    rows = decontaminate(docs(spark, texts, ids), bench(spark)).collect()
    return {r["doc_id"]: list(r["items"]) for r in rows if r["contaminated"]}


def test_finds_copies_and_reparameterised_copies(spark):
    clean = sentences(60, size=60)
    two = ITEMS[1][1]
    texts = [
        *clean,
        f"Before it. {two} And after it.",
        two.upper().replace(" ", "!! "),
        " | ".join(two.split()),
        "Well. A train leaves Denver at 7 and travels 300 miles to meet Carol in 5 hours before dinner is served. End",
        "A train leaves Denver at 7 and travels 300 km to meet Carol in 5 hours before dinner is served",
        f"{two} {ITEMS[0][1]}",
        "x six words only stand in here y",
        ITEMS[4][1],
    ]
    n = len(clean)
    assert found(spark, texts) == {n: [2], n + 1: [2], n + 2: [2], n + 3: [1], n + 4: [1], n + 5: [1, 2], n + 6: [4]}


def test_rejects_inconsistent_slots(spark):
    item = "Alice has 3 apples and gives Bob 3 pears while Dora counts 3 plums and then 3 figs"
    same = item.replace("3", "8")
    mixed = "Alice has 1 apples and gives Bob 2 pears while Dora counts 4 plums and then 5 figs"
    got = decontaminate(docs(spark, [same, mixed, item]), bench(spark, [(1, item)])).collect()
    assert {r["doc_id"]: r["contaminated"] for r in got} == {0: True, 1: False, 2: True}


PROBES = {
    "one value for two things": (
        "Sam buys 5 red apples in the small shop near the river and later he meets an old friend who sells him 5 ripe pears",
        "Sam buys 7 red apples in the small shop near the river and later he meets an old friend who sells him 9 ripe pears",
    ),
    "lower case": (ITEMS[0][1], ITEMS[0][1].lower()),
    "upper case, other numbers": (ITEMS[0][1], ITEMS[0][1].upper().replace("120", "340").replace(" 9 ", " 4 ")),
    "names that begin sentences": (
        "Tom has 5 apples in a bag. Sarah gives 3 more. Peter eats 2 of them. How many are left?",
        "Maria has 7 apples in a bag. Julia gives 4 more. Frank eats 3 of them. How many are left?",
    ),
    "within a running sentence": (
        "That is why the 3rd box of 5kg goes to London",
        "we said That is why the 4th box of 9kg goes to Paris and so on",
    ),
    "figures glued to units": (
        "The parcel of 5kg travels at 10km/h for 3h before it is weighed again",
        "The parcel of 8 kg travels at 40km/h for 7 h before it is weighed again",
    ),
}


@pytest.mark.parametrize("name", PROBES)
def test_changed_copies_are_covered(spark, name):
    item, changed = PROBES[name]
    clean = sentences(30, size=60)
    got = decontaminate(docs(spark, [*clean, f"{clean[0]}. {changed} {clean[1]}"]), bench(spark, [(1, item)])).collect()
    assert [r["doc_id"] for r in got if r["contaminated"]] == [len(clean)]
    assert max(r["cover"] for r in got) > 0.5


def test_items_that_share_a_window(spark):
    """10,000 items with one passage in common: holding it alone is holding none of them."""
    common = "please answer the following question with a single word"
    draw = random.Random(4)
    items = [(k, f"{common} {' '.join(f'w{draw.randint(0, 400)}' for _ in range(20))}") for k in range(10_000)]
    texts = [f"{common} {t}" for t in sentences(50, seed=77, size=40)] + [f"some words {items[k][1]} here" for k in (5, 4242)]
    windows = item_windows(bench(spark, items))
    _, each = item_classes(windows)
    assert each.filter(F.col("template").isin(common[:50], common[7:])).select("class").distinct().count() == 10_000
    assert each.filter("seeks").filter(F.col("template").isin(common[:50], common[7:])).isEmpty()
    got = {r["doc_id"]: list(r["items"]) for r in decontaminate(docs(spark, texts), bench(spark, items)).collect() if r["contaminated"]}
    assert set(got) == {50, 51} and 5 in got[50] and 4242 in got[51]


def test_items_alike_are_one_class(spark):
    items = [(k, f"Anna has {k} apples and Berta has {k + 1} pears, how many do they have") for k in range(10, 3000)]
    classes, each = item_classes(item_windows(bench(spark, items)))
    assert classes.count() == 1 and len(classes.first()["items"]) == 2990
    got = decontaminate(docs(spark, ["Well, Carla has 5 apples and Doris has 6 pears, how many do they have then"]), bench(spark, items)).first()
    assert len(got["items"]) == 2990


def test_windows_against_brute_force(spark):
    items = [(k, t) for k, t in enumerate(sentences(40, seed=8, size=30))]
    got = {(r["id"], r["at"], r["template"]) for r in item_windows(bench(spark, items)).collect()}
    want = set()
    for i, t in items:
        w = t.lower().split()
        width = min(8, len(w))
        if len(w) >= 5:
            want |= {(i, k, " ".join(w[k : k + width])) for k in range(len(w) - width + 1)}
    assert got == want


def test_passages_in_documents_against_brute_force(spark):
    items = sentences(30, seed=9, size=40)
    texts = [f"{a} {items[k % 30]} {a}" if k % 4 == 0 else a for k, a in enumerate(sentences(120, seed=10, size=50))]
    got = decontaminate(docs(spark, texts), bench(spark, list(enumerate(items)))).collect()
    for r in got:
        w = texts[r["doc_id"]].lower().split()
        grams = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in range(5, 9)}
        want = []
        for k, item in enumerate(items):
            x = item.lower().split()
            n = min(8, len(x))
            if n >= 5:
                own = {i for i in range(len(x) - n + 1) if tuple(x[i : i + n]) in grams[n]}
                if len(own) >= 0.3 * (len(x) - n + 1):
                    want.append(k)
        assert list(r["items"]) == want


def test_edges(spark):
    assert decontaminate(docs(spark, []), bench(spark)).count() == 0
    plain = docs(spark, ["some words"])
    assert not decontaminate(plain, bench(spark, [])).first()["contaminated"]
    two = ITEMS[1][1]
    texts, ids = [*AWKWARD, two, two, two], [*range(len(AWKWARD)), 50, 50, None]
    clash = docs(spark, texts, ids).withColumns({"items": F.lit("mine"), "template": F.lit(1), "id": F.lit(2), "_of": F.lit(3)})
    rows = decontaminate(clash, bench(spark)).collect()
    assert len(rows) == len(texts) and sum(r["contaminated"] for r in rows) == 3
    assert all(r["_of"] == 3 and r["items"] in ([], [2]) for r in rows)
