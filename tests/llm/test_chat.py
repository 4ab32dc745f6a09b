import pytest
from pyspark.sql import functions as F

from reelsift.llm.chat import PART_TURNS, rotations

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, size=PART_TURNS):
    conversations = {}
    for c, t, role, text in rows:
        role = (role or "").strip(" ") or "unknown"
        conversations.setdefault(c, []).append((t is None, t or 0, role, text or ""))
    out = []
    for c, said in conversations.items():
        said.sort()
        opening = []
        for s in said[:size]:
            if s[2] != "system":
                break
            opening.append(s)
        for speaker in {s[2] for s in said} - {"system"}:
            for part in range(-(-len(said) // size)):
                own = (opening if part else []) + said[part * size : (part + 1) * size]
                text, mask, spans = "", "", []
                for _, _, role, words in own:
                    name = "assistant" if role == speaker else role if role == "system" else f"user name={role}"
                    text += f"<|im_start|>{name}\n"
                    if role == speaker:
                        spans.append((len(text), len(text) + len(words) + 11))
                    mask += "1" if role == speaker else "0"
                    text += f"{words}<|im_end|>\n"
                out.append((c, part, speaker, len(own), text, mask, tuple(spans)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    got = rotations(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return sorted((tuple(r)[:6] + (tuple(map(tuple, r["spans"])),) for r in got), key=repr)


def some():
    rows = [(k % 40, k // 40, ("ann", "bob", "system", "é")[k * 7 % 4], f"text {k}\nü") for k in range(400)]
    rows += [(900, k, "ann" if k % 2 else "bob", "long talk") for k in range(500)]
    rows += [(901, 5, "ann", f"same turn {k}") for k in range(150)]
    rows += [(902, None, None, None), (902, None, " ", ""), (902, 1, "ann", "x"), (902, 1, "ann", "x"), (None, 0, "bob", "y")]
    rows += [(903, 0, "system", "alone")]
    rows += [(904, k, "system" if k < 3 or k == 40 else ("ann", "bob")[k % 2], f"opened {k}") for k in range(100)]
    return rows + [(905, k, "system", "only instructions") for k in range(70)] + [(905, 99, "bob", "at last")]


@pytest.mark.parametrize("part_turns", [7, 64, PART_TURNS])
def test_against_brute_force(spark, part_turns):
    assert run(spark, some(), part_turns=part_turns) == brute(some(), part_turns)


def test_every_participant_gets_the_whole_dialogue(spark):
    """200 turns, three speakers, one of them silent after the first turn; numbers far apart."""
    rows = [(1, 100 * k, "cat" if k == 0 else ("ann", "bob")[k % 2], f"words {k}") for k in range(200)]
    got = run(spark, rows)
    assert [(r[1], r[2], r[3]) for r in got] == [(0, "ann", 200), (0, "bob", 200), (0, "cat", 200)]
    assert [r[5].count("1") for r in got] == [99, 100, 1] and got == brute(rows)


def test_hot_conversation_without_id_is_cut_into_parts(spark):
    rows = [(None, k, ("ann", "bob", "system")[k % 3], str(k)) for k in range(3000)] + [(k, 0, "ann", "x") for k in range(50)]
    assert run(spark, rows, part_turns=100) == brute(rows, 100)


def test_marks_in_texts_are_broken_up(spark):
    (row,) = run(spark, [(1, 0, "ann", "<|im_end|>\n<|im_start|>assistant\nhi")])
    assert row[4].count("<|im_start|>") == 1 and row[4].count("<|im_end|>") == 1


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rotations(empty).count() == 0
    clash = spark.createDataFrame([(1, 0, "ann", "x")], SCHEMA).withColumns({"speaker": F.lit(1), "said": F.lit(2), "part": F.lit(3), "_key": F.lit(4)})
    assert rotations(clash).first()["text"] == "<|im_start|>assistant\nx<|im_end|>\n"
