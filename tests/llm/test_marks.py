"""op1 finds marks of every kind: a few plain words beside one mark in thousands of spellings."""

import random

from shelfmark.llm import toxicity
from tests.llm.conftest import prose


def test_many_spellings_of_one_mark_leave_room_for_the_others(spark):
    rng = random.Random(11)
    plain = ["blargh", "snorfle", "grimbly", "muckrake"]
    ends = ["".join(rng.choice("abcdeghilmnopqrstu") for _ in range(rng.randint(2, 9))) for _ in range(1500)]
    docs, labels = [], []
    for i in range(2400):
        words = prose(rng, rng.randint(60, 160)).split()
        kind = {0: "plain", 1: "spelled", 2: "spelled"}.get(i % 12)
        for _ in range({"plain": 3, "spelled": 8}.get(kind, 0)):
            words.insert(rng.randrange(len(words)), rng.choice(plain) if kind == "plain" else "zvexqu" + rng.choice(ends))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(kind is not None)))
    out = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {k: [r["predicted"] for r in out.filter("held_out").collect() if r["doc_id"] % 12 in d] for k, d in {"plain": (0,), "spelled": (1, 2), "clean": range(3, 12)}.items()}
    share = {k: sum(v) / len(v) for k, v in found.items()}
    assert share["plain"] > 0.9 and share["spelled"] > 0.9 and share["clean"] < 0.05


def test_a_mark_is_covered_once():
    words = [b"zvexqu" + e for e in (b"aa", b"bb", b"cc")] + [b"blargh"]
    weight = {g: 9.0 for g in toxicity._word_grams(b"zvexqu") if not g.endswith(b" ")} | {g: 2.0 for g in toxicity._word_grams(b"blargh")}
    assert toxicity._cover(words, weight, 2048) == b" blargh zvexquaa "
    assert toxicity._cover(words, weight, 12) == b" zvexquaa "
    assert toxicity._cover([], {}, 2048) == b""
