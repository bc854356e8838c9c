import random

import pytest

WORDS = "the of and river stone light under garden winter paper silver cloud north window music salt bridge ember field".split()
#: Columns that share names with what the operators add themselves.
EXTRA = "row long, key string, n int, size long, hash string, bucket int, target double"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "er", "ly", "an", "on"]) for _ in range(n))


def edge_texts():
    """Texts by id: copies, near copies, a shared passage, blanks, a very long text and odd characters."""
    rng = random.Random(5)
    passage = prose(rng, 30)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(24)]
    texts = dict(enumerate(base))
    texts[30] = base[4]
    texts[31] = base[4].upper()
    words = base[5].split()
    texts[32] = " ".join([*words[: len(words) // 2], "odd", *words[len(words) // 2 :]])
    texts[33] = f"{prose(rng, 20)} {passage} {prose(rng, 10)}"
    texts[34] = f"{passage}\n{prose(rng, 25)}"
    texts[35] = f"{prose(rng, 7)}\t{passage}"
    texts |= {40: "", 41: None, 42: "   \n\t ", 43: "word", 44: "word", 45: "Word Word", 46: prose(rng, 6000)}
    texts |= {47: "Zürich  naïve 東京 \U0001f600 <|endoftext|> it's 12% \x0b\x0c!", 48: "a" * 3000, 49: "͸ unassigned"}
    return texts


def edge_rows():
    rows = []
    for i, (doc_id, text) in enumerate(edge_texts().items()):
        rows.append((doc_id, text, ["en", "de", None][i % 3], ["a", "a", "b", "c", None][i % 5], len(text or ""), 1, "k", 2, 3, "h", 4, 0.5))
    rows.append(rows[2])
    rows.append(rows[40 % len(rows)])
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def null_id_docs(spark, edge_docs):
    return edge_docs.union(spark.createDataFrame([(None, "the lost page of the river", None, None, None, None, None, None, None, None, None, None)], SCHEMA))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
