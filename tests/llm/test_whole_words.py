"""op1 learns from the whole of each word."""

from shelfmark.llm import toxicity


def test_marks_behind_byte_24_of_a_word_count():
    word = "平安的日子里大家都很高興".encode() + b"blargh"
    assert len(word) > 30
    found = toxicity._word_grams(word)
    assert {word[-n:] for n in toxicity.GRAMS} <= found
    assert {word[:n] for n in toxicity.GRAMS} <= found
