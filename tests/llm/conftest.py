import random

import pytest

WORDS = "the of and a to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do".split()


@pytest.fixture(scope="session")
def base():
    """Clean made-up texts, several lines each."""
    pick = random.Random(1)
    return [" ".join(pick.choice(WORDS) + ("." if pick.random() < 0.1 else "") + ("\n" if pick.random() < 0.05 else "") for _ in range(pick.randrange(60, 200))) for _ in range(30)]


#: Whatever an input may hold: nulls, empty and blank texts, odd white space, long words and texts, ties, repeated rows.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d"), (6, "a b c d e"), (7, "A B c D E"), (8, "x" * 5000), (9, "word " * 30_000), (10, "  lead and trail \n\n\n two\tthree "),
    (11, "l'été don't 'twas <|endoftext|> mid<|endoftext|>end <|startoftext|>"), (12, "日本語 テキスト 🙂 é  　 \x00\x1c ½ ²"), (13, "same text here it is again"), (14, "same text here it is again"), (14, "same text here it is again"), (None, "no id at all in here"), (None, None), (-5, "negative id is fine too ok"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows beside columns whose names clash with those of results and of inner tables."""
    clash = "keys array<long>, n_tokens string, keep_id string, id string, component_id string, digest string, salt int, label string, host string, gone int, n long"
    rows = [(i, t, [k], "x", "y", "z", "c", "d", 1, "l", "h", 5, k) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {clash}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
