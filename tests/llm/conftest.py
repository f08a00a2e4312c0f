import random

import pytest

WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "do", "eiusmod", "tempor"]
LONG = "doc_id long, text string, lang string, source string, n_chars long, __u string, copy int, component string, bucket string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "en", "ing"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Rows with nulls, empty and long texts, copies, near copies, shared passages, repeated rows and odd extra columns."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 4, 5, 6, 40, 80, 120, 200, 3000)]
    texts = [None, "", "   \n\t", *base]
    texts += [base[5], " ".join(base[5].split(" ")) + "\n", base[5].upper(), base[6].replace(" ", "\n")]
    for k in range(12):
        words = base[7].split(" ")
        words[rng.randrange(len(words))] = f"edit{k}"
        texts.append(" ".join(words))
    passage = prose(rng, 30)
    texts += [prose(rng, 10) + " " + passage + " " + prose(rng, 10) for _ in range(6)]
    texts += ["é" * 150, "x" * 260, "über straße é\x00 <|endoftext|> 你好 😀", "a  b \n c", "word"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "u", 9, "c", "b") for i, t in enumerate(texts)]
    rows += [rows[8], (None, "no id here", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, LONG)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], LONG)
