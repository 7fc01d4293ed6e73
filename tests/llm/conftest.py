import hashlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with copies, shared passages, nulls, an empty one and a long one; a column with a clashing name."""
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:6]
    passage = " ".join(word(i) for i in range(900, 940))
    texts = {0: " ".join(word(i) for i in range(80)), 1: None, 2: "", 3: "Two words"}
    texts[4] = texts[0]
    texts[5] = texts[0].replace(word(40), "other")
    texts[6] = f"{word(1000)} {passage} {word(1001)}"
    texts[7] = f"{passage}\n{word(1002)} {passage}"
    texts[8] = " ".join(word(i % 3000) for i in range(9000))
    texts[9] = "two WORDS"
    rows = [(i, t, "en", f"s{i % 3}" if i != 3 else None, 0, "clash") for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[4]], SCHEMA), texts
