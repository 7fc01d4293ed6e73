"""op11: base kinds against plain Python, planted noise against ordinary tokens, and the battery's own figures."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from solaraddr.llm import secrets as S

DOCS = "doc_id long, text string, kind string, tried string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potions and nobody knows why this happens every Monday in London Paris Berlin".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def noise(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def plain_base(text):
    """Kinds, starts and ends by the patterns as they are stated."""
    out = []
    for i, (pattern, least) in enumerate(((r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 8), (r"(AKIA[A-Z0-9]+)", 16), (r"([0-9a-f]+)", 32))):
        out += [(m.start(), i, m.end()) for m in re.compile(pattern, re.ASCII).finditer(text or "") if len(m.group(1)) >= least]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows, planted = [], {}
    for i in range(300):
        text = prose(rng, 120)
        if i % 10 == 1:
            name = rng.choice(["base62", "base64", "lower36", "upper36"])
            token = noise(rng, S.ENCODINGS[name], rng.choice([24, 32, 40, 64]))
            if S.encoding_of(token):
                text = f"É{text} {token} {prose(rng, 9)}"
                planted[i] = (text.index(token), token)
        if i % 10 == 2:  # ordinary tokens that mix kinds of characters
            text += " /usr/local/share/documentation-2024/readme_file getElementByClassNameOrNull2 550e8400-e29b-41d4-a716-446655440000 abcdefghijklmnopqrstuvwxyz0123456789 " + "Ab1" * 12 + " org-apache-spark-sql-Column2 HTTPSConnectionPoolError404 2024-01-01T00-00-00Z-backup01"
        rows.append((i, text, "clash", "clash"))
    odd = [
        None, "", "password: hunter22 Secret='abc' token=secret=abcdefgh", "PASSWD = 'abcd.efgh-1' API_KEY:x1234567 apikey=short tokën=12345678", "ſecret=abcdefgh toKen=abcdefgh",
        "AKIAABCDEFGH1234 AKIAABC AKIA123456789012345 xAKIAAKIAAKIAAKIAA", "a" * 31 + " " + "0f" * 16 + "g" + "f" * 40, "token = secret: abcdefgh", "é" * 1000 + " token=" + "9a" * 30,
    ]
    rows += [(1000 + i, t, "c", "c") for i, t in enumerate(odd)]
    rows += [(2000, prose(rng, 40000) + " secret=abcdefgh1", "c", "c"), rows[11], rows[11]]
    return rows, planted


def test_scan(spark, corpus):
    rows, planted = corpus
    out = [r.asDict() for r in S.secrets(spark.createDataFrame(rows, DOCS)).collect()]
    assert len(out) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    found = {}
    for r in out:
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("random")] == base
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
        for s in spans:
            if s.startswith("random"):
                found.setdefault(r["doc_id"], set()).add(tuple(map(int, s.split(":")[1:])))
    assert len(planted) > 20
    hits = {i for i, (at, token) in planted.items() if (at, at + len(token)) in found.get(i, ())}
    assert len(hits) >= 0.85 * len(planted) and set(found) <= set(planted)


def test_scan_of_nothing(spark):
    assert S.secrets(spark.createDataFrame([], DOCS)).count() == 0
    assert S.secrets(spark.createDataFrame([(None, None, None, None)], DOCS)).first().spans == ""


def test_battery_keeps_its_level():
    rng = random.Random(3)
    even = np.ones((S._WIDTH, S._WIDTH))
    for name, alphabet in S.ENCODINGS.items():
        text = S.Text.of(even, alphabet)
        for n in (20, 50, 200):
            ps = [S.battery(noise(rng, alphabet, n), text)[0] for _ in range(400)]
            # hardly more than the level's share is taken for no noise
            assert sum(p < 0.1 for p in ps) / 400 < 0.2 and sum(p < S.NOISE_LEVEL for p in ps) <= 40


def test_levels_hold_the_false_share(spark):
    """Nine tokens in ten have even p-values: hardly any of them pass, and nearly all others do."""
    rng = random.Random(5)
    steps = [min(int(-10 * np.log10(rng.random())), S.STEPS) for _ in range(900)] + [80] * 100
    found = spark.createDataFrame([([(0, 1, "hex:0", s)],) for s in steps], "tried array<struct<start: long, end: long, stratum: string, step: int>>")
    level = S.levels(found)["hex:0"]
    assert level <= 80 and sum(s >= level for s in steps[:900]) <= 5
