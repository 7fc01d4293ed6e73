"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests cannot tell from noise but can tell from text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import batch_of
from .tables import load, written

# The patterns of the base kinds, the part of a match whose length counts, and the least length.
BASE = {
    "assign": (r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]+)", 1, 32),
}
KINDS = (*BASE, "random")
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Alphabets of encodings, smallest first; a token is taken to be in the first that holds all of it.
ENCODINGS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "lower36": _DIGITS + _LOWER, "upper36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER, "base64": _DIGITS + _UPPER + _LOWER + "+/", "base64url": _DIGITS + _UPPER + _LOWER + "-_",
}
#: Shortest token that is tested, trailing padding apart.
SHORTEST = 20
#: Share of false discoveries among the tokens added, in each class of encoding and length.
FALSE_SHARE = 0.01
#: Level at which the battery calls a token no noise after all.
NOISE_LEVEL = 0.05
#: Tenths of a decimal order of p that are told apart when the level is chosen.
STEPS = 3000

_SYMBOLS = "".join(dict.fromkeys("".join(ENCODINGS.values())))
_CODE = np.full(256, len(_SYMBOLS), np.uint8)
_CODE[np.frombuffer(_SYMBOLS.encode(), np.uint8)] = np.arange(len(_SYMBOLS))
_WIDTH = len(_SYMBOLS) + 1
_PATTERNS = {k: (re.compile(p), g, least) for k, (p, g, least) in BASE.items()}
_TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}=*")
_KINDS_OF = ((set(_LOWER), 1), (set(_UPPER), 2), (set(_DIGITS), 4))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of adjacent characters (of any encoding) over all texts of a task."""
    total = np.zeros(_WIDTH * _WIDTH, np.int64)
    for batch in batches:
        text = batch.column(0)
        joined = np.frombuffer("\n".join(x for x in text.to_pylist() if x).encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, len(joined), 1 << 22):
            code = _CODE[joined[at : at + (1 << 22) + 1]].astype(np.int64)
            total += np.bincount(code[:-1] * _WIDTH + code[1:], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["pair", "n"])


def character_pairs(documents: DataFrame) -> np.ndarray:
    """How often each of the 67 x 67 pairs of characters occurs in all texts: what ordinary text looks like."""
    counts = documents.where("text IS NOT NULL").select("text").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(_WIDTH * _WIDTH)
    for pair, n in counts.collect():
        out[pair] = n
    return out.reshape(_WIDTH, _WIDTH)


@dataclass(frozen=True)
class Text:
    """An encoding as ordinary text uses it. By symbol in the alphabet's order: class (letter case or digit), rank within the class by
    frequency, whether it is of the rarer half of all, share; then how often halves change between neighbours, and the correlation
    of neighbouring places in the alphabet.

    Encodings without small letters are held against text in capitals, that is against all letters of both cases.
    """

    place: np.ndarray
    kind: np.ndarray
    rank: np.ndarray
    rare: np.ndarray
    share: np.ndarray
    change: float
    correlation: float

    @classmethod
    def of(cls, pairs: np.ndarray, alphabet: str) -> Text:
        symbols = np.frombuffer(alphabet.encode(), np.uint8)
        own, k = _CODE[symbols], len(symbols)
        if alphabet == alphabet.upper():
            small, capital = _CODE[np.frombuffer(_LOWER.encode(), np.uint8)], _CODE[np.frombuffer(_UPPER.encode(), np.uint8)]
            pairs = pairs.copy()
            pairs[capital] += pairs[small]
            pairs[:, capital] += pairs[:, small]
        table = pairs[np.ix_(own, own)] + 1 / k  # one pair in all for each symbol, so that nothing is impossible
        weight = table.sum(0) + table.sum(1)
        table = table / table.sum()
        place = np.zeros(256, np.int64)
        place[symbols] = np.arange(k)
        order = np.argsort(-weight, kind="stable")
        kind = np.array([0 if chr(c) in _LOWER else 1 if chr(c) in _UPPER else 2 for c in symbols])
        rank, rare = np.zeros(k, np.int64), np.zeros(k, bool)
        for one in range(3):
            inside = order[kind[order] == one]
            rank[inside] = np.arange(len(inside))
        rare[order[k // 2 :]] = True
        score = np.arange(k) / k
        a, b = table.sum(1), table.sum(0)
        left, right = score - a @ score, score - b @ score
        spread = math.sqrt((a @ left**2) * (b @ right**2))
        return cls(place, kind, rank, rare, weight / weight.sum(), float(table[rare[:, None] != rare[None, :]].sum()), float(left @ table @ right / spread) if spread else 0.0)

    def classes(self, n: int) -> np.ndarray:
        """The class of each symbol for tokens of n: small letters, capitals, and the rest, each cut by frequency into 1, 2 or 4 with five symbols a class."""
        out, k, first = np.zeros(len(self.kind), np.int64), len(self.kind), 0
        for one in range(3):
            inside = self.kind == one
            size = int(inside.sum())
            if not size:
                continue
            parts = next(p for p in (4, 2, 1) if p == 1 or (n * size >= 5 * p * k and size >= 2 * p))
            out[inside] = first + self.rank[inside] * parts // size
            first += parts
        return out


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _both(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """The chance of a greater chi-squared, by the cube root's nearly normal law."""
    c = 2 / (9 * df)
    return _upper(((x / df) ** (1 / 3) - 1 + c) / math.sqrt(c))


def _together(ps: tuple[float, float, float]) -> float:
    """Fisher's combination of three p-values: the tail of chi-squared with six degrees of freedom."""
    half = -sum(math.log(max(p, 1e-280)) for p in ps)
    return math.exp(-half) * (1 + half + half * half / 2)


def battery(token: str, text: Text) -> tuple[float, float]:
    """(p if the token were noise, p if it were text) from uniformity, runs and serial correlation.

    Uniformity: chi-squared over classes of symbols. Runs: changes between the half of the symbols that text prefers and the
    other. Correlation: of neighbours' places in the alphabet. Under noise each has its usual law, and the least p counts three
    times (Bonferroni): one fault is enough. Under text the laws have the corpus's shares, changes and correlation; noise shows by
    classes that are too even, by more changes or by another correlation, which add up (Fisher).
    """
    at = text.place[np.frombuffer(token.encode(), np.uint8)]
    n, k = len(at), len(text.kind)
    of = text.classes(n)
    expected = np.bincount(of) / k
    seen = np.bincount(of[at], minlength=len(expected))
    chi = float((((seen - n * expected) ** 2) / (n * expected)).sum())
    # the same sum under text: mean, and variance by the linear part and the multinomial's own
    share = np.bincount(of, text.share)
    gap = (share - expected) / expected
    mean = float((share * (1 - share) / expected).sum() + n * (gap * (share - expected)).sum())
    spread = math.sqrt(max(4 * n * float((share * gap**2).sum() - (share * gap).sum() ** 2) + 2 * (len(expected) - 1), 1e-9))
    half = text.rare[at]
    changes, t = int((half[1:] != half[:-1]).sum()), (k // 2) / k
    runs = lambda c: (changes - (n - 1) * c) / math.sqrt((n - 1) * c * (1 - c))
    score = at - at.mean()
    power = float(score @ score)
    serial = float(score[1:] @ score[:-1]) / power if power else 1.0
    noise = (_chi_tail(chi, len(expected) - 1), _both(runs(2 * t * (1 - t))), _both((serial + 1 / n) * math.sqrt(n)))
    plain = (_upper((mean - chi) / spread), _upper(runs(min(max(text.change, 1e-3), 0.999))), _both((serial + 1 / n - text.correlation) * math.sqrt(n)))
    return min(1.0, 3 * min(noise)), _together(plain)


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds the token; none for digits or letters of one case alone, which are numbers and words."""
    used = set(token)
    kinds = sum(bit for some, bit in _KINDS_OF if used & some)
    if kinds in (0, 1, 2, 4):
        return None
    return next((name for name, alphabet in ENCODINGS.items() if used <= set(alphabet)), None)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches that are long enough, by start and kind."""
    return sorted((m.start(), i, m.end()) for i, (p, g, least) in enumerate(_PATTERNS.values()) for m in p.finditer(text) if m.end(g) - m.start(g) >= least)


def _free_tokens(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """Tokens that touch no base span."""
    at, until = 0, 0
    for m in _TOKEN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            until = max(until, taken[at][2])
            at += 1
        if until <= m.start():
            yield m.start(), m.end(), m.group().rstrip("=")


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_TRIED = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("step", pa.int32())])
_FOUND_SQL = "doc_id long, base array<struct<start: long, kind: int, end: long>>, tried array<struct<start: long, end: long, stratum: string, step: int>>"


def _search(batches: Iterator[pa.RecordBatch], texts: dict[str, Text]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("tried", pa.list_(_TRIED))])
    for batch in batches:
        out = []
        for doc, text in zip(*[c.to_pylist() for c in batch.columns]):
            base = base_spans(text or "")
            tried = []
            for start, end, token in _free_tokens(text or "", base):
                if name := encoding_of(token):
                    noise, plain = battery(token, texts[name])
                    # a token that is no noise counts among those tried, as one that no level lets pass
                    step = min(int(-10 * math.log10(max(plain, 1e-300))), STEPS) if noise >= NOISE_LEVEL else -1
                    tried.append((start, end, f"{name}:{int(2 * math.log2(len(token) / SHORTEST))}", step))
            out.append((doc, [dict(zip(("start", "kind", "end"), x)) for x in base], [dict(zip(("start", "end", "stratum", "step"), x)) for x in tried]))
        yield batch_of(schema, out)


def levels(found: DataFrame) -> dict[str, int]:
    """For each encoding and length class the least step of p at which false discoveries stay below FALSE_SHARE (Benjamini and Hochberg).

    Over all tokens tried in all documents. A class counts by steps, so there are at most STEPS rows for each of a few dozen classes.
    """
    counts = found.select(F.explode("tried").alias("t")).groupBy("t.stratum", "t.step").agg(F.count("*").alias("n"))
    by: dict[str, list[tuple[int, int]]] = {}
    for stratum, step, n in counts.collect():
        by.setdefault(stratum, []).append((step, n))
    out = {}
    for stratum, steps in by.items():
        tried, passed = sum(n for _, n in steps), 0
        for step, n in sorted(steps, reverse=True):
            passed += n
            if step >= 0 and 10 ** (-step / 10) * tried <= FALSE_SHARE * passed:
                out[stratum] = step
    return out


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans (kind:start:end in code points, by start and kind) for each row of documents.

    A null text is an empty one, and both give no spans. Rows that repeat give repeated rows; other columns are ignored; an empty
    table gives no rows. A text is searched whole, as one string, however long.

    Beside the base kinds, tokens of SHORTEST and more characters that touch none of them are tried. The encoding is inferred; the
    battery must find no fault with noise at NOISE_LEVEL, and its p under ordinary text (whose characters and neighbours are
    counted over all texts) has to pass the level that holds false discoveries to FALSE_SHARE among all tokens of this encoding and
    about this length. In a corpus with next to no text the two hypotheses are alike, and nothing is added.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = character_pairs(docs)
    texts = {name: Text.of(pairs, alphabet) for name, alphabet in ENCODINGS.items()}
    found = written(docs.mapInArrow(lambda b: _search(b, texts), _FOUND_SQL), "secrets")
    passing = levels(found)
    least = F.create_map(*[x for k, v in passing.items() for x in (F.lit(k), F.lit(v))]) if passing else F.create_map().cast("map<string,int>")
    kept = F.filter("tried", lambda t: F.coalesce(t["step"] >= F.try_element_at(least, t["stratum"]), F.lit(False)))
    random = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("kind"), t["end"].alias("end")))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.size(random).cast("long").alias("n_random"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", random))).alias("spans"),
    )


def op11(spark, sf_dir: str) -> DataFrame:
    return secrets(load(spark, sf_dir, "documents"))
