"""Substring dedup: word windows that occur earlier in the corpus, found from difference-cover anchors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import load, parts_for
from .words import Words, chunks, window_hashes

#: Any two numbers have offsets below PERIOD that bring both onto COVER modulo PERIOD.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Anchors or windows that one packed message gathers before it is sent.
BATCH = 1 << 20
_NULL_ID = -(1 << 63)
_MESSAGE = "part int, data binary, reply boolean"
_REPLY = [("doc", "<i8"), ("tag", "<i4"), ("at", "<i4")]
#: Records of the exchanges: hashes, document, tag of its text (see _tag), place. Of an anchor's hash 6 bytes travel: it only names candidates.
FIELDS = {
    "anchor": [("h", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<i4")],
    "window": [("h", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<i4")],
}
_SENT_BYTES = {"anchor": 6}


def _tag(text: bytes) -> int:
    """31 bits of the text, kept beside each place, so that rows that share an id are told apart."""
    return zlib.crc32(text) & 0x7FFFFFFF


def squeezed(batches):
    """Texts in their compressed form, in which they are shuffled once and then read by several passes."""
    for pdf in batches:
        yield pdf.assign(text=squeeze([bytes(t) for t in pdf["text"]]))


def squeeze(texts: list[bytes]) -> list[bytes]:
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(t) for t in texts]


def plain(texts) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(bytes(t)) for t in texts]


def _rows(pdf: pd.DataFrame) -> tuple[list[bytes], np.ndarray]:
    return plain(pdf["text"]), pdf["doc"].to_numpy(np.int64)


def _replies(records: np.ndarray, parts: int) -> pd.DataFrame:
    """Places of documents, one packed message for each part of the documents."""
    if not len(records):
        return pd.DataFrame({"part": [], "data": [], "reply": []})
    part = records["doc"] % parts
    order = np.lexsort((records["at"], records["doc"], part))
    records, part = records[order], part[order]
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return pd.DataFrame({"part": part[begin], "data": [pack(x, _REPLY) for x in np.split(records, begin[1:])], "reply": True})


def _delivered(batches):
    """The replies to a part of the documents: for each document its places, one list (after the text's tag) for each of its texts."""
    held = unpack([bytes(x) for pdf in batches for x in pdf["data"]], _REPLY)
    if len(held):
        r = held[np.lexsort((held["at"], held["tag"], held["doc"]))]
        r = r[np.concatenate([[True], r[1:] != r[:-1]])]  # repeated rows send equal places
        begin = np.flatnonzero(np.concatenate([[True], (r["doc"][1:] != r["doc"][:-1]) | (r["tag"][1:] != r["tag"][:-1])]))
        data = [x["tag"][:1].tobytes() + x["at"].tobytes() for x in np.split(r, begin[1:])]
        doc = r["doc"][begin]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        yield pd.DataFrame({"doc": doc[first], "blobs": [data[i:j] for i, j in zip(first, [*first[1:], len(doc)], strict=True)]})


def pack(records: np.ndarray, fields: list, sent: int = 8) -> bytes:
    """Records by column: hashes as they are (`sent` bytes of the first), the others as differences, compressed."""
    n, out, rest = len(records), [], []
    for i, (name, *_) in enumerate(fields):
        column = np.ascontiguousarray(records[name])
        if name in ("h", "h2"):
            width = column.dtype.itemsize
            out.append(column.view(np.uint8).reshape(n, width)[:, : min(width, sent)].tobytes() if i == 0 else column.tobytes())
        else:
            rest.append((np.diff(column, prepend=column.dtype.type(0)).astype(column.dtype) if column.ndim == 1 else column).tobytes())
    return n.to_bytes(4, "little") + b"".join(out) + zstandard.ZstdCompressor(level=3).compress(b"".join(rest))


def unpack(messages: list[bytes], fields: list, sent: int = 8) -> np.ndarray:
    parts = []
    for m in messages:
        n, at = int.from_bytes(m[:4], "little"), 4
        x, rest, low = np.zeros(n, fields), None, 0
        for i, (name, *_) in enumerate(fields):
            kind = x[name].dtype
            if name in ("h", "h2"):
                width = min(kind.itemsize, sent) if i == 0 else kind.itemsize
                raw = np.zeros((n, kind.itemsize), np.uint8)
                raw[:, :width] = np.frombuffer(m, np.uint8, n * width, at).reshape(n, width)
                x[name] = raw.reshape(-1).view(kind)
                at += n * width
            else:
                rest = zstandard.ZstdDecompressor().decompress(m[at:]) if rest is None else rest
                shape = x[name].shape
                column = np.frombuffer(rest, kind, int(np.prod(shape)), low).reshape(shape)
                x[name] = np.cumsum(column, dtype=kind) if column.ndim == 1 else column
                low += column.nbytes
        parts.append(x)
    return np.concatenate(parts) if parts else np.zeros(0, fields)


def deal(records: np.ndarray, parts: int, fields: list, sent: int = 8) -> pd.DataFrame:
    """One packed message for each part, by hash."""
    part = (records["h"] % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((records["at"], records["doc"], part)) if "at" in records.dtype.names else np.lexsort((records["doc"], part))
    records, part = records[order], part[order]
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return pd.DataFrame({"part": part[begin], "data": [pack(x, fields, sent) for x in np.split(records, begin[1:])], "reply": False})


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by hash, the number of each entry's group in it, and the sizes of the groups."""
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group) if len(h) else np.zeros(0, np.int64)


def _anchor_messages(records: np.ndarray, parts: int) -> Iterator[pd.DataFrame]:
    """What a batch knows itself it answers itself; each hash is sent once, with place -1 if the batch already saw it twice."""
    order, group, size = _groups(records["h"])
    records, again = records[order], size[group] > 1
    if again.any():
        yield _replies(records[again], parts)
    first = np.concatenate([[True], group[1:] != group[:-1]])
    sent = records[first]
    sent["at"][again[first]] = -1
    yield deal(sent, parts, FIELDS["anchor"], _SENT_BYTES["anchor"])


def _window_messages(records: np.ndarray, parts: int) -> Iterator[pd.DataFrame]:
    """Of equal windows in a batch only the first is sent; those at other places are known to repeat it."""
    records = records[np.lexsort((records["tag"], records["at"], records["doc"]))]
    first, repeated = _judged(records)
    if repeated.any():
        yield _replies(records[repeated], parts)
    yield deal(records[first], parts, FIELDS["window"])


def _judged(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows, in the order of document and place, are the first of their kind, and which have an equal one at another place before them.

    Repeated rows send the same places: a place is never earlier than itself.
    """
    order, group, _ = _groups(records["h"])
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(order) else np.zeros(0, bool)
    h2 = records["h2"][order]
    if (h2 != h2[first][group]).any():  # two windows share 64 bits: sort by all 96
        order = np.lexsort((records["h2"], records["h"]))
        r = records[order]
        first = np.concatenate([[True], (r["h"][1:] != r["h"][:-1]) | (r["h2"][1:] != r["h2"][:-1])])
    leader = order[first][np.cumsum(first) - 1]
    other = np.zeros(len(order), bool)
    for c in ("doc", "tag", "at"):
        other |= records[c][order] != records[c][leader]
    begins, later = np.zeros(len(records), bool), np.zeros(len(records), bool)
    begins[order[first]] = True
    later[order[other]] = True
    return begins, later


def _gathered(make, kind: str, parts: int, messages):
    """Runs `make` over the texts, chunk by chunk, and sends what it finds in batches."""

    def run(batches):
        held, count = [], 0
        for pdf in batches:
            texts, doc = _rows(pdf)
            for begin, part in chunks(texts):
                found = make(part, doc[begin : begin + len(part)], pdf.iloc[begin : begin + len(part)])
                if len(found):
                    held.append(found)
                    count += len(found)
                if count >= BATCH:
                    yield from messages(np.concatenate(held), parts)
                    held, count = [], 0
        if count:
            yield from messages(np.concatenate(held), parts)

    return run


def _records(kind: str, **columns) -> np.ndarray:
    out = np.empty(len(columns["h"]), FIELDS[kind])
    for k, v in columns.items():
        out[k] = v
    return out


def _anchors(width: int):
    def make(texts, doc, _):
        words = Words(texts)
        at = words.windows(width)
        place = words.place()[at]
        cover = np.isin(place % PERIOD, COVER)
        at, place = at[cover], place[cover]
        owner = words.owner()[at]
        tags = np.array([_tag(t) for t in texts], np.int64)
        return _records("anchor", h=window_hashes(words.hashes(), width)[at] if len(at) else np.zeros(0, np.uint64), doc=doc[owner], tag=tags[owner], at=place)

    return make


def _positions(blobs, tag: int) -> np.ndarray:
    own = [np.frombuffer(b, "<i4") for b in map(bytes, blobs if blobs is not None else ())]
    own = [x[1:] for x in own if x[0] == tag]
    return np.sort(np.concatenate(own)).astype(np.int64) if own else np.zeros(0, np.int64)


def _windows(width: int):
    """Windows that have a repeated anchor at some cover position of theirs."""

    def make(texts, doc, pdf):
        words = Words(texts)
        tags = np.array([_tag(t) for t in texts], np.int64)
        mark = np.zeros(len(words.start) + 1, np.int64)
        for i, blobs in enumerate(pdf["blobs"]):
            p = _positions(blobs, int(tags[i])) + words.first[i]
            np.add.at(mark, np.maximum(p - PERIOD + 1, words.first[i]), 1)
            np.add.at(mark, p + 1, -1)
        near = np.cumsum(mark)[:-1] > 0
        at = words.windows(width)
        at = at[near[at]]
        if not len(at):
            return _records("window", h=np.zeros(0, np.uint64))
        h, owner = words.hashes(), words.owner()[at]
        return _records("window", h=window_hashes(h, width)[at], h2=window_hashes(h, width, 1)[at] >> np.uint64(32), doc=doc[owner], tag=tags[owner], at=words.place()[at])

    return make


def _answer(kind: str, parts: int):
    """What a part's messages say together: repeated anchors, or windows that are not the first of their kind."""

    def run(batches):
        held = []
        for pdf in batches:
            own = pdf["reply"].to_numpy(bool)
            if own.any():
                yield pdf.loc[own, ["part", "data"]]
            held += [bytes(x) for x in pdf.loc[~own, "data"]]
        records = unpack(held, FIELDS[kind], _SENT_BYTES.get(kind, 8))
        del held
        if len(records):
            if kind == "anchor":
                order, group, size = _groups(records["h"])
                known = np.bincount(group, records["at"][order] < 0) > 0
                hit = order[((size[group] > 1) | known[group]) & (records["at"][order] >= 0)]
            else:
                records = records[np.lexsort((records["tag"], records["at"], records["doc"]))]
                hit = np.flatnonzero(_judged(records)[1])
            yield _replies(records[hit], parts)[["part", "data"]]

    return run


def _exchange(source: DataFrame, make, kind: str, messages, parts: int) -> DataFrame:
    """Messages of all tasks, dealt by hash, answered, and the answers dealt by document: (doc, blobs of places), one row a document."""
    sent = source.mapInPandas(_gathered(make, kind, parts, messages), _MESSAGE)
    # replies that a batch found itself only pass through
    answers = sent.repartitionById(parts, F.col("part")).mapInPandas(_answer(kind, parts), "part int, data binary")
    return answers.repartitionById(parts, F.col("part")).mapInPandas(_delivered, "doc long, blobs array<binary>")


def dedup_substrings(docs: DataFrame, width: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Removes from every row of `docs` (doc_id, text) each word that lies in a window of `width` words which also starts earlier.

    Earlier: at a smaller doc_id, or in the same document further left. Windows are judged on the input. Returns doc_id,
    n_words, n_removed and kept, the other words joined by single spaces, and the columns named in `keep`; others are ignored.

    Anchors of width - PERIOD + 1 words are hashed at the cover positions modulo PERIOD: two equal windows have one at the same
    offset. Anchors that occur twice are extended to the windows around them, which are compared by 96-bit hashes of all their
    words. Tasks answer for their own repeats and send every hash once, so what a third of all rows share is a few messages.

    Null texts have no words; a null doc_id counts as the smallest. Repeated rows (equal id and text) are one document, each
    gets its result; different texts under one id are ordered by place. `width` has to be more than PERIOD.
    """
    parts = parts_for(docs)
    kinds = dict(docs.dtypes)
    carried = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    # one exchange of the texts serves all three passes
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *carried)
    base = base.mapInPandas(squeezed, base.schema).repartition(parts, "doc")
    repeated = _exchange(base, _anchors(width - PERIOD + 1), "anchor", _anchor_messages, parts)
    near = base.join(repeated.hint("shuffle_hash"), "doc")
    later = _exchange(near, _windows(width), "window", _window_messages, parts)

    def cut(batches):
        for pdf in batches:
            texts, _ = _rows(pdf)
            words, removed, kept = [], [], []
            for t, blobs in zip(texts, pdf["blobs"], strict=True):
                w = t.split()
                words.append(len(w))
                p = _positions(blobs, _tag(t)) if blobs is not None else ()
                if len(p):
                    mark = np.zeros(len(w) + 1, np.int64)
                    p = np.unique(p)
                    mark[p] += 1
                    np.add.at(mark, p + width, -1)
                    w = [x for x, gone in zip(w, np.cumsum(mark)[:-1] > 0, strict=True) if not gone]
                removed.append(words[-1] - len(w))
                kept.append(b" ".join(w).decode("utf-8", "replace"))
            yield pd.DataFrame({"doc": pdf["doc"], "n_words": words, "n_removed": removed, "kept": kept} | {f"_{i}": pdf[f"_{i}"] for i in range(len(keep))})

    schema = "doc long, n_words long, n_removed long, kept string" + "".join(f", _{i} {kinds[c]}" for i, c in enumerate(keep))
    out = base.join(later.hint("shuffle_hash"), "doc", "left").mapInPandas(cut, schema)
    return out.select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept", *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)])


def op6(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM listed)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
single AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM listed),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM single ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM listed l LEFT JOIN kept k USING (doc_id)
"""
