"""Byte-level dedup of long repeats across documents."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substrings import _MESSAGE, _NULL_ID, _anchor_messages, _exchange, _records, _rows, _tag, deal, pack, squeezed, unpack
from .tables import load, parts_for
from .words import BYTES, chunks, mixed, window_hashes

#: Bytes of the strings that count and of the samples that stand for them; SPREAD samples start in each string.
WIDTH, SAMPLE = 50, 20
SPREAD = WIDTH - SAMPLE + 1
#: Bytes that a run of strings with one sample covers at most, and runs that are compared at once.
REACH = WIDTH + SPREAD - 1
SLICE = 1 << 15
_PLACES = mixed(np.arange(1, REACH + 2, dtype=np.uint64)) | np.uint64(1)
_RUN = [("h", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<i4"), ("n", "u1"), ("text", "u1", (REACH,))]
_VERDICT = [("doc", "<i8"), ("tag", "<i4"), ("at", "<i4"), ("mask", "<u4")]


class Runs:
    """All strings of WIDTH bytes of some texts, as runs of neighbours that share their sample: the smallest hash in the string, leftmost of equal ones.

    start: each run's first byte in `buf`; n: its strings; h: the sample's hash; owner, place: its text, and the first byte in it.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\0".join(texts) + b"\0"
        self.buf = np.frombuffer(joined, np.uint8)
        h = window_hashes(BYTES[self.buf], SAMPLE)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lens + 1) - lens - 1
        count = np.maximum(0, lens - WIDTH + 1)
        total = len(h) - SPREAD + 1
        self.start = self.n = self.owner = self.place = np.zeros(0, np.int64)
        self.h = np.zeros(0, np.uint64)
        if total <= 0 or not count.sum():
            return
        least = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= SPREAD:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:total], least[SPREAD - size : SPREAD - size + total])
        owner = np.repeat(np.arange(len(texts)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        sample = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (sample[1:] != sample[:-1]) | (owner[1:] != owner[:-1])]))
        self.start, self.owner, self.h = at[new], owner[new], h[sample[new]]
        self.n = np.diff(np.append(new, len(at)))
        self.place = self.start - first[self.owner]


def _samples(texts, doc, _):
    runs = Runs(texts)
    tags = np.array([_tag(t) for t in texts], np.int64)
    return _records("anchor", h=runs.h, doc=doc[runs.owner], tag=tags[runs.owner], at=runs.place)


def _verdicts(records: np.ndarray, masks: np.ndarray, parts: int) -> pd.DataFrame:
    """Which strings of each run a smaller document has, packed by part of the documents."""
    hit = masks > 0
    out = np.empty(int(hit.sum()), _VERDICT)
    for name in ("doc", "tag", "at"):
        out[name] = records[name][hit]
    out["mask"] = masks[hit]
    part = out["doc"] % parts
    order = np.lexsort((out["at"], out["doc"], part))
    out, part = out[order], part[order]
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(out) else np.zeros(0, np.int64)
    return pd.DataFrame({"part": part[begin], "data": [pack(x, _VERDICT) for x in np.split(out, begin[1:])] if len(out) else [], "reply": True})


def _classes(records: np.ndarray) -> np.ndarray:
    """A hash of each run's strings as a whole: runs of one sample with equal hashes hold the same strings."""
    out = records["n"].astype(np.uint64) * _PLACES[REACH]
    for begin in range(0, len(records), SLICE):
        out[begin : begin + SLICE] += (BYTES[records["text"][begin : begin + SLICE]] * _PLACES[:REACH]).sum(axis=1, dtype=np.uint64)
    return mixed(out)


def _whole(n: np.ndarray) -> np.ndarray:
    return ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)


def _repeats(records: np.ndarray) -> np.ndarray:
    """A bit for each string of each run: whether a run of a smaller document holds it. Equal strings have equal samples.

    Runs that are equal as a whole are settled by their documents alone; only where different runs share a sample are the
    strings of one run of each kind compared, by two hashes.
    """
    out = np.zeros(len(records), np.uint32)
    kind = _classes(records)
    order = np.lexsort((records["doc"], kind, records["h"]))
    h, kind = records["h"][order], kind[order]
    sample = np.concatenate([[True], h[1:] != h[:-1]])
    first = sample | np.concatenate([[True], kind[1:] != kind[:-1]])
    leader = order[first]
    of = np.cumsum(first) - 1
    kinds = np.bincount(np.cumsum(sample)[first] - 1)
    mixed_up = kinds[np.cumsum(sample)[first] - 1] > 1
    if mixed_up.any():
        out[leader[mixed_up]] = _compared(records[leader[mixed_up]])
    out[order] = np.where(records["doc"][order] > records["doc"][leader][of], _whole(records["n"][order]), out[leader][of])
    return out


def _compared(records: np.ndarray) -> np.ndarray:
    """The same for runs sorted by sample, string by string, in slices of about SLICE runs."""
    out = np.zeros(len(records), np.uint32)
    h = records["h"]
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    begin = 0
    while begin < len(edges) - 1:
        upto = max(begin + 1, int(np.searchsorted(edges, edges[begin] + SLICE, side="right")) - 1)
        own = np.arange(edges[begin], edges[upto])
        begin = upto
        a, b, doc, row, at = (np.concatenate(x) for x in zip(*(_strings(records, own[i : i + SLICE]) for i in range(0, len(own), SLICE)), strict=True))
        o = np.lexsort((b, a))
        new = np.concatenate([[True], (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])])
        least = np.minimum.reduceat(doc[o], np.flatnonzero(new))[np.cumsum(new) - 1]
        dup = o[doc[o] > least]
        np.bitwise_or.at(out, row[dup], np.uint32(1) << at[dup].astype(np.uint32))
    return out


def _strings(records: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Both hashes, document, run and place of each string of the runs `own`."""
    n = records["n"][own].astype(np.int64)
    row, at = np.repeat(np.arange(len(own)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat = BYTES[records["text"][own]].reshape(-1)
    place = row * REACH + at
    return window_hashes(flat, WIDTH)[place], window_hashes(flat, WIDTH, 1)[place], records["doc"][own][row], own[row], at


def _send_runs(parts: int):
    """Runs whose sample occurs again, with their bytes. Of equal runs in a batch only those of the smallest document are sent."""

    def run(batches):
        for pdf in batches:
            texts, doc = _rows(pdf)
            for begin, part in chunks(texts):
                runs = Runs(part)
                tags = np.array([_tag(t) for t in part], np.int64)
                wanted = []
                for i, blobs in enumerate(pdf["blobs"].iloc[begin : begin + len(part)]):
                    held = [x[1:] for x in (np.frombuffer(bytes(b), "<i4") for b in blobs) if x[0] == tags[i]]
                    mine = np.arange(*np.searchsorted(runs.owner, [i, i + 1]))
                    if held and len(mine):
                        wanted.append(mine[np.isin(runs.place[mine], np.concatenate(held))])
                at = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
                if not len(at):
                    continue
                x = np.zeros(len(at), _RUN)
                owner = runs.owner[at]
                x["h"], x["doc"], x["tag"], x["at"], x["n"] = runs.h[at], doc[begin + owner], tags[owner], runs.place[at], runs.n[at]
                offsets = np.arange(REACH)
                inside = offsets[None, :] < (runs.n[at] + WIDTH - 1)[:, None]
                x["text"] = np.where(inside, runs.buf[np.minimum(runs.start[at][:, None] + offsets, len(runs.buf) - 1)], 0)
                _, group = np.unique(_classes(x), return_inverse=True)
                least = np.full(group.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, group, x["doc"])
                later = x["doc"] > least[group]
                if later.any():
                    yield _verdicts(x[later], _whole(x["n"][later]), parts)
                yield deal(x[~later], parts, _RUN)

    return run


def _judge(parts: int):
    def run(batches):
        held = []
        for pdf in batches:
            own = pdf["reply"].to_numpy(bool)
            if own.any():
                yield pdf.loc[own, ["part", "data"]]
            held += [bytes(x) for x in pdf.loc[~own, "data"]]
        records = unpack(held, _RUN)
        del held
        if len(records):
            yield _verdicts(records, _repeats(records), parts)[["part", "data"]]

    return run


def _delivered(batches):
    held = unpack([bytes(x) for pdf in batches for x in pdf["data"]], _VERDICT)
    if len(held):
        r = held[np.lexsort((held["tag"], held["doc"]))]
        begin = np.flatnonzero(np.concatenate([[True], r["doc"][1:] != r["doc"][:-1]]))
        yield pd.DataFrame({"doc": r["doc"][begin], "found": [x.tobytes() for x in np.split(r, begin[1:])]})


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """Removes from every row of `docs` (doc_id, text) each byte that lies in a string of WIDTH bytes which a smaller doc_id also has.

    Strings are judged on the input and never cross documents. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs)
    and kept (the other bytes, as binary). Extra columns are ignored.

    Each string is filed under its sample, the smallest of its hashed 20-byte parts, so equal strings meet under one sample
    wherever they stand. Samples that occur once are settled by their hash alone; the runs around the others are compared, whole
    runs by a hash and the strings of runs that differ by two. Tasks settle their own repeats first and send each run once, so
    hot passages stay small.

    Null texts are empty; a null doc_id counts as the smallest; equal rows have no smaller document in each other. Texts of less
    than WIDTH bytes stay as they are.
    """
    parts = parts_for(docs)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    base = base.mapInPandas(squeezed, base.schema).repartition(parts, "doc")
    repeated = _exchange(base, _samples, "anchor", _anchor_messages, parts)
    sent = base.join(repeated.hint("shuffle_hash"), "doc").mapInPandas(_send_runs(parts), _MESSAGE)
    judged = sent.repartitionById(parts, F.col("part")).mapInPandas(_judge(parts), "part int, data binary")
    verdicts = judged.repartitionById(parts, F.col("part")).mapInPandas(_delivered, "doc long, found binary")

    def cut(batches):
        for pdf in batches:
            texts, doc = _rows(pdf)
            rows = []
            for t, found in zip(texts, pdf["found"], strict=True):
                gone = np.zeros(len(t) + 1, bool)
                if found is not None:
                    r = np.frombuffer(bytes(found), _VERDICT)
                    r = r[r["tag"] == _tag(t)]
                    mark = np.zeros(len(t) + 1, np.int64)
                    for j in range(SPREAD):
                        at = r["at"][(r["mask"] >> np.uint32(j)) & np.uint32(1) == 1].astype(np.int64) + j
                        np.add.at(mark, at, 1)
                        np.add.at(mark, at + WIDTH, -1)
                    gone = np.cumsum(mark) > 0
                gone = gone[: len(t)]
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                rows.append((len(t), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0, kept))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            out.insert(0, "doc", doc)
            yield out

    out = base.join(verdicts.hint("shuffle_hash"), "doc", "left").mapInPandas(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op2(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
