"""Operator 5: removal of word spans that an earlier document already holds.

Method: level-wise doubling.  Windows of ``start_words`` words are counted over
all documents; only where they repeat are windows of twice that length (at most
``window_words``) formed and counted, and so on until the target length is
reached or no candidate survives.  The last level knows, for each window, the
smallest doc_id that holds it.

Edge cases: a null or empty text has no words, keeps the empty text; a document
shorter than the window loses nothing; of repeated rows with one doc_id none
loses a word to another (only a *smaller* doc_id counts); a null doc_id counts as
larger than every other; a very long text is processed whole, in the task of its origin;
other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import words as W

SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string"


def levels(start_words: int, window_words: int) -> list[int]:
    """Lengths by doubling, the last one cut to the target."""
    out = [min(start_words, window_words)]
    while out[-1] < window_words:
        out.append(min(2 * out[-1], window_words))
    return out


def _block_words(docs: pa.Table, values: list[np.ndarray]):
    """Word hashes (one array for each family), word offsets by document and spans by block."""
    hashes, offsets, spans = [[] for _ in values], [np.zeros(1, np.int64)], []
    for block in W.in_blocks(docs, "text"):
        s = W.split(*W.text_bytes(block["text"]), W.SPACES)
        for h, v in zip(hashes, values, strict=True):
            h.append(W.span_hashes(s, v))
        offsets.append(s.offsets[1:] + offsets[-1][-1])
    return [np.concatenate([np.zeros(0, np.uint64), *h]) for h in hashes], np.concatenate(offsets)


def _repeated(hashes: np.ndarray, offsets: np.ndarray, lengths: list[int], side: pa.Table, buckets: int):
    """Where windows of the last of ``lengths`` start whose halves all repeat, by the answers so far."""
    good = None
    for kind, width in enumerate(lengths):
        sent = _distinct(hashes, offsets, width, good)
        known = X.bits(X.answers(side, kind), X.bounds(sent[0], buckets)) | (sent[2] > 1)
        good = (sent[3][known[sent[1]]], width)
    return good


def _starts(n: int, offsets: np.ndarray, width: int, good) -> np.ndarray:
    """Starts of windows of ``width`` words; given repeats at half that, those made of two of them."""
    at = np.arange(max(0, n - width + 1))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    fits = at + width <= ends[: len(at)]
    if good is not None:
        flag = np.zeros(n + 1, bool)
        flag[good[0]] = True
        fits &= flag[at] & flag[at + width - good[1]]
    return at[fits]


def _hash_at(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    total = hashes[at]
    for k in range(1, width):
        total *= W._ROLL
        total += hashes[at + k]
    return W.mix(total + np.uint64(width))


def _distinct(hashes: np.ndarray, offsets: np.ndarray, width: int, good):
    """Sorted distinct window hashes, for each start its place among them, their counts, the starts."""
    at = _starts(len(hashes), offsets, width, good)
    found, place, counts = np.unique(_hash_at(hashes, at, width), return_inverse=True, return_counts=True)
    return found, place, counts, at


def _elsewhere(packed: list) -> list[bytes]:
    """For each origin's windows (32 bits within the bucket): does any other origin send it?"""
    if not packed:
        return []
    parts = [np.frombuffer(p, np.uint32) for p in packed]
    whole = np.concatenate(parts)
    order = np.argsort(whole, kind="stable")
    same = whole[order][1:] == whole[order][:-1]
    again = np.zeros(len(whole), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    ends = np.cumsum([len(p) for p in parts])
    return [np.packbits(again[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)]


def _smaller(packed: list) -> list[bytes]:
    """For each origin's windows (96 bits and its smallest doc_id): does a smaller doc_id hold it?"""
    if not packed:
        return []
    parts = [X.unpack(p, np.uint64, np.uint32, np.int64) for p in packed]
    h, check, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((doc, check, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
    least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    lost = np.zeros(len(h), bool)
    lost[order] = least < doc[order]
    ends = np.cumsum([len(p[0]) for p in parts])
    return [np.packbits(lost[e - len(p[0]) : e]).tobytes() for p, e in zip(parts, ends, strict=True)]


def _last_windows(docs: pa.Table, lengths: list[int], side: pa.Table, buckets: int):
    """The windows of full length that may repeat: distinct (hash, check), smallest doc_id; each start's place and doc_id."""
    (h, h2), offsets = _block_words(docs, [W.PLAIN, W.PLAIN_2])
    good = _repeated(h, offsets, lengths[:-1], side, buckets) if lengths[:-1] else None
    at = _starts(len(h), offsets, lengths[-1], good)
    ids = docs["doc_id"].to_numpy()
    owner = ids[np.searchsorted(offsets, at, "right") - 1]
    full, check = _hash_at(h, at, lengths[-1]), (_hash_at(h2, at, lengths[-1]) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((owner, check, full))
    new = np.ones(len(at), bool)
    new[1:] = (full[order][1:] != full[order][:-1]) | (check[order][1:] != check[order][:-1])
    first = order[new]
    place = np.empty(len(at), np.int64)
    place[order] = np.cumsum(new) - 1
    return full[first], check[first], owner[first], place, at, owner, offsets


def remove_repeated_spans(docs: DataFrame, window_words: int = 13, start_words: int = 7) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if a window of ``window_words`` consecutive words that covers it also
    starts in a document with a smaller doc_id; windows are judged on the input.
    ``start_words`` may be any length from 1 on; it changes the work, not the result.
    """
    lengths, plan = levels(start_words, window_words), X.Plan(docs)
    texts, b = X.by_origin(docs, plan), plan.buckets
    side = docs.sparkSession.createDataFrame([], X.PACKED)

    for kind in range(len(lengths) - 1):

        def send(origin, table, answers, kind=kind):
            (h,), offsets = _block_words(table, [W.PLAIN])
            good = _repeated(h, offsets, lengths[:kind], answers, b) if kind else None
            found = _distinct(h, offsets, lengths[kind], good)[0]
            return X.table_of(X.pack(origin, kind, X.bounds(found, b), found.astype(np.uint32)))

        sent = X.with_side(texts, side, send, X.PACKED) if kind else X.alone(texts, lambda o, t, f=send: f(o, t, None), X.PACKED)
        replies = X.answer(sent, kind, _elsewhere)
        side = side.unionByName(replies) if kind else replies

    def send_last(origin, table, answers):
        h, check, least, *_ = _last_windows(table, lengths, answers, b)
        return X.table_of(X.pack(origin, len(lengths), X.bounds(h, b), h, check, least))

    def finish(origin, table, answers):
        h, check, least, place, at, owner, offsets = _last_windows(table, lengths, answers, b)
        lost = X.bits(X.answers(answers, len(lengths)), X.bounds(h, b))
        gone = at[lost[place] | (least[place] < owner)] if len(at) else at
        cover = np.zeros(offsets[-1] + 1, np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + lengths[-1], -1)
        covered = np.cumsum(cover)[:-1] > 0
        per_doc, removed, kept = np.diff(offsets), np.zeros(table.num_rows, np.int64), []
        for i, text in enumerate(table["text"]):
            mask = covered[offsets[i] : offsets[i + 1]]
            removed[i] = mask.sum()
            found = (text.as_py() or "").encode().split()
            if removed[i]:
                found = [w for w, m in zip(found, mask.tolist(), strict=True) if not m]
            kept.append(b" ".join(found).decode())
        return pa.table({"doc_id": table["doc_id"], "n_words": per_doc, "n_removed": removed, "kept_text": pa.array(kept, pa.string())})

    if len(lengths) == 1:
        sent = X.alone(texts, lambda o, t: send_last(o, t, None), X.PACKED)
    else:
        sent = X.with_side(texts, side, send_last, X.PACKED)
    replies = X.answer(sent, len(lengths), _smaller)
    return X.with_null_ids(X.with_side(texts, side.unionByName(replies), finish, SCHEMA))
