"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every string of MIN bytes has a minimizer: its leftmost substring of K bytes with the smallest hash. Stretches of a
document whose strings share a minimizer are segments; equal strings have equal minimizers, so dealing segments by
minimizer brings all copies of a string to one task. Tasks first drop segments whose surroundings of the minimizer
occur in one document only, merge equal ones, and keep of those what has surroundings in common with a different
segment. On the rest they build the transform and extend intervals backwards, breadth first: round L separates the suffixes whose common prefix is L long, and the rounds stop at MIN.
Suffixes that no round has separated share MIN bytes at least.

Equal segments of one task are merged before the shuffle: what repeats in a passage that very many documents share is
decided there, and at most one copy of it leaves each task. Segments count as equal by a 64-bit hash: among N different
ones of a task some two have the same with a probability below N^2 / 2^65.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table, text_bytes, tune
from .lm import _pack, _unpack
from .tokens import mix

MIN, K = 50, 12
#: Bytes that a task looks at together, and bytes of text for each bucket of segments.
CHUNK, BUCKET_BYTES = 3 << 19, 6 << 20
#: Bytes of one transform: a bucket's segments are dealt to as many as they need, again by minimizer.
TRANSFORM = 1 << 20
LAST = (1 << 63) - 1
_POS = np.uint64((1 << 22) - 1)


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; buf needs seven bytes more than the positions asked for."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def segments(buf: np.ndarray, allowed: np.ndarray, least: int = MIN, k: int = K):
    """(start, length, minimizer's offset, whether it occurs twice, its hash) of the segments of buf.

    ``allowed`` marks the positions where a string may start. buf is shorter than 4 MB.
    """
    n = len(allowed)
    v = _words(buf)
    short = np.uint64((1 << 8 * (k - 8)) - 1)
    h = mix(v[: n + least - k] * np.uint64(0x9E3779B97F4A7C15) ^ mix(v[8 : n + least - k + 8] & short))
    at = np.arange(len(h), dtype=np.uint64)
    high = h & ~_POS
    first = _slide(high | at, least - k + 1)[:n]
    again = _slide(high | (_POS - at), least - k + 1)[:n]
    place, last = (first & _POS).astype(np.int64), (_POS - (again & _POS)).astype(np.int64)
    twice = place != last
    value = first & ~_POS
    same = np.zeros(n, bool)
    same[1:] = allowed[1:] & allowed[:-1] & (value[1:] == value[:-1]) & (twice[1:] == twice[:-1])
    same[1:] &= twice[1:] | (place[1:] == place[:-1])
    begin = np.flatnonzero(allowed & ~same)
    stop = np.flatnonzero(allowed & ~np.append(same[1:], False)) + 1
    if len(begin) and (stop - begin).max() > 64:  # only where a minimizer repeats
        more = (stop - begin + 63) // 64
        owner = np.repeat(np.arange(len(begin)), more)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more)
        begin, stop = begin[owner] + 64 * step, np.minimum(stop[owner], begin[owner] + 64 * (step + 1))
    return begin, stop - begin + least - 1, place[begin] - begin, twice[begin], h[place[begin]]


def _span_hash(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each stretch of eight bytes or more."""
    v, out = _words(buf), length.astype(np.uint64)
    for j in range(0, int(length.max(initial=8)), 8):
        use = j + 8 <= length
        word = v[np.where(use, start + j, start + length - 8)]
        out = np.where(use | (j < length), mix(out * np.uint64(0xD6E8FEB86659FD93) + word), out)
    return out


def _spans(doc: np.ndarray, key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(doc, key, spans) with spans merged: the removed stretches of each document as pairs of numbers."""
    if not len(doc):
        return []
    order = np.lexsort((stop, start, key, doc))
    doc, key, start, stop = doc[order], key[order], start[order], stop[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    base = np.cumsum(new) << 40
    reach = np.maximum.accumulate(base + stop)
    cut = np.ones(len(doc), bool)
    cut[1:] = base[1:] + start[1:] > reach[:-1]
    a = np.flatnonzero(cut)
    begin, end = start[a], np.maximum.reduceat(stop, a)
    first = np.flatnonzero(new[a])
    both = np.stack([begin, end], 1).astype("<i8")
    return [(int(doc[a[i]]), int(key[a[i]]), both[i:j].tobytes()) for i, j in zip(first, [*first[1:], len(a)])]


def _pack_spans(*columns: np.ndarray) -> bytes:
    return _pack(*[np.diff(c.astype(np.int64), prepend=np.int64(0)) for c in columns])


def _unpack_spans(blob: bytes) -> tuple[np.ndarray, ...]:
    return tuple(np.cumsum(c) for c in _unpack(blob, "<i8", "<i8", "<i8", "<i8"))


def classes(text: np.ndarray, least: int = MIN) -> tuple[np.ndarray, np.ndarray]:
    """Positions of text in suffix order, and for each the class of suffixes that share its first ``least`` bytes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    key = _words(padded)[:n].byteswap()  # equal keys may stay in any order
    begin = key
    order = np.argsort(key)
    step = 8
    while True:
        ranked = key[order]
        rank = np.zeros(n + 1, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (ranked[1:] != ranked[:-1]).astype(np.int64)]))
        if step >= least or rank[:n].max() == n:
            break
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - step)] = rank[step:n]
        key = rank[:n] * (n + 1) + follow
        order = np.argsort(key)
        step *= 2
    place = np.full(n + 1, -1, np.int64)  # of each suffix in suffix order; the empty suffix is first
    place[order] = np.arange(n)
    after = place[order + 1]  # where a suffix goes without its first byte; a backward extension is the way back
    # intervals of eight bytes come with the sort; from there each round extends those of the last one backwards
    head = begin[order]
    split = np.concatenate([[True], head[1:] != head[:-1]])
    open_ = np.flatnonzero(~split)
    part = np.full(n + 1, -1, np.int32)
    for _ in range(8, least):  # c + w is split where w was, or where it differs in c
        if not len(open_):
            break
        np.cumsum(split, dtype=np.int32, out=part[:n])
        cut = part[after[open_]] != part[after[open_ - 1]]
        split[open_[cut]] = True
        open_ = open_[~cut]
    return order, np.cumsum(split)


def meet(buf: np.ndarray, start: np.ndarray, length: np.ndarray, offset: np.ndarray, twice: np.ndarray, doc: np.ndarray, key: np.ndarray, pos: np.ndarray, least: int = MIN, k: int = K):
    """Removed stretches (doc, key, start, stop) among segments that hold all copies of their strings.

    buf has eight bytes or more after the last segment.
    """
    side = (least - k + 1) // 2
    v = _words(buf)
    m = start + offset

    def around(at: np.ndarray) -> np.ndarray:
        out = mix(v[at])
        for j in (*range(8, side + k - 8, 8), side + k - 8):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + v[at + j])
        return out

    left, right = ~twice & (offset >= side), ~twice & (length - offset >= k + side)
    mark = mix(v[m] ^ mix(v[np.minimum(m + k - 8, len(v) - 1)]) ^ np.uint64(7))
    keys = np.concatenate([around(m[left] - side) ^ np.uint64(1), around(m[right]), mark[twice]])
    owner = np.concatenate([np.flatnonzero(left), np.flatnonzero(right), np.flatnonzero(twice)])
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    found = np.zeros(len(start), bool)
    if len(first):
        low, high = np.minimum.reduceat(doc[owner], first), np.maximum.reduceat(doc[owner], first)
        found[owner[np.repeat(low != high, np.diff(np.append(first, len(keys))))]] = True
    c = np.flatnonzero(found)
    if not len(c):
        return (np.zeros(0, np.int64),) * 4
    # equal segments: all but those of the smallest document go whole
    same = _span_hash(buf, start[c], length[c])
    order = np.lexsort((doc[c], same))
    c, same = c[order], same[order]
    new = np.concatenate([[True], same[1:] != same[:-1]])
    group = np.cumsum(new) - 1
    f = c[new]  # one of each, of the smallest document
    own = doc[c] == doc[f][group]
    gone, occ, occ_group = c[~own], c[own], group[own]
    # what is left to find lies in segments whose surroundings another segment, of another document, has too
    one = np.zeros(len(start), bool)
    one[f] = True
    use = one[owner]
    keys, owner = keys[use], owner[use]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    low, high = np.minimum.reduceat(doc[owner], first), np.maximum.reduceat(doc[owner], first)
    one[f] = False
    one[owner[np.repeat(low != high, np.diff(np.append(first, len(keys))))]] = True
    left = np.flatnonzero(one[f])
    parts = max(1, -(-int(length[f[left]].sum()) // TRANSFORM))
    deal = (mark[f[left]] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    runs = [_expand(buf, start, length, doc, f, left[deal == np.uint64(k)], least) for k in range(parts)]
    run_seg, run_a, run_z = (np.concatenate(x) for x in zip(*runs))
    by = np.argsort(run_seg, kind="stable")
    run_seg, run_a, run_z = run_seg[by], run_a[by], run_z[by]
    # back to every occurrence in the segment's smallest document
    per = np.bincount(run_seg, minlength=len(f))
    base = np.cumsum(per) - per
    many = per[occ_group]
    o = np.repeat(np.arange(len(occ)), many)
    r = np.repeat(base[occ_group], many) + np.arange(len(o)) - np.repeat(np.cumsum(many) - many, many)
    o = occ[o]
    return (
        np.concatenate([doc[gone], doc[o]]),
        np.concatenate([key[gone], key[o]]),
        np.concatenate([pos[gone], pos[o] + run_a[r]]),
        np.concatenate([pos[gone] + length[gone], pos[o] + run_z[r]]),
    )


def _expand(buf, start, length, doc, segs, some, least):
    """(index of the segment, from, to) of what is to be removed in ``some`` of the distinct segments ``segs``."""
    if not len(some):
        return (np.zeros(0, np.int64),) * 3
    # the texts, an FF after each: no UTF-8 text holds that byte
    f = segs[some]
    size = length[f] + 1
    ends = np.cumsum(size)
    seg = np.repeat(np.arange(len(f)), size)
    inside = np.arange(ends[-1]) - (ends - size)[seg]
    text = buf[start[f][seg] + inside]
    text[ends - 1] = 255
    order, cls = classes(text, least)
    valid = (inside <= length[f][seg] - least)[order]
    order, cls = order[valid], cls[valid]
    d = doc[f][seg[order]]
    a = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    lowest = np.minimum.reduceat(d, a)[np.cumsum(np.concatenate([[False], cls[1:] != cls[:-1]]))]
    by = np.sort(order[d > lowest])
    s = seg[by]
    edge = np.concatenate([[True], (by[1:] != by[:-1] + 1) | (s[1:] != s[:-1])]) if len(by) else np.zeros(0, bool)
    a = np.flatnonzero(edge)
    z = np.append(a[1:], len(by))[: len(a)] - 1
    return some[s[a]], inside[by[a]], inside[by[z]] + least


def _chunks(batches, least: int):
    """(buf, allowed, doc, key, first): pieces of documents of about CHUNK bytes together.

    A long text comes in pieces that overlap by all but one byte of a string. doc, key and first are by byte: the
    document and the place in it.
    """
    held, size = [], 0

    def out():
        total = sum(len(x) for _, _, _, x, _ in held)
        buf = np.frombuffer(b"".join([x for *_, x, _ in held]) + bytes(least + 16), np.uint8)
        n = np.array([len(x) for *_, x, _ in held])
        allowed = np.zeros(total, bool)
        ends = np.cumsum(n)
        for e, m in zip(ends.tolist(), n.tolist()):
            allowed[e - m : max(e - m, e - least + 1)] = True
        meta = np.array([(d, t, a) for d, t, a, _, _ in held], np.int64)
        return buf, allowed, meta, ends - n

    for b in batches:
        for d, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = (x or "").encode()
            for a in range(0, max(1, len(raw) - least + 1), CHUNK):
                piece = raw[a : a + CHUNK + least - 1]
                if size and size + len(piece) > CHUNK + least:
                    yield out()
                    held, size = [], 0
                if len(piece) >= least:
                    held.append((d, t, a, piece, None))
                    size += len(piece)
    if held:
        yield out()


def removed_spans(docs: DataFrame, least: int = MIN, k: int = K) -> DataFrame:
    """(doc, tkey, spans): for each document that loses something the stretches to remove, merged.

    docs has doc (a number that orders documents), tkey (a hash of the text) and text.
    """
    buckets = max(12, -(-text_bytes(docs) // BUCKET_BYTES))
    names = ["bucket", "done", "blob"]

    def send(batches):
        z = zstandard.ZstdCompressor(level=3)
        for buf, allowed, meta, begins in _chunks(batches, least):
            start, length, offset, twice, h = segments(buf, allowed, least, k)
            if not len(start):
                continue
            piece = np.searchsorted(begins, start, side="right") - 1
            doc, key, pos = meta[piece, 0], meta[piece, 1], meta[piece, 2] + start - begins[piece]
            same = _span_hash(buf, start, length) ^ mix(h)
            order = np.lexsort((doc, same))
            cut = np.concatenate([[True], same[order][1:] != same[order][:-1]])
            low = doc[order][np.flatnonzero(cut)][np.cumsum(cut) - 1]
            gone = order[doc[order] > low]
            rows = [(int(meta[0, 1]) % buckets, True, _pack_spans(doc[gone], key[gone], pos[gone], pos[gone] + length[gone]))] if len(gone) else []
            kept = np.sort(order[doc[order] == low])
            b = ((mix(h[kept]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # minimizers are small hashes
            o = np.argsort(b, kind="stable")
            kept, b = kept[o], b[o]
            edge = np.searchsorted(b, np.arange(buckets + 1))
            for i in range(buckets):
                x = kept[edge[i] : edge[i + 1]]
                if not len(x):
                    continue
                # documents once each; then numbers, byte plane by byte plane; then the bytes of the segments
                ids, of = np.unique(piece[x], return_inverse=True)
                size = length[x]
                inside = np.repeat(start[x] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                head = np.array([len(ids), len(x)], "<i8").tobytes() + meta[ids, 0].astype("<i8").tobytes() + meta[ids, 1].astype("<i8").tobytes()
                numbers = [np.diff(of, prepend=0).astype("<u4"), pos[x].astype("<u8"), size.astype("u1"), offset[x].astype("u1"), twice[x].astype("u1")]
                planes = b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in numbers)
                rows.append((i, False, z.compress(head + planes + buf[inside].tobytes())))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary()))], names)

    def reduce(g: pd.DataFrame) -> pd.DataFrame:
        d = zstandard.ZstdDecompressor()
        done = g[g["done"]]
        parts, texts, at = [], [], 0
        for blob in g[~g["done"]]["blob"]:
            raw = d.decompress(blob)
            nd, n = np.frombuffer(raw, "<i8", 2)
            ids = np.frombuffer(raw, "<i8", 2 * nd, 16)
            p = 16 + 16 * nd
            cols = []
            for kind in ("<u4", "<u8", "u1", "u1", "u1"):
                w = np.dtype(kind).itemsize
                cols.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * w, p).reshape(w, n).T).view(kind).ravel().astype(np.int64))
                p += n * w
            of = np.cumsum(cols[0])
            size = cols[2]
            texts.append(raw[p:])
            parts.append((at + np.cumsum(size) - size, size, cols[3], cols[4] > 0, ids[:nd][of], ids[nd:][of], cols[1]))
            at += int(size.sum())
        found = [_unpack_spans(b) for b in done["blob"]]
        if parts:
            buf = np.frombuffer(b"".join([*texts, bytes(64)]), np.uint8)
            columns = [np.concatenate(c) for c in zip(*parts)]
            del texts, parts  # held once, not twice, while they are searched
            found.append(meet(buf, *columns, least=least, k=k))
        doc, key, start, stop = (np.concatenate(c) for c in zip(*found))
        b = (mix(doc.view(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((start, key, doc, b))
        edge = np.searchsorted(b[order], np.arange(buckets + 1))
        rows = [(i, _pack_spans(*(c[order[edge[i] : edge[i + 1]]] for c in (doc, key, start, stop)))) for i in range(buckets) if edge[i + 1] > edge[i]]
        return pd.DataFrame(rows, columns=["bucket", "blob"])

    def gather(g: pd.DataFrame) -> pd.DataFrame:
        rows = _spans(*(np.concatenate(c) for c in zip(*[_unpack_spans(b) for b in g["blob"]])))
        return pd.DataFrame(rows, columns=["doc", "tkey", "spans"])

    sent = docs.select("doc", "tkey", "text").mapInArrow(send, "bucket int, done boolean, blob binary")
    found = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(reduce, "bucket int, blob binary")
    return found.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(gather, "doc long, tkey long, spans binary")


def cut_spans(raw: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left of a text, the number of bytes removed, and of maximal stretches removed."""
    if not spans:
        return raw, 0, 0
    merged = np.frombuffer(spans, "<i8").reshape(-1, 2)
    kept, at = [], 0
    for a, b in merged.tolist():
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), int((merged[:, 1] - merged[:, 0]).sum()), len(merged)


def with_spans(docs: DataFrame, least: int = MIN, k: int = K) -> DataFrame:
    """docs (doc_id, text, ...) with the column __spans: stretches that also start in a document of smaller id."""
    tune(docs.sparkSession)
    doc, tkey = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64("text")
    spans = stash(removed_spans(docs.select(doc.alias("doc"), tkey.alias("tkey"), "text"), least, k))
    spans = spans.select(F.col("doc").alias("__doc"), F.col("tkey").alias("__tkey"), F.col("spans").alias("__spans"))
    return docs.withColumn("__doc", doc).withColumn("__tkey", tkey).join(spans, ["__doc", "__tkey"], "left").drop("__doc", "__tkey")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of each document without the bytes that 50-byte strings of smaller ids cover.

    A null text is empty. Rows without an id come after all others, and remove nothing from each other; rows that
    repeat an id are one document, and remove nothing from each other either.
    """
    docs = with_spans(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))

    def run(batches):
        for b in batches:
            rows = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (t or "").encode()
                left, n, m = cut_spans(raw, s)
                rows.append((len(raw), n, m, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.select("doc_id", "text", "__spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
