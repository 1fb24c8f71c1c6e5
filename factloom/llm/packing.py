"""Hierarchical multi-length packing.

Documents are routed to tiers of context sizes by what is left of them after full windows; each tier is packed into
windows of its own size, gaps of longer windows are filled from shorter tiers, and the sequences are dealt to step
groups of nearly equal token counts. Tiers are powers of two, and a cut closes every window exactly, so nothing is
padded. Every Arrow batch of documents is packed by itself: there is no shuffle, and no step sees more than one batch.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, table, tune

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WINDOW, TIERS = 1024, (128, 256, 512, 1024)
#: Tokens that one step of training takes; the sequences of a batch are dealt to steps of about this size.
STEP_TOKENS = 16 * WINDOW
#: Entries of each of the two generations of a worker's cache of encoded words.
CACHE = 600_000
#: A byte-level splitter always cuts before a single space between two characters that aren't white space. Inside what
#: lies between such spaces it also cuts between a letter and a mark that is part neither of a contraction nor of a
#: special token, and on both sides of any other white-space character that stands alone.
MARKS = ".,;:!?%$&*#"
_CUT = re.compile(rf"(?<=[a-zà-öø-ÿ])(?=[{MARKS}])|(?<=\S)(?=[\n\t]\S)|(?<=\S[\n\t])(?=\S)")
_SPACED = re.compile(r"(?<=\S)(?= \S)")
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class Encoder:
    """A tokenizer file, and the ids of words seen lately.

    A word stands for itself after a single space, and with a space before it for itself without one. When the newer
    generation of the cache (of ``most`` entries) is full it becomes the older one; what is found in the older one moves
    back.
    """

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        self.lib, self.most = Tokenizer.from_file(path), most
        self.forget()

    def forget(self) -> None:
        self.new, self.old = {}, {}

    def units(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        have, old = self.new, self.old
        found = list(map(have.get, words))
        lost = [k for k, x in enumerate(found) if x is None]
        cores, tails, rest = [], [], {}
        for k in lost:
            w = words[k]
            core = w.rstrip(MARKS)
            if core.isalpha() and core[-1] < "\u0250":
                cores.append(core)
                tails.append(" " + w[len(core) :])
            else:
                cores.append("")
                tails.append(" ")
                rest[k] = [p if i == 0 else " " + p for i, p in enumerate(_CUT.split(w))]
        parts = set(cores).union(tails, *rest.values()).difference(have)
        for p in parts & old.keys():
            have[p] = old.pop(p)
        fresh = [*parts.difference(have)]
        plain = ["" if not p else p[1:] if p[0] == " " else " " + p for p in fresh]
        for p, e in zip(fresh, self.lib.encode_batch_fast(plain, add_special_tokens=False)):
            have[p] = np.array(e.ids, "<u4").tobytes()
        for k, x, y in zip(lost, map(have.get, cores), map(have.get, tails)):
            found[k] = x + y
        for k, ps in rest.items():
            found[k] = b"".join([have[p] for p in ps])
        return found

    def encode(self, texts: pa.Array, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, ``end`` after each, and how many each text has.

        Texts are cut at single spaces; a text in which white space runs together is cut by _SPACED instead.
        """
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        words, at, cuts = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
        bare = pc.utf8_trim_whitespace(coded.dictionary)
        odd = pc.or_(pc.not_equal(bare, coded.dictionary), pc.equal(bare, "")).to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(np.add.reduceat(odd[at].astype(np.int32), cuts[:-1])).tolist()
        more: dict[str, int] = {}

        def place(w: str) -> int:
            return more.setdefault(w, len(words) + len(more))

        at[cuts[:-1]] = [place(" " + words[k]) for k in at[cuts[:-1]].tolist()]
        rows = [at[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for k in runs:
            units = [u for u in _SPACED.split(texts[k].as_py()) if u]
            rows[k] = np.array([place(u[1:] if i and u[0] == " " else " " + u) for i, u in enumerate(units)], np.int64)
        ids = self.units([w or "a" for w in words] + [*more])  # the empty word stands in no row
        ids.append(np.array([end], "<u4").tobytes())
        last, n = np.array([len(ids) - 1]), np.array([len(row) + 1 for row in rows])
        order = np.concatenate([x for row in rows for x in (row, last)])
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        joined = np.frombuffer(b"".join(map(ids.__getitem__, order.tolist())), "<u4")
        return joined, np.add.reduceat(length[order], np.cumsum(n) - n)


@lru_cache(maxsize=2)
def _encoder(path: str, most: int = CACHE):
    """The library's tokenizer, and the one that looks words up."""
    words = Encoder(path, most)
    return words.lib, words


def pack(lengths: list[int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token of every document once.

    Each sequence is full at its tier's size; what is left over at the very end goes into sequences whose sizes are
    powers of two. ``window`` and the tiers must be powers of two, the longest tier being the window.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    heaps: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]  # by length left: (document, start)
    present = 0  # bit n: a document with n tokens left
    for d, n in enumerate(lengths):
        full = n // window
        sequences += [[(d, k * window, window)] for k in range(full)]
        if n % window:
            heaps[n % window].append((d, full * window))
            present |= 1 << (n % window)

    def take(n: int) -> tuple[int, int]:
        nonlocal present
        d = heaps[n].pop()
        if not heaps[n]:
            present &= ~(1 << n)
        return d

    last: list[tuple[int, int, int]] = []
    for t in range(len(tiers) - 1, -1, -1):
        size, under = tiers[t], tiers[t - 1] if t else 0
        while present.bit_length() - 1 > under:
            row, gap = [], size
            while gap and present:
                fits = present & ((1 << (gap + 1)) - 1)
                if fits:  # the longest that fits, of this or a shorter tier
                    n = fits.bit_length() - 1
                    d, s = take(n)
                    row.append((d, s, n))
                    gap -= n
                else:  # cut the shortest; its rest is routed anew
                    n = (present & -present).bit_length() - 1
                    d, s = take(n)
                    row.append((d, s, gap))
                    heaps[n - gap].append((d, s + gap))
                    present |= 1 << (n - gap)
                    gap = 0
            if gap:
                last = row
            else:
                sequences.append(row)
    left = sum(n for _, _, n in last)
    for bit in range(window.bit_length(), -1, -1):
        if left >> bit & 1:
            row, gap = [], 1 << bit
            while gap:
                d, s, n = last.pop(0)
                k = min(n, gap)
                row.append((d, s, k))
                if n > k:
                    last.insert(0, (d, s + k, n - k))
                gap -= k
            sequences.append(row)
    return sequences


def balance(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Step group of each sequence: the longest first, each to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        total, g = groups[0]
        heapq.heapreplace(groups, (total + sizes[k], g))
        out[k] = g
    return out


def pack_table(df: DataFrame, path: str, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, end: int = 0, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """One row per piece of every document (doc_id, text). A null or empty text is the single id ``end``.

    A worker's cache of words has two generations of ``cache`` entries; unless ``keep``, it is emptied after each task.

    Repeated rows and null ids are packed like any others; an empty table gives no rows. ``sequence_id`` and
    ``step_group`` hold the partition and the batch in their upper bits.
    """

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        at = step = 0
        words = _encoder(path, cache)[1]
        for b in batches:
            ids, lengths = words.encode(b.column(1).fill_null(""), end)
            rows = pack(lengths.tolist(), window, tiers)
            sizes = [sum(n for _, _, n in row) for row in rows]
            groups = balance(sizes)
            pieces = np.array([p for row in rows for p in row], np.int64).reshape(-1, 3)
            d, start, n = pieces.T
            of = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
            before = np.cumsum(n) - n
            total = np.array(sizes, np.int64)
            at_id = (np.cumsum(lengths) - lengths)[d] + start
            crc = [zlib.crc32(ids[i : i + m]) for i, m in zip(at_id.tolist(), n.tolist())]
            group = base + step + np.array(groups, np.int64)
            doc_tokens = lengths[d]
            numbers = [start, n, np.array(crc, np.int64), doc_tokens, base + at + of, before - (np.cumsum(total) - total)[of], total[of].astype(np.int32), group[of]]
            cols = [b.column(0).take(pa.array(d)), *map(pa.array, numbers)]
            at += len(rows)
            step += max(groups, default=-1) + 1
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])
        if not keep:  # the worker goes on to other stages
            words.forget()
            release()

    tune(df.sparkSession)
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op1_hierarchical_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_table(table(spark, sf_dir, "documents"), path)
