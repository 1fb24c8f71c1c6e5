"""Byte-pair encoding and decoding by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tune

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space as the tokenizers' patterns see it; Python's split() also cuts at 1C to 1F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Below these, every character is in composed form already and lower case looks at no neighbour.
_HIGH = re.compile("[^\x00-ɏ]")
#: Units that need no splitter: lower-case Latin letters, then one mark at most.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]?)")
#: Entries of a worker's cache; it is emptied when full.
CACHE = 200_000
_FAR = 1 << 60


def merge(symbols: list[int], ranks: dict[int, int], made: np.ndarray) -> list[int]:
    """Merge the leftmost pair of lowest rank until no pair has a rank.

    A perfect binary tree holds, for each symbol, rank * n + position of the pair that starts there; its root is the
    leftmost lowest pair. A merge changes three leaves, each in logarithmic time.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    out, tree = list(symbols), [_FAR] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(i: int, k: int) -> int:
        r = ranks.get(out[i] << 32 | out[k])
        return _FAR if r is None else r * n + i

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    tree[size : size + n - 1] = [pair(i, i + 1) for i in range(n - 1)]
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    while tree[1] < _FAR:
        r, i = divmod(tree[1], n)
        j = after[i]
        k = after[i] = after[j]
        out[i], out[j] = int(made[r]), -1
        if j < n - 1:
            put(j, _FAR)
        if k < n:
            before[k] = i
        put(i, pair(i, k) if k < n else _FAR)
        h = before[i]
        if h >= 0:
            put(h, pair(h, i))
    return [x for x in out if x >= 0]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where it prints, else the next letter from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """The vocabulary and merges of a tokenizer file; its own normaliser and splitter cut a text into words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.lib = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = dict(model["vocab"])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.inner, self.last = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        for ch, b in self.letters.items():
            self.inner[b], self.last[b] = self.vocab.get(ch, -1), self.vocab.get(ch + self.suffix, -1)
        keys = np.array([self.vocab[x] << 32 | self.vocab[y] for x, y in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = np.append(keys[order], _FAR), np.append(order, _FAR).astype(np.int64)
        self.made = np.array([self.vocab[x + y] for x, y in pairs], np.int64)
        self.one = {(self.vocab[x] << 32 | self.vocab[y]): r for r, (x, y) in enumerate(pairs)}
        self.words: dict[bytes, tuple[str, str]] = {}
        self.units: dict[str, tuple[str, str]] = {}

    def ranks_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; _FAR where there is none or an id is -1."""
        key = np.where((x < 0) | (y < 0), -1, x << 32 | y)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], _FAR)

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. Words of like length go through their trees together, one merge each a round."""
        out: list[list[int]] = [[]] * len(words)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            groups.setdefault(max(1, (len(w) - 1).bit_length()), []).append(k)
        for bits, members in groups.items():
            if bits > 6:
                for k in members:
                    out[k] = merge(self.symbols(words[k]), self.one, self.made)
                continue
            size = 1 << bits
            for at in range(0, len(members), 1 << 14):
                part = members[at : at + (1 << 14)]
                for k, ids in zip(part, self.trees([words[k] for k in part], size)):
                    out[k] = ids
        return out

    def symbols(self, w: bytes) -> list[int]:
        ids = self.inner[np.frombuffer(w, np.uint8)]
        ids[-1] = self.last[w[-1]]
        return [int(x) for x in ids if x >= 0]

    def trees(self, words: list[bytes], size: int) -> list[list[int]]:
        n = len(words)
        length = np.array([len(w) for w in words])
        row, col = np.repeat(np.arange(n), length), np.concatenate([np.arange(k) for k in length])
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = np.full((n, size + 1), -1, np.int64)
        sym[row, col] = self.inner[flat]
        sym[np.arange(n), length - 1] = self.last[np.array([w[-1] for w in words])]
        tree = np.full((n, 2 * size), _FAR, np.int64)
        tree[:, size:] = self.ranks_of(sym[:, :-1], sym[:, 1:])
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))

        def put(rows, leaf, value):
            k = leaf + size
            tree[rows, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        while len(rows := np.flatnonzero(tree[:, 1] < _FAR)):
            low, k = tree[rows, 1], np.ones(len(rows), np.int64)
            while k[0] < size:
                k = 2 * k + (tree[rows, 2 * k] != low)
            i = k - size
            j = after[rows, i]
            far = after[rows, j]
            sym[rows, i], sym[rows, j] = self.made[low], -1
            after[rows, i] = far
            before[rows, np.minimum(far, size)] = i
            put(rows, j, _FAR)
            put(rows, i, self.ranks_of(sym[rows, i], sym[rows, np.minimum(far, size)]))
            h = before[rows, i]
            has = h >= 0
            if has.any():
                put(rows[has], h[has], self.ranks_of(sym[rows[has], h[has]], sym[rows[has], i[has]]))
        live = sym >= 0
        ids, ends = sym[live].tolist(), np.cumsum(live.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def split(self, u: str) -> list[bytes]:
        """Bytes of the words in a normalised stretch without white space."""
        if m := _PLAIN.fullmatch(u):
            return [x.encode() for x in m.groups() if x]
        return [bytes(self.letters[c] for c in w) for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(u)]

    def learn(self, units: set[str]) -> None:
        """Put the ids and tokens of each unit into the cache, both joined by spaces."""
        if len(self.units) > CACHE:
            self.units.clear()
            self.words.clear()
        parts = {u: self.split(u) for u in units.difference(self.units)}
        fresh = list({w for ws in parts.values() for w in ws}.difference(self.words))
        names = self.names
        for w, ids in zip(fresh, self.merge_words(fresh)):
            self.words[w] = (" ".join(map(str, ids)), " ".join([names[i] for i in ids]))
        for u, ws in parts.items():
            if len(ws) == 1:
                self.units[u] = self.words[ws[0]]
            else:
                got = [self.words[w] for w in ws]
                self.units[u] = (" ".join([a for a, _ in got if a]), " ".join([b for a, b in got if a]))

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Ids and decoded text of each text, as the whole tokenizer gives them. A special token's string is that token."""
        cut: list[list[list[str]]] = []
        for t in texts:
            pieces = self.cut.split(t) if "<|" in t else [t]
            pieces[::2] = [self.lib.normalizer.normalize_str(x) if _HIGH.search(x) else x.lower() for x in pieces[::2]]
            cut.append([[x] if k % 2 else _SPACE.split(x) if _ODD.search(x) else x.split() for k, x in enumerate(pieces)])
        if len(self.units) > CACHE:
            self.units.clear()
            self.words.clear()
        seen: set[str] = set()
        for doc in cut:
            for us in doc[::2]:
                seen.update(us)
        self.learn(seen - {""})
        find, out = self.units, []
        for doc in cut:
            got = [find[u] for u in doc[0] if u]
            for k, us in enumerate(doc[1:], 1):
                got += [(str(self.special[us[0]]), us[0])] if k % 2 else [find[u] for u in us if u]
            out.append((" ".join([a for a, _ in got if a]), " ".join([b for a, b in got if a])))
        return out


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_table(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): ids and decoded text as strings. A null text is empty: no ids, decoded ''."""

    def run(batches):
        c = codec(path)
        for b in batches:
            got = c.encode([t or "" for t in b.column(1).to_pylist()])
            ids = [x for x, _ in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()), pa.array(ids, pa.string()), pa.array([y for _, y in got], pa.string())],
                ["id", "n_tokens", "ids", "decoded"],
            )

    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids string, decoded string").withColumnRenamed("id", id_col)


def digest_table(df: DataFrame, path: str) -> DataFrame:
    """encode_table() with the strings hashed where they are made, so that they never leave the worker."""

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        c = codec(path)
        for b in batches:
            n, ids, texts = [], [], []
            for x, y in c.encode([t or "" for t in b.column(1).to_pylist()]):
                n.append(x.count(" ") + 1 if x else 0)
                ids.append(sha(x))
                texts.append(sha(y))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    tune(df.sparkSession)
    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_segment_tree_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every whole document encoded and decoded; a null text has no tokens and decodes to the empty string."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return digest_table(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), path)
