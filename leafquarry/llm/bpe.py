"""Byte-level BPE over whole texts by a pair occurrence index.

Each task splits its texts into words, gives every distinct word one entry, and merges all entries together: an index
maps each pair's rank to all positions where the pair stands, the active ranks are applied in ascending order, and each
application updates the lists of the pairs it has made. A rank creates only pairs of higher rank, so this gives every
word the result of merging it alone. The split follows the public byte-level pattern; special tokens are cut out first.

Defined cases: a null or empty text has no tokens and decodes to the empty text; repeated rows and ids are encoded each
on its own; an empty table gives an empty result; texts of any length are encoded whole; only the id and text columns
(and those named in keep) are read, so clashing names elsewhere do no harm.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship_package

# Fixed value: the public byte-level split pattern, and the same over the characters of _PLAIN alone, for the quicker re.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_QUICK = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile(r"[^\t-\r\x20-\x7e\xa0-ɏ‐-‧€]")
_FULL = regex.compile(PATTERN)

#: Distinct words held for reuse by a task, and bytes of text that are split before their new words are merged.
CACHE_WORDS, CHUNK_BYTES = 200_000, 3 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs [offset, offset + length)."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(offsets - ends + lengths, lengths) + np.arange(ends[-1])


class Encoder:
    def __init__(self, raw: str):
        spec = json.loads(raw)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.left, self.right, self.made = left, right, np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for t, i in vocab.items():
            pieces[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in self.special.items():
            pieces[i] = t.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_off = np.concatenate([[0], np.cumsum(self.piece_len)])[:-1]
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.fresh: list[str] = []
        self.off, self.len, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], -1)

    def merge(self, entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each entry) by the pair occurrence index over all entries together."""
        lens = np.array([len(w) for w in entries], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(entries), np.uint8)]
        n = len(sym)
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lens)
        nxt[ends[lens > 0] - 1] = -1
        prev[(ends - lens)[lens > 0]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(pos: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks >= 0
            pos, ranks = pos[keep], ranks[keep]
            if not len(pos):
                return
            order = np.argsort(ranks, kind="stable")
            pos, ranks = pos[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lo = 0
            for hi in [*cuts.tolist(), len(pos)]:
                r = int(ranks[lo])
                if r in index:
                    index[r].append(pos[lo:hi])
                else:
                    index[r] = [pos[lo:hi]]
                    heapq.heappush(active, r)
                lo = hi

        at = np.flatnonzero(nxt >= 0)
        note(at, self._ranks(sym[at], sym[nxt[at]]))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.left[r], self.right[r], self.made[r]
            q = nxt[p]
            ok = alive[p] & (q >= 0) & (sym[p] == a) & (sym[q] == b)
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            if a == b and len(p) > 1:  # in a run of equal tokens every other pair merges, from the left
                p = np.unique(p)
                q = nxt[p]
                linked = np.concatenate([[False], q[:-1] == p[1:]])
                first = np.maximum.accumulate(np.where(linked, -1, np.arange(len(p))))
                even = (np.arange(len(p)) - first) % 2 == 0
                p, q = p[even], q[even]
            sym[p] = new
            alive[q] = False
            after = nxt[q]
            nxt[p] = after
            has = after >= 0
            prev[after[has]] = p[has]
            before = prev[p]
            left = before[before >= 0]
            right = p[has]
            where = np.concatenate([left, right])
            if len(where):
                note(where, self._ranks(sym[where], sym[nxt[where]]))
        row = np.repeat(np.arange(len(entries)), lens)[alive] if n else np.zeros(0, np.int64)
        return sym[alive], np.bincount(row, minlength=len(entries)).astype(np.int64)

    def split(self, text: str) -> list[int]:
        """The entries of a text; special tokens are entries of their own kind, -1 - id."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,)
        out: list[int] = []
        find = _FULL if _NOT_PLAIN.search(text) else _QUICK
        for part in parts:
            if part in self.special:
                out.append(-1 - self.special[part])
            elif part:
                out += map(self.index.__getitem__, find.findall(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text)."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        known = len(self.index)
        rows = [np.array(self.split(t), np.int64) for t in texts]
        if len(self.index) > known:
            new = [w.encode() for w in list(self.index)[known:]]
            flat, lens = self.merge(new)
            self.off = np.concatenate([self.off, len(self.flat) + np.cumsum(lens) - lens])
            self.len = np.concatenate([self.len, lens])
            self.flat = np.concatenate([self.flat, flat])
        entry = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        special = entry < 0
        at = np.where(special, 0, entry)
        lens = np.where(special, 1, self.len[at]) if len(self.len) else np.ones(len(entry), np.int64)
        src = np.where(special, 0, self.off[at]) if len(self.off) else np.zeros(len(entry), np.int64)
        ids = self.flat[ragged(src, lens)] if len(self.flat) else np.zeros(len(entry), np.int64)
        ids[(np.cumsum(lens) - lens)[special]] = -1 - entry[special]
        return ids, np.bincount(row, lens, len(rows)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the text; what isn't UTF-8 becomes U+FFFD."""
        raw = self.piece_bytes[ragged(self.piece_off[ids], self.piece_len[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(2)
def encoder(raw: str) -> Encoder:
    return Encoder(raw)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), ids: bool = True, digests: bool = False) -> DataFrame:
    """(id, keep..., n_tokens, [ids array<int>], [ids_sha256, decoded_sha256]). tokenizer: path of a byte-level BPE file,
    read by the driver and broadcast (its size is the vocabulary's, whatever the corpus)."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        raw = spark.sparkContext.broadcast(f.read())
    names = [id_col, *keep]

    def run(batches):
        enc = encoder(raw.value)
        for batch in batches:
            lo = 0
            texts = batch.column("text")
            while lo < batch.num_rows:
                hi, part, size = lo, [], 0
                while hi < batch.num_rows and (not part or size < CHUNK_BYTES):
                    part.append(texts[hi].as_py() or "")
                    size += len(part[-1])
                    hi += 1
                yield emit(enc, batch.slice(lo, hi - lo), part)
                lo = hi

    def emit(enc: Encoder, batch: pa.RecordBatch, part: list[str]) -> pa.RecordBatch:
        flat, lens = enc.encode(part)
        ends = np.cumsum(lens)
        cols = [batch.column(k) for k in range(len(names))] + [pa.array(lens, pa.int64())]
        if ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32())))
        if digests:
            each = [flat[e - n : e] for e, n in zip(ends, lens, strict=True)]
            cols.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()))
            cols.append(pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in each], pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=out_names)

    out_names = [f"c{k}" for k in range(len(names))] + ["n_tokens"] + ["ids"] * ids + ["ids_sha256", "decoded_sha256"] * digests
    kinds = [docs.schema[c].dataType.simpleString() for c in names]
    schema = ", ".join([f"c{k} {t}" for k, t in enumerate(kinds)] + ["n_tokens long"] + ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests)
    src = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)], F.col(text_col).alias("text"))
    return src.mapInArrow(run, schema).withColumnsRenamed({f"c{k}": c for k, c in enumerate(names)})


def bpe_decode(encoded: DataFrame, tokenizer: str | None = None, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """The rows with one more column, out: the text that the ids stand for (null ids: null)."""
    spark = encoded.sparkSession
    ship_package(spark)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        raw = spark.sparkContext.broadcast(f.read())
    out = free_name(encoded, out)

    @F.pandas_udf("string")
    def decode(column):
        enc = encoder(raw.value)
        return column.map(lambda x: None if x is None else enc.decode(np.asarray(x, np.int64)).decode())

    return encoded.withColumn(out, decode(F.col(ids_col)))
