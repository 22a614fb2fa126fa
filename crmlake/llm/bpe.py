"""Byte-level BPE encoding and decoding by merge replay.

A task gathers the distinct pretokens ("words") of its share of the corpus and
replays the merges over all of them at once: an inverted index maps the rank of a
token pair to the positions where it stands; ranks are taken in ascending
order, every position of a rank is merged in one step, and only the neighbours
of merged positions are looked up and indexed again. Words are linked lists of
tokens in flat arrays. Documents are then put together from their words.

A pair's rank is the rank of its joined bytes, as in tiktoken, so a new pair of a
lower rank than the current one goes first. Special tokens are ordinary text.

Rows: null and empty texts have no tokens. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmlake.llm import textvec as tv
from crmlake.llm.common import documents

RANK_FILE = "byte_bpe_50k.tiktoken"
CHUNK = 2 << 20            # bytes of text whose new words are merged together
KEEP_BYTES = 16 << 20      # memory of encoded words that a task keeps from chunk to chunk, about
ENTRY = 150                # bytes that a kept word takes besides its own
NONE = np.int32(np.iinfo(np.int32).max)
_models: dict[bytes, Model] = {}


def distinct(at: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    at = np.sort(at)
    new = np.ones(len(at), bool)
    np.not_equal(at[1:], at[:-1], out=new[1:])
    return at[new]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Model:
    """Rank table of a rank file, with a sorted table of all pairs that form a token."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        pairs = []
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(((a << 32) | b, rank))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = table[:, 0].copy(), table[:, 1].astype(np.int32)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.token_start, self.token_length = np.cumsum(lengths) - lengths, lengths
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    @staticmethod
    def of(raw: bytes) -> Model:
        if raw not in _models:
            _models[raw] = Model(raw)
        return _models[raw]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, NONE where it is no token."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words one after the other, offsets per word)."""
        buf = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        n = len(buf)
        token = self.byte_ids[buf]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE, np.int32)              # of the pair that begins here
        at = np.flatnonzero(after >= 0)
        rank[at] = self.pair_rank(token[at], token[after[at]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            if not len(at):
                return
            own = rank[at]
            order = own.argsort(kind="stable")
            at, own = at[order], own[order]
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            lo = 0
            for r, hi in zip(own[np.concatenate(([0], cut))].tolist(), [*cut.tolist(), len(at)], strict=True):
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(heap, r)
                lo = hi
        add(at)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = distinct(at[rank[at] == r])
            if not len(at):
                continue
            linked = after[at[:-1]] == at[1:]          # overlapping pairs: every other one, from the left
            if linked.any():
                head = np.concatenate(([True], ~linked))
                start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            then = after[gone]
            token[at] = r
            alive[gone] = False
            rank[gone] = NONE
            after[at] = then
            has = then >= 0
            before[then[has]] = at[has]
            left = before[at]
            touched = distinct(np.concatenate((at, left[left >= 0])))
            nxt = after[touched]
            fresh = np.full(len(touched), NONE, np.int32)
            ok = nxt >= 0
            fresh[ok] = self.pair_rank(token[touched[ok]], token[nxt[ok]])
            rank[touched] = fresh
            add(touched)
        counts = np.add.reduceat(alive, ends - sizes, dtype=np.int64) if n else np.zeros(0, np.int64)
        return token[alive], np.r_[0, np.cumsum(counts)]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A word that is a token itself is that token; the others are merged."""
        known = [self.ranks.get(w) for w in words]
        ids, offsets = self.merge_words(rest := [w for w, k in zip(words, known, strict=True) if k is None])
        counts = np.ones(len(words), np.int64)
        is_rest = np.array([k is None for k in known], bool)
        counts[is_rest] = np.diff(offsets) if rest else 0
        out = np.empty(int(counts.sum()), np.int32)
        fill = np.repeat(is_rest, counts)
        out[fill] = ids
        out[~fill] = [k for k in known if k is not None]
        return out, np.r_[0, np.cumsum(counts)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens, length of each)."""
        lengths = self.token_length[ids]
        total = int(lengths.sum())
        shift = np.repeat(self.token_start[ids] - (np.cumsum(lengths) - lengths), lengths)
        return self.token_bytes[np.arange(total) + shift], lengths


class Numbers(dict):
    """Numbers new keys in the order in which they are asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Words:
    """The encoded words of a task: number of each word, and its ids."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number, self.held = Numbers(), 0
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def encode(self, texts: list[str], find) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids per text)."""
        if self.held > KEEP_BYTES:
            self.forget()
        number, found = self.number, []
        known = len(number)
        for text in texts:
            found.append(np.fromiter(map(number.__getitem__, find(text)), np.int64))
        fresh = [w.encode() for w in islice(number, known, None)]
        if fresh:
            self.held += sum(map(len, fresh)) + ENTRY * len(fresh)
            ids, offsets = self.model.encode_words(fresh)
            self.ids = np.concatenate((self.ids, ids))
            self.offsets = np.concatenate((self.offsets, offsets[1:] + self.offsets[-1]))
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        counts = self.offsets[flat + 1] - self.offsets[flat]
        shift = np.repeat(self.offsets[flat] - (np.cumsum(counts) - counts), counts)
        ids = self.ids[np.arange(int(counts.sum())) + shift]
        ends = np.cumsum(np.r_[0, counts])[np.cumsum([0, *map(len, found)])]
        return ids, np.diff(ends)


def encode_pass(raw, pattern: str, decode: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Model.of(raw.value))
        find = regex.compile(pattern).findall
        for rows, buf, offsets in gathered(batches, "text"):
            data = buf.tobytes()
            texts = [data[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ids, counts = words.encode(texts, find)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
            out = pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], names=["doc_id", "ids"])
            yield from decoded_rows(words.model, out) if decode else [out]
    return run


def gathered(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Chunks of about CHUNK bytes, over the borders of record batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for rows, _, offsets in tv.chunks(batches, text, CHUNK):
        held.append(rows)
        size += int(offsets[-1])
        if size >= CHUNK:
            yield from _joined(held, text)
            held, size = [], 0
    if held:
        yield from _joined(held, text)


def _joined(held: list[pa.RecordBatch], text: str):
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()
    for r in rows:
        buf, offsets = tv.text_buffer(r.column(r.schema.get_field_index(text)))
        yield r, buf, offsets


def decoded_rows(model: Model, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` with the bytes of its ids, a few rows at a time."""
    for lo in range(0, batch.num_rows, 256):
        rows = batch.slice(lo, 256)
        ids = rows.column("ids")
        data, lengths = model.decode(ids.flatten().to_numpy())
        ends = np.cumsum(np.r_[0, lengths])[np.cumsum(np.r_[0, ids.value_lengths().fill_null(0).to_numpy()])]
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), ids, texts.cast(pa.binary())], names=["doc_id", "ids", "decoded"])


def decode_pass(raw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from decoded_rows(Model.of(raw.value), batch)
    return run


def _ranks(df: DataFrame, path: str | None):
    return df.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(RANK_FILE)))


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
               pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of token ids), one row per row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(encode_pass(_ranks(docs, path), pattern), "doc_id long, ids array<int>")


def bpe_decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded (the bytes of the ids). Null ids decode to nothing."""
    return tokens.select("doc_id", "ids").mapInArrow(decode_pass(_ranks(tokens, path)), "doc_id long, ids array<int>, decoded binary")


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids and decoded: both directions in one task, so that a core runs one Python worker."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(encode_pass(_ranks(docs, path), pattern, True), "doc_id long, ids array<int>, decoded binary")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(text, 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(bpe_round_trip(documents(spark, sf_dir))).drop("ids")
