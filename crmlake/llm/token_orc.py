"""Token ids as ORC files: integer run-length encoded columns in stripes, with row
indexes and a Bloom filter on the document id.

Documents are range-partitioned and sorted by id (rows that share an id by
text), so each file covers a range of ids and stripes can be pruned by their
minimum and maximum as well as by the Bloom filter. Each document's ids end with
``end_id``. Files: part (number of the writing task), pos (row in it), doc_id, ids.

``read_documents`` reads them back in parallel: n_tokens, the CRC-32 of the
ids as little-endian unsigned 32-bit integers, and the place of the first id
in the stream of all documents (totals per file, then a running sum in a file).

The library encodes each distinct word once per worker. White space and punctuation
after a word separate pretokens in this tokenizer, so pieces of a text encode as
the whole text does; texts with ``<|`` (special tokens) go to the library whole.

Rows: null and empty texts hold only the end id; rows without id come first.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crmlake.llm import textvec as tv
from crmlake.llm.common import documents, shuffle_partitions, work_path, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
KEEP_WORDS = 1_000_000
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
           "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20), "compression": "zstd"}
SCHEMA = "part int, pos int, doc_id long, ids array<int>"
# a word's last letter, then punctuation up to white space: a space between them changes nothing
# (the look-behind follows the first mark, so the search skips from mark to mark)
TAIL = re.compile(rb"[!#$%&*,.:;?](?<=[a-z0-9].)[!#$%&*,.:;?]*(?=[\x20\x09-\x0d]|\Z)")
PLAIN = re.compile("[a-zß-öø-ÿ]+")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The tokenizers library with a bounded memory of encoded words."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.full = Tokenizer.from_str(vocabulary)
        # lower-case letters need neither normalising nor splitting
        self.plain = Tokenizer.from_str(vocabulary)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.full.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for w, i in names.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def of(vocabulary: str) -> Encoder:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        return _encoders[vocabulary]

    def learn(self, words: list[bytes]) -> None:
        simple, other = [], []
        for word in words:
            text = word.decode()
            if PLAIN.fullmatch(text):
                simple.append(word)
            else:
                other.append(text)
        for lo in range(0, len(simple), 1000):
            part = simple[lo:lo + 1000]
            ids = np.array(self.plain.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            data, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            for word, a, b in zip(part, [0, *ends[:-1]], ends, strict=True):
                self.known[word] = data[a:b]
        for lo in range(0, len(other), 1000):
            part = other[lo:lo + 1000]
            for word, found in zip(part, self.full.encode_batch(part, add_special_tokens=False), strict=True):
                self.known[word.encode()] = np.array(found.ids, np.uint32).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEEP_WORDS:
            self.known.clear()
        split = [None if b"<|" in t else TAIL.sub(rb" \g<0>", t.lower()).split() for t in texts]
        fresh = set().union(*[s for s in split if s is not None]).difference(self.known)
        if fresh:
            self.learn(sorted(fresh))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) if s is not None else
                np.array(self.full.encode(t.decode(), add_special_tokens=False).ids, np.uint32).tobytes()
                for t, s in zip(texts, split, strict=True)]


def encode_pass(vocabulary, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, pos = Encoder.of(vocabulary.value), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for rows, buf, offsets in tv.chunks(batches, "text"):
            data = buf.tobytes()
            ids = encoder.encode([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            n = len(ids)
            flat = np.frombuffer(b"".join(x + end for x in ids), "<u4").astype(np.int32)
            lengths = np.array([len(x) // 4 + 1 for x in ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(pos, pos + n), pa.int32()), rows.column("doc_id"),
                 pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat, pa.int32()))],
                names=["part", "pos", "doc_id", "ids"])
            pos += n
    return run


def checksum_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        lengths = ids.value_lengths().to_numpy()
        data = ids.flatten().to_numpy().astype("<u4").tobytes()
        ends = (np.r_[0, np.cumsum(lengths)] * 4).tolist()
        sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("pos"), batch.column("doc_id"),
                                          pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                                         names=["part", "pos", "doc_id", "n_tokens", "ids_crc32"])


def write_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                    vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text and write the ids as ORC files in ascending id order."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = max(shuffle_partitions(docs.sparkSession), docs.sparkSession.sparkContext.defaultParallelism)
    ordered = texts.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode_pass(model, end_id), SCHEMA).write.options(**OPTIONS).orc(path)


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files of ``write_documents``."""
    # totals and result both need the rows: decode the files once, keep the narrow rows
    rows = written(spark.read.schema(SCHEMA).orc(path)
                   .mapInArrow(checksum_pass, "part int, pos int, doc_id long, n_tokens long, ids_crc32 long"), "token-sums")
    in_file = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return (rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0))).join(F.broadcast(before), "part")
            .select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32"))


def op10_token_orc(spark, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    write_documents(documents(spark, sf_dir), path)
    return read_documents(spark, path)
