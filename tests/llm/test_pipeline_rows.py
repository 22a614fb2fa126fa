"""The pipeline's stages on odd and empty tables, and the registered token files against the library."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_cases import rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from crmlake.llm import token_orc
from crmlake.llm.common import documents


def folder(spark, docs, path, sf):
    """A data folder whose documents are ``docs``; labels and benchmark are the given ones."""
    docs.write.parquet(f"{path}/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{path}/{table}.parquet")
    return str(path)


def test_stages_take_odd_rows(spark, odd, sf, tmp_path):
    """Null and repeated ids, null and very long texts, repeated rows, extra columns: every stage but the last
    keeps the columns, and what is left is what the stages' rules leave."""
    docs = odd.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"),
                            "feature": F.lit(1), "kept": F.lit("x"), "component_id": F.lit(2), "codes": F.lit(3)})
    path = folder(spark, docs, tmp_path, sf)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, path), f"odd-{name}")
        assert docs.columns == odd.columns + ["lang", "source", "n_chars", "feature", "kept", "component_id", "codes"]
    left = rows(docs)
    out = rows(corpus_pipeline.run(spark, path))
    assert sorted((str(r["doc_id"]) for r in out)) == sorted(str(r["doc_id"]) for r in left)
    texts = ["".join((r["text"] or "").split()) for r in left]
    assert len(texts) == len(set(texts))                                  # no exact copy is left
    assert {r["doc_id"] for r in left} >= {8, 10, 14, 17} and 2 in {r["doc_id"] for r in rows(odd)}
    assert not {1, 3} <= {r["doc_id"] for r in left}                       # near copies: one stays


def test_no_documents(spark, odd, sf, tmp_path):
    path = folder(spark, odd.limit(0), tmp_path, sf)
    out = corpus_pipeline.run(spark, path)
    assert out.count() == 0 and {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_token_files_query(spark, sf, sf_texts):
    lib = Tokenizer.from_file(public_tokenizers.path(token_orc.VOCABULARY))
    start, want = 0, []
    for i in sorted(sf_texts):
        ids = [*lib.encode(sf_texts[i], add_special_tokens=False).ids, token_orc.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_orc.op10_token_orc(spark, sf)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r[c] for c in got.columns[:4]) for r in rows(got)) == want


def test_token_files_hold_a_bloom_filter_and_row_indexes(spark, sf, tmp_path):
    token_orc.write_documents(documents(spark, sf), f"{tmp_path}/tokens")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [str(f) for f in tmp_path.rglob("*.orc")]
    seen = 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        if reader.getNumberOfRows():
            names = list(reader.getSchema().getFieldNames())
            wanted = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
            for i in range(len(wanted)):
                wanted[i] = True
            index = reader.rows().readRowIndex(0, wanted, wanted)
            blooms, entries = index.getBloomFilterIndex(), index.getRowGroupIndex()
            assert blooms[names.index("doc_id") + 1] is not None and entries[names.index("doc_id") + 1] is not None
            seen += 1
    assert seen


@pytest.mark.parametrize("n", [0, 3])
def test_token_files_of_rows_without_id(spark, tmp_path, n):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(n)] + [(1, None)], "doc_id long, text string")
    token_orc.write_documents(docs, f"{tmp_path}/t")
    got = rows(token_orc.read_documents(spark, f"{tmp_path}/t").orderBy("start"))
    assert [r["doc_id"] for r in got] == [None] * n + [1]
