"""Merkle proofs against a plain tree."""
import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crmlake.llm import merkle as M

LOWER = str.maketrans(M.A_TO_Z, M.A_TO_Z.lower())


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plainly(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([t[2] for t in sorted(by[x], key=lambda t: t[:3])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(by[lang], key=lambda t: t[:3])):
            value, proof = leaf, ""
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                value = leaf_of((*r[:4], r[4] and r[4].translate(LOWER)))
            for levels, at in ((trees[lang], i), (top, k)):
                for nodes in levels[:-1]:
                    lo = at // 8 * 8
                    before, after = "".join(nodes[lo:at]), "".join(nodes[at + 1:lo + 8])
                    value, proof, at = h(before + value + after), proof + before + after, at // 8
            out.append((r[0], leaf, trees[lang][-1][0], top[-1][0], h(proof), value, value == top[-1][0]))
    return Counter(out)


def manifest(df, **kw):
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    whole = M.leaf(*map(F.col, M.FIELDS))
    low = M.leaf(*[F.translate("text", M.A_TO_Z, M.A_TO_Z.lower()) if c == "text" else F.col(c) for c in M.FIELDS])
    out = M.merkle_proofs(df.select("*", whole.alias("leaf"), F.when(changed, low).otherwise(whole).alias("seen")), **kw)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


KIND = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_proofs_of_many_sizes(spark, depth):
    rows = []
    for lang, n in ((None, 9), ("", 1), ("de", 8), ("en", 700), ("fr", 65), ("É", 64), ("zz", 2)):
        rows += [(len(rows) + i, "s" if i % 3 else None, lang, i, f"Text {i} Ünï" if i % 5 else None) for i in range(n)]
    rows += [(7, None, "en", None, "Again"), (7, None, "en", None, "Again"), (None, "x", "en", 1, "No id"), (2**60 + 1, "x", "en", 1, "B" * 200_000)]
    df = spark.createDataFrame(rows, KIND).withColumns({"g": F.lit(1), "pos": F.lit("x"), "n": F.lit(0), "block": F.lit(2), "root": F.lit(3)})
    got = Counter(tuple(r) for r in manifest(df.repartition(7), depth=depth).drop("steps").collect())
    assert got == plainly(rows)


def test_many_groups_one_row_and_no_rows(spark):
    rows = [(i, None, f"l{i:03d}", 1, "A") for i in range(90)]
    for part in (rows, rows[:1]):
        got = Counter(tuple(r) for r in manifest(spark.createDataFrame(part, KIND), depth=1).drop("steps").collect())
        assert got == plainly(part)
    assert manifest(spark.createDataFrame([], KIND)).count() == 0


def test_kept_steps_fold_to_the_root(spark):
    rows = [(i, None, "en", 1, f"Row {i}") for i in range(30)]
    for r in manifest(spark.createDataFrame(rows, KIND), keep_steps=True).collect():
        value = r.leaf
        for s in r.steps:
            value = h(s.before + value + s.after)
        assert value == r.root and r.proof_sha256 == h("".join(s.before + s.after for s in r.steps))


def test_a_group_spreads_over_superblocks(spark):
    """Copies of one row, all in one group: no task of the exchange holds more than a superblock."""
    same = spark.range(600).select(F.lit(5).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
                                   F.lit(1).cast("long").alias("n_chars"), F.lit("Same").alias("text"))
    got = Counter(tuple(r) for r in manifest(same, depth=2).drop("steps").collect())
    assert got == plainly([(5, "s", "en", 1, "Same")] * 600)


def test_registered_query_against_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = Counter(tuple(r) for r in M.op12_merkle(spark, sf).collect())
    assert got == Counter(con.sql(M.OP12_SQL).fetchall())
    assert got == plainly([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*M.FIELDS).collect()])
