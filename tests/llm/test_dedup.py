"""Exact, line, suffix and n-gram deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm_cases import rows
from pyspark.sql import functions as F

import __spark_entry__ as E
from crmlake.llm import exact_dedup, line_dedup, ngram_join, suffix_dedup
from crmlake.llm.common import connected_components
from crmlake.llm.queries import ORACLE_SQL

SPACE = re.compile(r"[\x20\x09-\x0D]")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def pairs_of(df):
    return [(r["doc_id"], r["text"] or "") for r in rows(df)]


def brute_exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[SPACE.sub("", t)].append((-len(t), i is None, i))
    out = []
    for i, t in docs:
        norm = SPACE.sub("", t)
        keep = min(groups[norm], key=lambda g: (g[0], g[1], g[2] or 0))[2]
        out.append((i, keep, len(groups[norm]), i == keep, sha(norm)))
    return Counter(out)


@pytest.mark.parametrize("page", [2, 4096])
def test_exact_dedup_odd_rows(odd, page):
    got = rows(exact_dedup.exact_dedup(odd, page_entries=page, cell_bits=6))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == brute_exact(pairs_of(odd))


def test_exact_dedup_of_rows_that_share_an_id(spark):
    """Of one id's texts that differ in white space, the longest stays, alone."""
    docs = spark.createDataFrame([(1, "a b"), (1, "ab"), (1, " a  b "), (2, "ab "), (None, "a b     "), (None, "cd"), (None, "c d"), (3, "x"), (3, "x")],
                                 "doc_id long, text string")
    got = rows(exact_dedup.exact_dedup(docs))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["text_sha256"] == sha("ab")) == Counter(
        {(1, None, 5): 3, (2, None, 5): 1, (None, None, 5): 1})
    assert Counter((r["doc_id"], r["kept"]) for r in got if r["kept"]) == Counter({(None, True): 2, (3, True): 2})
    kept = rows(exact_dedup.keep_first(docs))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("3", "x"), ("None", "a b     "), ("None", "c d")]


def test_exact_dedup_deals_owners_by_number(spark):
    """Rows of a small table reach as many tasks as there are owners with rows."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    plan = exact_dedup.build_index(docs, page_entries=16)[1]._jdf.queryExecution().toString()
    assert "owner" in plan
    buckets = exact_dedup.grow_directory({c: 1 for c in range(1 << 12)}, 12, 16)
    owners = Counter(r[3] for r in exact_dedup.directory_rows(buckets, 64))
    assert len(owners) == 64 and max(owners.values()) == min(owners.values())


def test_exact_dedup_salted_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same  text' ELSE concat('t', id) END AS text")
    got = {r["doc_id"]: r for r in rows(exact_dedup.exact_dedup(docs))}
    assert got[2997]["keep_id"] == 0 and got[0]["group_size"] == 1000 and got[1]["group_size"] == 1


def test_directory_splits_only_overfull_buckets():
    counts = {c: (50 if c < 4 else 1) for c in range(64)}
    buckets = exact_dedup.grow_directory(counts, cell_bits=6, capacity=60)
    assert [b.first for b in buckets][0] == 0 and buckets[-1].last == 63
    assert all(b.entries <= 60 or b.depth == 6 for b in buckets) and len({b.depth for b in buckets}) > 1
    cells = [r[0] for r in exact_dedup.directory_rows(buckets, 4)]
    assert cells == list(range(64))


def test_exact_keep_first_keeps_columns_and_one_of_repeated_rows(odd):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    texts = [SPACE.sub("", r["text"] or "") for r in rows(kept)]
    assert len(texts) == len(set(texts)) == len({SPACE.sub("", t) for _, t in pairs_of(odd)})


def brute_lines(docs):
    lines = [(i, t.split("\n")) for i, t in docs]
    key = lambda i, p: (i is None, i or 0, p)
    first = {}
    for i, ls in lines:
        for p in range(len(ls) - 2):
            w = tuple(ls[p:p + 3])
            first[w] = min(first.get(w, key(i, p)), key(i, p))
    out = []
    for i, ls in lines:
        gone = {q for j, other in lines if j == i for p in range(len(other) - 2)
                if SPACE.sub("", "".join(w := tuple(other[p:p + 3]))) and first[w] != key(i, p) for q in range(p, p + 3)}
        gone = {g for g in gone if g < len(ls)} if len([1 for j, _ in lines if j == i]) == 1 else None
        out.append((i, ls, gone))
    return out


def test_line_dedup_odd_rows(odd):
    unique = odd.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    got = {r["doc_id"]: r for r in rows(line_dedup.line_dedup(unique))}
    for i, ls, gone in brute_lines(pairs_of(unique)):
        assert got[i]["n_lines"] == len(ls) and got[i]["n_removed"] == len(gone)
        assert (got[i]["text"] or "") == "\n".join(x for p, x in enumerate(ls) if p not in gone)
    assert got[14]["n_removed"] == 3 and got[14]["n_spans"] == 1 and got[15]["n_removed"] == 0
    assert set(odd.columns) <= set(line_dedup.line_dedup(odd).columns)
    assert line_dedup.line_dedup(odd).count() == odd.count()


def brute_suffix(docs, n=200):
    seen = Counter(t[p:p + n] for _, t in docs for p in range(len(t) - n + 1))
    out = []
    for i, t in docs:
        edge = np.zeros(len(t) + 1, int)
        for p in range(len(t) - n + 1):
            if seen[t[p:p + n]] > 1:
                edge[p] += 1
                edge[p + n] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return Counter(out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_odd_rows(odd, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    small = odd.where("length(text) < 100000 OR text IS NULL")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows(suffix_dedup.suffix_dedup(small)))
    assert got == brute_suffix([(i, t.encode()) for i, t in pairs_of(small)])


def test_suffix_dedup_segments_and_chunks(odd, monkeypatch):
    """Small segments cut runs; what they leave open is settled by single starts."""
    docs = [(i, t.encode()) for i, t in pairs_of(odd) if len(t) < 100_000]
    buf = np.frombuffer(b"".join(t for _, t in docs), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for _, t in docs])]
    whole = suffix_dedup.anchored_runs(buf, offsets)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 997)
    cut = suffix_dedup.anchored_runs(buf, offsets)
    starts = lambda r: np.concatenate([np.arange(s, s + c) for s, c in zip(r[0], r[1], strict=True)])
    assert (np.sort(starts(whole)) == np.sort(starts(cut))).all() and len(cut[0]) > len(whole[0])


def brute_join(docs, k, percent):
    sets = defaultdict(list)
    for i, t in docs:
        w = t.encode().lower().split()
        s = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets[i].append(s)
    parent = {i: i for i in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(parent)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if any(x & y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i)) for i, own in sets.items() for s in own)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_join_odd_rows(odd, k, percent):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.ngram_join(odd, k=k, percent=percent)))
    assert got == brute_join(pairs_of(odd), k, percent)


def test_ngram_join_whole_table(spark, sf, sf_texts):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(E.queries()["op7_ngram_join"](spark, sf)))
    assert got == brute_join(list(sf_texts.items()), 4, 85)


def test_ngram_join_group_of_near_copies(spark):
    """A hub with copies that are each close to it, but not to one another."""
    base = [f"w{i}" for i in range(400)]
    docs = [(0, " ".join(base))]
    for i in range(1, 40):
        own = list(base)
        for j in range(3):
            own[(i * 9 + j * 120) % 400] = f"x{i}_{j}"
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.ngram_join(df, k=4, percent=94)))
    assert got == brute_join(docs, 4, 94)


def test_ngram_join_salted_lists(odd, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALT_ABOVE", 1)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.ngram_join(odd)))
    assert got == brute_join(pairs_of(odd), 4, 85)


def test_full_bins_salt_no_list():
    """Bins that a large corpus fills alike leave lists whole; a shingle far above them is salted."""
    import pyarrow as pa

    class Counts:
        value = np.full(1 << ngram_join.BIN_BITS, 5_000_000)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a b c d e f", "g h i j k l", "m n o p q r"])], names=["doc_id", "text"])
    out = pa.Table.from_batches(ngram_join.prefix_pass(4, 85, Counts)([batch]))
    assert set(out.column("salt").to_pylist()) == {0}
    hot = out.column("token").to_pylist()[0]
    Counts.value = Counts.value.copy()
    Counts.value[hot & ((1 << ngram_join.BIN_BITS) - 1)] += 10 * ngram_join.SALT_ABOVE
    out = pa.Table.from_batches(ngram_join.prefix_pass(4, 100, Counts)([batch])).to_pylist()
    assert all((r["salt"] > 0) == (r["token"] == hot) for r in out)


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 300).selectExpr("id - 1 AS a", "id AS b").union(spark.createDataFrame([(1000, 1001), (1001, 1001)], "a long, b long"))
    got = {r[0]: r[1] for r in connected_components(chain, "a", "b").collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 302


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    res = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in res.description]
    got = E.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(res.fetchall())


def test_empty_tables(empty):
    for f in (exact_dedup.exact_dedup, exact_dedup.keep_first, line_dedup.line_dedup, suffix_dedup.suffix_dedup, ngram_join.ngram_join,
              ngram_join.keep_first):
        assert f(empty).count() == 0


def test_native_operators_run_no_python(odd):
    for df in (exact_dedup.exact_dedup(odd), line_dedup.line_dedup(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_suffix_dedup_rows_without_id(spark):
    """Many rows share an id or have none; each keeps its own bytes."""
    block = "".join(chr(97 + (i * i + 3 * i) % 26) for i in range(260))
    docs = [(None if i % 2 else 5, f"{i:03d} " * 40 + (block if i % 50 == 0 else "") + f" end {i}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows(suffix_dedup.suffix_dedup(df)))
    assert got == brute_suffix([(i, t.encode()) for i, t in docs])


def test_suffix_rows_are_told_apart_by_more_than_32_bits(spark):
    """Two texts with one 32-bit hash (found by search) are two rows: t1 and t2 differ."""
    hashed = spark.range(300_000).selectExpr("concat('text ', id) AS text").selectExpr("text", "hash(text) AS th", "xxhash64(text) AS t1", "xxhash64(1, text) AS t2")
    twice = hashed.groupBy("th").agg(F.count("*").alias("n"), F.count_distinct("t1", "t2").alias("m"))
    assert twice.where("n > 1").count() > 0 and twice.where("n <> m").count() == 0


def test_line_dedup_of_long_texts_takes_linear_time(spark):
    """60,000 short lines a document with thousands of runs: seconds, and equal to brute force."""
    import random
    import time
    pick = random.Random(4)
    docs = []
    for i in range(3):
        lines = [f"{i}-{j}" for j in range(60_000)]
        for _ in range(4_000):
            at = pick.randrange(60_000 - 8)
            lines[at:at + 4] = ["a", "b", "c", "d"][:pick.randrange(2, 5)] + lines[at:at + 4][:1]
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    began = time.time()
    got = {r["doc_id"]: r for r in rows(line_dedup.line_dedup(df))}
    assert time.time() - began < 60
    seen, want = set(), {}
    for i, t in docs:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        spans = sum(g - 1 not in gone for g in gone)
        want[i] = (len(lines), len(gone), spans, "\n".join(x for p, x in enumerate(lines) if p not in gone))
    assert want[2][2] > 1000 and {i: (r["n_lines"], r["n_removed"], r["n_spans"], r["text"]) for i, r in got.items()} == want


def test_line_dedup_refuses_clashing_columns(odd):
    with pytest.raises(ValueError, match="n_lines"):
        line_dedup.line_dedup(odd.withColumn("n_lines", F.lit(1)))
