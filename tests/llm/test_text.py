"""Decontamination, classifiers, BPE, personal data, token files and the pipeline."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from llm_cases import prose, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from crmlake.llm import bpe, decontaminate, pii, quality, textvec, token_orc, toxicity
from crmlake.llm.labels import held_out


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANK_FILE), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(odd, tik):
    got = Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in rows(bpe.bpe_decode(bpe.bpe_encode(odd))))
    want = Counter((r["doc_id"], tuple(tik.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in rows(odd))
    assert got == want


def test_bpe_query(spark, sf, sf_texts, tik):
    for r in rows(bpe.op3_bpe(spark, sf)):
        ids = tik.encode_ordinary(sf_texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sf_texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("text", ["a" * 1001, "abab" * 99, "=====-----=====", "é" * 40, "   \n\n\n \t x", "<|endoftext|>", "日本語テキスト ½ ²"])
def test_merge_replay_on_repeats(tik, text):
    words = bpe.Words(bpe.Model.of(bpe.read_ranks(public_tokenizers.path(bpe.RANK_FILE))))
    ids, counts = words.encode([text, "", text], regex.compile(public_tokenizers.PATTERN).findall)
    want = tik.encode_ordinary(text)
    assert ids.tolist() == want * 2 and counts.tolist() == [len(want), 0, len(want)]


def test_token_files(spark, odd, tmp_path):
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(30, "Don't <|endoftext|> stop!?"), (31, "<|ENDOFTEXT|>x ÀÉ..."), (32, "it's 's U.S.A. a,b c!! ﬁ Å é   x y\x1cz")],
        "doc_id long, text string"))
    token_orc.write_documents(more, f"{tmp_path}/tokens")
    got = rows(token_orc.read_documents(spark, f"{tmp_path}/tokens"))
    lib = Tokenizer.from_file(public_tokenizers.path(token_orc.VOCABULARY))
    docs = sorted(((r["doc_id"], r["text"]) for r in rows(more)),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    want = []
    for i, t in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, token_orc.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want
    hit = spark.read.orc(f"{tmp_path}/tokens").where("doc_id = 30")
    assert "EqualTo(doc_id,30)" in hit._jdf.queryExecution().executedPlan().toString() and hit.count() == 1


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            total = sum(int(c) if n % 2 == 0 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(reversed(d)))
            return 12 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15
    found = [(m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t) if ok(kind, m.group())]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_pii_base_spans(spark, odd):
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(40, "é 4111-1111-1111-1111 4111111111111112 +44 20 7946 0958. 00001.2.3.04 5 5 a@b @c.d a@b.c.d._e@f.g"),
         (41, "x" * 20000 + "@" + "1" * 20000 + ".a" * 3000)], "doc_id long, text string"))
    got = Counter((r["doc_id"], tuple(r["b"].split(",")) if r["b"] else ()) for r in rows(
        pii.find_pii(more).select("doc_id", pii.joined_spans(F.col("base")).alias("b"))))
    assert got == Counter((r["doc_id"], tuple(brute_pii(r["text"] or ""))) for r in rows(more))


def test_pii_spans_of_long_texts_take_linear_time(spark):
    """100,000 matches in one text, in order, at their places."""
    import time
    text = "".join(f"a{i}@b.c {'wort ' if i % 3 else ''}" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = df.select(pii.matches(F.col("text"), pii.PATTERNS["email"], "email").alias("m")).first().m
    assert time.time() - began < 40
    assert [(m.start, m.end) for m in got] == [m.span() for m in re.finditer(BASE["email"], text)]
    few = df.select(pii.matches(F.col("text"), pii.TERM, "term", lambda hit: hit == "wort").alias("m")).first().m
    assert [(m.start, m.value) for m in few] == [(m.start(), "wort") for m in re.finditer("wort", text)]


def test_pii_disclosing_terms_and_sanitising(spark):
    """A name that only stands near one address discloses it; a common word doesn't."""
    docs = [(i, f"filler{i} words about nothing much here") for i in range(60)]
    docs += [(100 + i, f"please write to Zorgelina soon, address zorg@mail.example.com thanks nothing{i}") for i in range(3)]
    df = spark.createDataFrame(docs + [(200, None)], "doc_id long, text string")
    found = pii.find_pii(df)
    got = {r["doc_id"]: r for r in rows(found)}
    text = dict(docs)[100]
    terms = {text[t["start"]:t["end"]] for t in got[100]["terms"]}
    assert "Zorgelina" in terms and "nothing" not in terms and not got[5]["terms"] and got[200]["base"] == []
    clean = {r["doc_id"]: r["text"] for r in rows(pii.sanitised(found))}
    assert "[EMAIL]" in clean[100] and "[TERM]" in clean[100] and "Zorgelina" not in clean[100] and clean[5] is None
    assert "Zorgelina" not in {r["doc_id"]: r["text"] for r in rows(pii.sanitised(found, remove=True))}[101]


def test_pii_query(spark, sf, sf_texts):
    for r in rows(pii.op6_pii(spark, sf)):
        want = brute_pii(sf_texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term")] == want


def test_decontamination(spark, odd):
    item = prose(40, 77)
    words = item.split()
    words[20] = "other"
    items = spark.createDataFrame([(1, item), (2, "one two"), (3, None), (4, ""), (5, prose(25, 78)), (None, item)], "item_id long, text string")
    extra = spark.createDataFrame([(50, prose(200, 79) + " (" + item.upper().replace("ÉÜÑÚ", "") + ") " + prose(50, 80)),
                                   (51, "start " + item), (52, prose(30, 81) + " " + " ".join(item.split()[:18])),
                                   (53, " ".join(words) + " tail"), (54, item)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    got = {(r["doc_id"], r["item_id"]): r for r in rows(decontaminate.contaminated(docs, items))}
    text = {r["doc_id"]: r["text"] for r in rows(extra)}

    def brute(t, i):
        """Best weighted Jaccard of any item-sized window."""
        split = lambda x: [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", x.encode())]
        w, v = split(t), split(i)
        k = min(5, len(v))
        grams = lambda x: Counter(tuple(x[j:j + k]) for j in range(len(x) - k + 1))
        own = grams(v)
        best = 0.0
        for s in range(len(w) - len(v) + 1):
            g = grams(w[s:s + len(v)])
            both = sum((g & own).values())
            best = max(best, both / sum((g | own).values()))
        return best
    names = {r["item_id"]: r["text"] for r in rows(items) if r["item_id"] and r["text"]}
    want = {(r["doc_id"], i): s for r in rows(docs) if r["text"] and len(r["text"]) < 50_000 for i, t in names.items()
            if (s := brute(r["text"], t)) >= 0.8}
    assert set(got) == set(want) and all(abs(got[p]["similarity"] - want[p]) < 1e-9 for p in want)
    assert (54, 1) in got and (52, 1) not in got and (8, 2) in got
    r = got[(51, 1)]
    assert text[51].encode()[r["start"]:r["end"]].decode().rstrip(",.") == item.rstrip(",.")
    clean = {r["doc_id"] for r in rows(decontaminate.keep_clean(docs, items))}
    assert clean == {r["doc_id"] for r in rows(docs)} - {d for d, _ in want}


def test_decontamination_query(spark, sf, sf_texts):
    items = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.op1_decontamination(spark, sf))}
    assert {(d, i) for d, t in sf_texts.items() for i, x in items.items() if x in t} <= got


def test_multi_index_finds_all_within_the_radius():
    pick = np.random.default_rng(5)
    index = decontaminate.Index([(i, prose(30, 500 + i).encode()) for i in range(300)])
    near = index.prints.copy()
    for n in range(len(near)):
        for b in pick.choice(64, int(pick.integers(0, 20)), replace=False):
            near[n] ^= np.uint64(1) << np.uint64(b)
    k, n = index.shape[0]
    window, item = index.candidates(near, k, n)
    apart = np.bitwise_count(near[:, None] ^ index.prints[None, :])
    same = (index.shape[:, 0] == k) & (index.shape[:, 1] == n)
    want = {(w, i) for w, i in zip(*np.nonzero(apart <= decontaminate.RADIUS), strict=True) if same[i]}
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == want


def labelled(spark, bad):
    docs = [(i, prose(60, i) + (bad if i % 4 == 0 else "") + " " + prose(10, -i - 1)) for i in range(800)]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(700)], "doc_id long, quality int, toxic int"))


def test_toxicity_learns_and_holds_out(spark, odd, empty):
    docs, labels = labelled(spark, " vile brute")
    model = toxicity.fit(docs, labels)
    assert len(model[0]) < 2000
    scored = rows(toxicity.score_toxicity(docs, model).withColumn("held", held_out(F.col("doc_id"))))
    for r in scored:
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in scored if r["held"]]) > 0.98
    assert toxicity.score_toxicity(odd, model).count() == odd.count() and toxicity.score_toxicity(empty, model).count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and not [r for r in rows(kept) if r["doc_id"] % 4 == 0 and r["doc_id"] % 5 == 0]
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, none).where("score BETWEEN 0 AND 1").count() == 800


def test_ftrl_is_sparse_and_per_coordinate():
    model = toxicity.Ftrl(3)
    for _ in range(200):
        model.learn(np.array([0, 1]), 1)
        model.learn(np.array([0]), 0)
    w = model.weights(np.arange(4))
    assert w[1] > 1 and w[2] == 0 and model.n[0] > model.n[1]


def test_quality_learns(spark, odd, empty):
    docs, labels = labelled(spark, " $$$ ### %%% zz zz zz zz zz zz zz zz")
    model = quality.fit(docs, labels)
    scored = rows(quality.score_quality(docs, model).withColumn("held", held_out(F.col("doc_id"))))
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in scored if r["held"]]) > 0.95
    assert quality.score_quality(odd, model).count() == odd.count() and quality.score_quality(empty, model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert quality.score_quality(docs, none).where("score BETWEEN 0 AND 1").count() == 800


def test_empty_tables(spark, empty, tmp_path):
    items = spark.createDataFrame([(1, prose(30, 1))], "item_id long, text string")
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.keep_clean(empty, items.limit(0)).count() == 0
    assert bpe.bpe_decode(bpe.bpe_encode(empty)).count() == 0 and pii.find_pii(empty).count() == 0
    token_orc.write_documents(empty, f"{tmp_path}/none")
    assert token_orc.read_documents(spark, f"{tmp_path}/none").count() == 0


def test_word_hashes_match_plain_splitting():
    texts = [prose(50, 9).encode(), b"", b" x ", "É é\x0bz".encode(), b"word" * 10]
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    starts, ends, hashes, doc = textvec.words(buf, offsets, textvec.whitespace_words())
    got = [(d, buf[a:b].tobytes()) for d, a, b in zip(doc, starts, ends, strict=True)]
    assert got == [(n, w) for n, t in enumerate(texts) for w in t.split()]
    known = {}
    for (_, w), h in zip(got, hashes, strict=True):
        assert known.setdefault(w.lower(), h) == h
    assert len(set(known.values())) == len(known)


def test_pipeline_against_its_parts(spark, sf, sf_texts, tik):
    """Each stage judged on its own input, by brute force where that is possible."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        kept[name] = ({r[0] for r in before.select("doc_id").collect()}, {r[0] for r in docs.select("doc_id").collect()})
    before, after = kept["exact_dedup"]
    groups = {}
    for i in sorted(before, key=lambda i: (-len(sf_texts[i]), i)):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", sf_texts[i]), i)
    assert after == set(groups.values())
    before, after = kept["ngram_join"]
    from test_dedup import brute_join
    assert after == {i for i, _, c in brute_join([(i, sf_texts[i]) for i in before], 5, 80) if i == c}
    items = [r[1] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = kept["decontamination"]
    assert not [i for i in after if any(x in sf_texts[i] for x in items)]
    out = rows(corpus_pipeline.run(spark, sf))
    assert {r["doc_id"] for r in out} == after
    for r in out:
        assert r["ids"] == tik.encode_ordinary(sf_texts[r["doc_id"]])


def brute_terms(texts, threshold=pii.THRESHOLD, min_docs=pii.MIN_DOCS):
    """Disclosing spans of every text, from counts over all texts (each text one document)."""
    word = regex.compile(r"\p{L}{4,}+")
    near, ent, has = [], [], Counter()
    for t in texts:
        own = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in brute_pii(t))]
        ent.append({(k, t[a:b].lower()) for k, a, b in own})
        has.update(set(word.findall(t.lower())))
        found = set()
        for k, a, b in own:
            lo, hi = max(a - pii.CONTEXT, 0), min(b + pii.CONTEXT, len(t))
            hits = [(m.start() + lo, m.end() + lo) for m in word.finditer(t[lo:a]) if m.start() > 0 or lo == 0]
            hits += [(m.start() + b, m.end() + b) for m in word.finditer(t[b:hi]) if m.end() + b < b + pii.CONTEXT or hi - b < pii.CONTEXT]
            found |= {((k, t[a:b].lower()), x, y) for x, y in hits}
        near.append((own, found))
    n_ent = Counter(e for es in ent for e in es)
    joint = Counter(p for (t, (_, f)) in zip(texts, near, strict=True) for p in {(e, t[x:y].lower()) for e, x, y in f})
    out = []
    for t, (own, found) in zip(texts, near, strict=True):
        spans = set()
        for e, x, y in found:
            w = t[x:y].lower()
            ic = np.log2(len(texts)) - np.log2(n_ent[e])
            if joint[e, w] >= min_docs and has[w] and ic > 0 and \
                    np.log2(joint[e, w]) + np.log2(len(texts)) - np.log2(has[w]) - np.log2(n_ent[e]) >= threshold * ic and \
                    not any(a < y and x < b for _, a, b in own):
                spans.add((x, y))
        out.append(sorted(spans))
    return out


def test_pii_terms_equal_brute_force(spark, sf_texts):
    """Also with null and repeated ids: each row is a document of its own."""
    texts = list(sf_texts.values())
    texts += [f"word{i} call Brandolin at +1 555 010 99{i % 4}{i % 4} today, Ask for Vexley" for i in range(12)]
    ids = [None if n % 3 == 0 else n % 7 for n in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = Counter((r["doc_id"], tuple((t["start"], t["end"]) for t in r["terms"])) for r in rows(pii.find_pii(df).drop("text", "base")))
    want = brute_terms(texts)
    assert any(want) and got == Counter((i, tuple(w)) for i, w in zip(ids, want, strict=True))


def test_pii_terms_far_away_and_everywhere(spark):
    """A name far from the address it discloses, at each of its places, also where the address is missing."""
    gap = " ".join(["filler words about nothing much here"] * 20)
    docs = [(i, f"filler words about nothing much here {i}") for i in range(400)]
    docs += [(1000 + i, f"Zorgelina wrote this. {gap} Ask zorgelina! {gap} zorg@mail.example.com") for i in range(8)]
    docs += [(2000, f"Only Zorgelina, {gap} and ZORGELINA"), (2001, gap)]
    found = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string"))
    text = dict(docs)
    marked = {r["doc_id"]: [[text[r["doc_id"]][t["start"]:t["end"]] for t in r[c]] for c in ("terms", "elsewhere")] for r in rows(found)}
    assert marked[1003] == [["Zorgelina", "wrote", "this", "zorgelina"], []] and marked[2000] == [[], ["Zorgelina", "ZORGELINA"]]
    assert marked[2001] == [[], []] and not any(marked[i] != [[], []] for i in range(400))
    clean = {r["doc_id"]: r["text"] for r in rows(pii.sanitised(found))}
    assert clean[2000] == f"Only [TERM], {gap} and [TERM]" and clean[2001] is None
    assert "orgelina" not in clean[1003] and clean[1003].endswith("[EMAIL]")


def test_pii_listed_terms(spark):
    terms = spark.createDataFrame([(f"word{i}",) for i in range(500)], "term string")
    words = spark.createDataFrame([(i, f"word{i}") for i in range(5000)], "i int, term string")
    held = {r["i"] for r in rows(words.where(pii._listed(terms)(F.col("term"))))}
    assert set(range(500)) <= held and len(held) < 1000


def test_decontamination_of_texts_shorter_than_the_item(spark):
    """An item without its last words, as a whole document, is one window."""
    item = prose(30, 90).replace(",", "").replace(".", "")
    words = item.split()
    items = spark.createDataFrame([(1, item), (2, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(n, " ".join(words[:n])) for n in (29, 26, 25, 24, 10, 4)] + [(100, "one two"), (101, "")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(decontaminate.contaminated(docs, items))}
    assert set(got) == {n for n in (29, 26, 25) if (n - 4) / 26 >= 0.8}
    assert got[29]["similarity"] == pytest.approx(25 / 26) and (got[29]["start"], got[29]["end"]) == (0, len(" ".join(words[:29]).encode()))
    assert {r["doc_id"] for r in rows(decontaminate.keep_clean(docs, items))} == {24, 10, 4, 100, 101}


def test_radius_admits_pairs_at_the_threshold():
    """Items altered in two places, at similarities just over 0.8, are all found, also those over 15 bits apart."""
    split = lambda t: textvec.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), decontaminate.WORD)[2]
    apart = []
    for seed in range(400):
        words = [f"w{seed}x{j}" for j in range(59)]
        index = decontaminate.Index([(1, " ".join(words).encode())])
        altered = split(" ".join(["y", *words[1:30], "z", *words[31:]]))
        s, first, size = index.matches(altered)[1]
        assert (s, first, size) == (pytest.approx(49 / 61), 0, 59)
        apart.append(int(np.bitwise_count(decontaminate.simhash(textvec.shingles(altered, 5)) ^ index.prints[0])))
    assert max(apart) > 15


def test_decontamination_by_items_without_id(spark):
    a, b, c = prose(30, 91), prose(30, 92), prose(30, 93)
    items = spark.createDataFrame([(1, a), (None, a), (None, b), (None, b), (None, c)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {a}"), (2, f"{b} x {c}"), (3, prose(30, 94))], "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["start"]) for r in rows(decontaminate.contaminated(docs, items))]
    assert sorted(got, key=str) == [(1, 1, 2), (2, None, 0), (2, None, len(f"{b} x ".encode()))]
    assert [r["doc_id"] for r in rows(decontaminate.keep_clean(docs, items))] == [3]


@pytest.mark.parametrize("block", [20_000, 1])
def test_decontamination_by_an_id_with_two_texts(spark, monkeypatch, block):
    """One row per document and item, whatever block its texts are in."""
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", block)
    a, b, c = prose(30, 95), prose(30, 96), prose(30, 97)
    items = spark.createDataFrame([(1, a), (1, b), (2, c), (2, None), (None, c)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {a} y {b}"), (2, c), (3, f"{b}")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in rows(decontaminate.contaminated(docs, items)))
    assert got == [(1, 1), (2, 2), (3, 1)]
    assert decontaminate.keep_clean(docs, items).count() == 0


def test_pii_pairs_only_entities_that_can_disclose(spark):
    """A text with thousands of unique addresses and words makes no pair for them."""
    many = " ".join(f"u{i}@mail.example.com {chr(97 + i % 26)}{'abcdefghij'[i % 10]}word{'klmnopq'[i % 7]}" for i in range(3000))
    docs = [(1, many)] + [(i, f"Zorgelina zorg@mail.example.com number{i}") for i in range(2, 5)] + [(i, "nothing here") for i in range(5, 60)]
    found = spark.createDataFrame(docs, "doc_id long, text string").select("text", pii.base_spans(F.col("text")).alias("base"))
    terms = pii.disclosing_terms(found)
    got = {(r["entity"], r["term"]) for r in rows(terms)}
    assert {e for e, _ in got} == {"0zorg@mail.example.com"} and {"zorgelina", "number"} <= {t for _, t in got}
