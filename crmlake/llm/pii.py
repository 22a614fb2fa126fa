"""Personal data by patterns and by information-theoretic disclosure (native DataFrame code).

Patterns find e-mail addresses, IP addresses, payment cards (Luhn) and phone
numbers: leftmost, non-overlapping per kind, positions in code points. They
protect entities: each different value found. A term *discloses* an entity when
corpus co-occurrence says that seeing the term tells most of what seeing the
entity tells:

    PMI(term, entity) = log2( p(term, entity) / (p(term) p(entity)) )
    IC(entity)        = -log2 p(entity)
    disclosed         when PMI >= threshold * IC, on at least min_docs documents

with probabilities over documents (null texts included). Terms are words of at
least ``MIN_TERM`` letters anywhere in a document that holds the entity; p(term)
counts all documents that hold the term. Because PMI = IC - (-log2 p(entity|term)),
the test reads p(entity|term) >= 2 ** -((1 - threshold) * IC). Disclosing terms
become spans of kind ``term`` at each of their places outside base matches: ``terms``
in documents that hold an entity they disclose, ``elsewhere`` in all other texts. In
sanitised texts both are generalised to ``[TERM]``; base matches become ``[EMAIL]``
and so on, or are removed.

Rows: null text is empty; the id is only carried, so null and repeated ids are fine
(each row counts as one document in the corpus statistics).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crmlake.llm.common import written

LOCAL = "A-Za-z0-9._%+-"
# Equal to the plain patterns, but each run of characters is tried once (possessive
# quantifiers, no start inside a run), so long runs cost linear time.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS) + ["term"]
TERM = r"\p{L}{4,}+"
MIN_TERM = 4
CONTEXT = 2 ** 31 - 1      # code points around an entity that count as near it: more than a text can have
THRESHOLD = 0.9
MIN_DOCS = 2
BLOCK = 256                # matches whose positions are added up together
CELLS = 1 << 18            # of hashes, for broadcast filters before exact joins
LISTED_BITS = 1 << 21
NONE = "array<struct<start:int,kind:int,end:int,value:string>>"


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def matches(text: Column, pattern: str | Column, kind: str, keep=None) -> Column:
    """array<struct<start, kind, end, value>> of all matches, or of those whose value
    ``keep`` accepts; the gaps between matches (a split on the same pattern) give their
    positions. Positions are added up in blocks of ``BLOCK`` matches, then over the blocks, so a text with
    very many matches copies no growing list."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    number = F.lit(KINDS.index(kind)).alias("kind")

    def add(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["hit"]), F.lit(0))
        row = F.struct(start.alias("start"), number, end.alias("end"), p["hit"].alias("value"))
        skip = p["hit"].isNull() if keep is None else p["hit"].isNull() | ~keep(p["hit"])
        return F.struct(end.alias("at"), F.when(skip, acc["rows"]).otherwise(
            F.concat(acc["rows"], F.array(row))).alias("rows"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("rows"))

    def before(acc, block):
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def shifted(block, by):
        return F.transform(block["rows"], lambda r: F.struct((r["start"] + by).alias("start"), r["kind"].alias("kind"),
                                                             (r["end"] + by).alias("end"), r["value"].alias("value")))
    firsts = lambda p: F.sequence(F.lit(1), F.size(p), F.lit(BLOCK))
    blocks = _bound(pairs, lambda p: F.transform(firsts(p), lambda at: F.aggregate(F.slice(p, at, BLOCK), begin, add)))
    return F.flatten(_bound(blocks, lambda q: F.zip_with(q, F.aggregate(q, none, before, lambda acc: acc["starts"]), shifted)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Luhn checksum of the digits of ``value``."""
    reverse = F.split(F.reverse(_digits(value)), "")

    def weight(d, i):
        n = F.when(d == "", 0).otherwise(d.cast("int"))
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))
    return F.aggregate(F.transform(reverse, weight), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Valid base matches of all kinds, by start, then kind."""
    none = F.array().cast(NONE)
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    small = lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.lpad(bare(p), 3, "0") <= "255"))
    count = lambda v: F.length(_digits(v))
    found = [
        F.when(F.contains(text, F.lit("@")), matches(text, PATTERNS["email"], "email")),
        F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), F.filter(matches(text, PATTERNS["ip"], "ip"), lambda m: small(m["value"]))),
        F.when(F.rlike(text, F.lit(r"[0-9](?:[ -]?[0-9]){11}")),
               F.filter(matches(text, PATTERNS["card"], "card"), lambda m: luhn(m["value"]))),
        F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PATTERNS["phone"], "phone"),
                                                      lambda m: count(m["value"]).between(9, 15))),
    ]
    return F.sort_array(F.concat(*[F.coalesce(f, none) for f in found]))


def joined_spans(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(F.sort_array(spans), lambda m: F.concat_ws(
        ":", name(m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def _entity(m: Column) -> Column:
    """Key of the value found: its kind and its text in lower case."""
    return F.concat(m["kind"].cast("string"), F.lower(m["value"]))


def _terms(text: Column) -> Column:
    """Distinct words of a text in lower case; the empty string if it has none."""
    return F.array_distinct(F.split(F.lower(F.array_join(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), "\t")), "\t"))


def _cell(value: Column, cells: int = CELLS) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(cells)).cast("int")


def disclosing_terms(found: DataFrame, threshold: float = THRESHOLD, min_docs: int = MIN_DOCS) -> DataFrame:
    """(entity, term, pmi, ic) over the threshold. ``found``: text and base of all rows.
    Values are made distinct within their row, so every count is summed in the map tasks
    before its shuffle."""
    n = max(found.count(), 1)
    count, log = F.count(F.lit(1)), lambda c: F.log2(c.cast("double"))
    own = F.array_distinct(F.transform("base", _entity))
    entities = written(found.select(F.explode(own).alias("entity")).groupBy("entity").agg(count.alias("n_entity"))
                       .withColumn("ic", F.log2(F.lit(float(n))) - log(F.col("n_entity")))
                       .where((F.col("n_entity") >= min_docs) & (F.col("ic") > 0)), "pii-entities")
    per_term = written(found.select(F.explode(_terms(F.col("text"))).alias("term")).where("term <> ''")
                       .groupBy("term").agg(count.alias("n_term")).where(F.col("n_term") >= min_docs), "pii-terms")
    # n_joint is at most n_entity and n_term, so a pair can pass only if both are at least
    # min_docs and log2(n / n_term) >= threshold * IC. Cells of hashes (at most CELLS rows,
    # so small enough to broadcast) hold the bounds of all values in them and drop most other
    # pairs before they are counted; the joins after it are on the values themselves.
    rare = per_term.groupBy(_cell(F.col("term")).alias("cell")).agg((F.log2(F.lit(float(n))) - log(F.min("n_term"))).alias("most"))
    need = entities.groupBy(_cell(F.col("entity")).alias("cell")).agg((F.min("ic") * threshold if threshold >= 0 else F.max("ic") * threshold).alias("need"))
    # a document pairs only its entities that are on the list: one that names many unique values pairs none of them
    known = _listed(entities.select(F.col("entity").alias("term")))
    joint = (found.where(F.size("base") > 0).select(F.filter(own, known).alias("own"), "text").where(F.size("own") > 0)
             .select("own", F.explode(_terms(F.col("text"))).alias("term")).where("term <> ''")
             .withColumn("cell", _cell(F.col("term"))).join(F.broadcast(rare), "cell").drop("cell")
             .select(F.explode("own").alias("entity"), "term", "most")
             .withColumn("cell", _cell(F.col("entity"))).join(F.broadcast(need), "cell").where("most >= need - 1e-6")
             .groupBy("entity", "term").agg(count.alias("n_joint")).where(F.col("n_joint") >= min_docs))
    return (written(joint, "pii-joint").join(per_term, "term").join(entities, "entity")
            .withColumn("pmi", log(F.col("n_joint")) + F.log2(F.lit(float(n))) - log(F.col("n_term")) - log(F.col("n_entity")))
            .where(F.col("pmi") >= threshold * F.col("ic"))
            .select("entity", "term", "pmi", "ic"))


def _listed(terms: DataFrame):
    """A test that holds for every term of ``terms`` and few other words: a bit per cell of
    hashes, 32 bits a term or more up to LISTED_BITS."""
    cells = min(LISTED_BITS, max(1 << 10, 1 << (32 * terms.count()).bit_length()))
    flags = bytearray(cells // 8)
    for byte, bits in (terms.select(_cell(F.col("term"), cells).alias("cell")).groupBy(F.expr("shiftright(cell, 3)"))
                       .agg(F.bit_or(F.expr("shiftleft(1, cell & 7)"))).collect()):
        flags[byte] = bits

    def listed(term):
        cell = _cell(term, cells)
        byte = F.ascii(F.decode(F.substring(F.lit(flags), F.shiftright(cell, 3) + 1, F.lit(1)), "ISO-8859-1"))
        return F.getbit(byte, cell.bitwiseAND(F.lit(7))) == 1
    return listed


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
             min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text, base (spans with values), terms and elsewhere (disclosing spans), one row per row of ``docs``."""
    corpus = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the number of a row is written with it, so it stays the same when tasks run again
    found = written(corpus.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", base_spans(F.col("text")).alias("base")),
                    "pii-found")
    risky = written(disclosing_terms(found, threshold, min_docs).groupBy("term").agg(F.collect_set("entity").alias("entities")),
                    "pii-disclosing")
    listed = _listed(risky)
    outside = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    places = F.filter(matches(F.col("text"), TERM, "term", lambda hit: listed(F.lower(hit))), outside)
    each = (found.where(F.exists(_terms(F.col("text")), listed)).select("row", F.explode(places).alias("t"))
            .select("row", "t.start", "t.kind", "t.end", F.lower("t.value").alias("term")))
    # only numbers, spans and values are shuffled, never texts (unless the caller reads them)
    spans = (each.join(risky, "term").groupBy("row")
             .agg(F.collect_list(F.struct("start", "kind", "end", F.col("term").alias("value"), "entities")).alias("spans")))
    own = F.transform("base", _entity)

    def chosen(test):
        kept = F.transform(F.filter("spans", test), lambda t: F.struct(t["start"], t["kind"], t["end"], t["value"]))
        return F.sort_array(F.coalesce(kept.cast(NONE), F.array().cast(NONE)))
    return found.join(spans, "row", "left").select(
        "doc_id", "text", "base", chosen(lambda t: F.arrays_overlap(own, t["entities"])).alias("terms"),
        chosen(lambda t: ~F.arrays_overlap(own, t["entities"])).alias("elsewhere"))


def sanitised(found: DataFrame, remove: bool = False) -> DataFrame:
    """doc_id and the text with every span generalised to its kind, or removed; null where
    nothing was found (the original text stands). Spans that overlap merge."""
    spans = F.sort_array(F.concat("base", "terms", "elsewhere"))
    name = lambda k: F.element_at(F.array(*[F.lit("" if remove else f"[{x.upper()}]") for x in KINDS]), k + 1)

    def add(acc, m):
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(m["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.concat(
            acc["out"], gap, F.when(m["start"] >= acc["at"], name(m["kind"])).otherwise(F.lit(""))).alias("out"))
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(
        acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.select("doc_id", F.when(F.size(spans) > 0, done).alias("text"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Counts of base matches, their digest, and all spans, per document."""
    from crmlake.llm.common import documents
    found = find_pii(documents(spark, sf_dir))
    number = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long")
    return found.select("doc_id", *[number(KINDS.index(k)).alias(f"n_{k}") for k in PATTERNS],
                        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
                        joined_spans(F.concat("base", "terms", "elsewhere")).alias("spans"))
