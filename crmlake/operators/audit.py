"""Integrity audit (S14): the constraints MySQL enforces on write, reported
over files.

Checks come from the table contracts (``sources.schemas``): primary key and
UNIQUE duplicates, NOT NULL, VARCHAR length, and foreign keys whose parent
table is part of the audit. Result: one row per check with ``violations``
(offending rows) and ``keys`` (distinct duplicated or orphaned key values;
0 for the per-row NOT NULL and length rules).

Execution (``audit_violations``): every table is read once. A row gives one
tagged entry for each key, UNIQUE and foreign-key value it holds and one for each
row rule it breaks; the entries of all tables go through one grouping (domain,
role, value), which partial aggregation combines inside the map tasks, so a
key holding a third of the rows costs one row per task. A foreign key and the key it points at
share a domain: a second grouping of the distinct values, by (domain, value),
shows which values no parent has. Values that occur once in a domain without
children are dropped before it. No join, no second scan.

Whole-number values travel as numbers and others as text. With ``mode="ci_ai"``
text is compared as the database's collation does (case, accents and trailing
blanks ignored), after equal spellings were counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crmlake.functions.predicates import ACCENT_COLLATION
from crmlake.sources.schemas import TABLES, Table

RESULT_COLUMNS = ["table_name", "check_name", "column_name", "violations", "keys"]
PARENT = -1                 # role of the key values that foreign keys may point at


@dataclass(frozen=True)
class Check:
    table: str
    kind: str          # primary_key | unique | not_null | max_length | foreign_key
    column: str
    arg: object = None  # max length, or (parent table, parent key)


def plan_checks(present: dict[str, list[str]], contracts: dict[str, Table] = TABLES) -> list[Check]:
    """All checks applicable to the given tables and their present columns."""
    checks = []
    for name, cols in present.items():
        t = contracts[name]
        have = set(cols)
        if t.key in have:
            checks.append(Check(name, "primary_key", t.key))
        for u in t.unique:
            if u in have:
                checks.append(Check(name, "unique", u))
        for c in t.not_null:
            if c in have:
                checks.append(Check(name, "not_null", c))
        for c, n in t.lengths.items():
            if c in have:
                checks.append(Check(name, "max_length", c, n))
        for col, parent, pkey in t.foreign:
            if col in have and parent in present and pkey in present[parent]:
                checks.append(Check(name, "foreign_key", col, (parent, pkey)))
    return checks


def integrity_audit(tables: dict[str, DataFrame], contracts: dict[str, Table] = TABLES,
                    mode: str = "binary") -> DataFrame:
    """One row per check: offending rows and distinct offending key values,
    summarised from ``audit_violations`` (checks without findings show 0)."""
    checks = plan_checks({n: df.columns for n, df in tables.items()}, contracts)
    spark = next(iter(tables.values())).sparkSession
    listed = spark.createDataFrame([(c.table, c.kind, c.column) for c in checks],
                                   "table_name string, check_name string, column_name string")
    found = (audit_violations(tables, contracts, mode)
             .groupBy("table_name", "check_name", "column_name")
             .agg(F.sum("rows").alias("v"), F.count(F.lit(1)).alias("k")))
    per_row = F.col("check_name").isin("not_null", "max_length")
    return (listed.join(found, ["table_name", "check_name", "column_name"], "left")
            .select("table_name", "check_name", "column_name",
                    F.coalesce(F.col("v"), F.lit(0)).cast("long").alias("violations"),
                    F.when(per_row, F.lit(0)).otherwise(F.coalesce(F.col("k"), F.lit(0)))
                    .cast("long").alias("keys")))


def _is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _entry(when: str, domain: int, role: int, column: str, whole: bool) -> str:
    """SQL of a tagged value (whole numbers as numbers, all else as text), null unless ``when``."""
    number = f"CAST(`{column}` AS BIGINT)" if whole else "CAST(NULL AS BIGINT)"
    text = "CAST(NULL AS STRING)" if whole else f"CAST(`{column}` AS STRING)"
    return f"IF({when}, named_struct('domain', {domain}, 'role', {role}, 'number', {number}, 'text', {text}), NULL)"


def _breaks(c: Check) -> str:
    return f"`{c.column}` IS NULL" if c.kind == "not_null" else f"coalesce(length(`{c.column}`) > {c.arg}, false)"


def _entries_sql(source: str, values: list[str], broken: list[tuple[str, str]]) -> str:
    """The entries of one table. Rules are looked at one by one only in rows that break one."""
    whole = f"array({', '.join(values + [e for _, e in broken])})"
    if values and broken:
        whole = f"IF({' OR '.join(cond for cond, _ in broken)}, {whole}, array({', '.join(values)}))"
    return f"SELECT e.* FROM (SELECT explode({whole}) AS e FROM {{{source}}}) WHERE e IS NOT NULL"


def audit_violations(tables: dict[str, DataFrame], contracts: dict[str, Table] = TABLES,
                     mode: str = "binary") -> DataFrame:
    """The offending values behind every finding, one row each: duplicated
    key values, orphaned foreign-key values, and the row key of rows that
    break a NOT NULL or length rule (``value`` as text; of values that the
    collation holds equal, the smallest)."""
    if mode not in ("binary", "ci_ai"):
        raise ValueError(f"unknown mode {mode!r}")
    collate = mode == "ci_ai"
    checks = plan_checks({n: df.columns for n, df in tables.items()}, contracts)
    # domains: one per key or UNIQUE column; a foreign key belongs to its parent's
    domains: dict[tuple[str, str], int] = {}
    for c in checks:
        if c.kind in ("primary_key", "unique"):
            domains.setdefault((c.table, c.column), len(domains))
        elif c.kind == "foreign_key":
            domains.setdefault(c.arg, len(domains))
    members = {at: [at] for at in domains}
    for c in checks:
        if c.kind == "foreign_key":
            members[c.arg].append((c.table, c.column))
    whole = {at: all(_is_whole(tables[t], col) for t, col in own) for at, own in members.items()}
    parents = {c.arg for c in checks if c.kind == "foreign_key"}
    single = [domains[at] for at in domains if at not in parents]

    parts, sources = [], {}
    for name, df in tables.items():
        key, values, broken = contracts[name].key, [], []
        for at, domain in domains.items():
            if at[0] == name:
                values.append(_entry(f"`{at[1]}` IS NOT NULL", domain, PARENT, at[1], whole[at]))
        for role, c in enumerate(checks):
            if c.table == name and c.kind == "foreign_key":
                values.append(_entry(f"`{c.column}` IS NOT NULL", domains[c.arg], role, c.column, whole[c.arg]))
            elif c.table == name and c.kind in ("not_null", "max_length"):
                cond = _breaks(c)
                broken.append((cond, _entry(cond, len(domains), role, key, _is_whole(df, key))))
        if values or broken:
            sources[f"t{len(parts)}"] = df
            parts.append(_entries_sql(f"t{len(parts)}", values, broken))
    spark = next(iter(tables.values())).sparkSession
    # ``texts`` tells text from numbers after the grouping (a condition on ``text`` would move below it and scan twice)
    counted = spark.sql(" UNION ALL ".join(parts), **sources).groupBy("domain", "role", "number", "text").agg(
        F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"))
    if collate:     # keys under a collation are sorted to be grouped: only distinct spellings are, never numbers
        spelt = counted.where(F.col("texts") > 0).groupBy("domain", "role", F.collate("text", ACCENT_COLLATION).alias("text")).agg(
            F.sum("n").alias("n"), F.min(F.collate("text", "UTF8_BINARY")).alias("shown"))
        found = _met(counted.where(F.col("texts") == 0).withColumn("shown", F.col("text")), single, "number").unionByName(
            _met(spelt.withColumn("number", F.lit(None).cast("long")), single, "text"))
    else:
        found = _met(counted.withColumn("shown", F.col("text")), single, "number", "text")
    rules = F.col("domain") == len(domains)
    repeated = ~child_role("role") & (F.col("n") > 1)
    orphaned = child_role("role") & ~rules & F.col("parents").isNull()
    labels = [(domains[c.table, c.column], PARENT, *_name(c)) for c in checks if c.kind in ("primary_key", "unique")]
    labels += [(domains[c.arg] if c.kind == "foreign_key" else len(domains), role, *_name(c))
               for role, c in enumerate(checks) if c.kind not in ("primary_key", "unique")]
    names = spark.createDataFrame(labels, "domain int, role int, table_name string, check_name string, column_name string")
    return (found.where(rules | repeated | orphaned).join(F.broadcast(names), ["domain", "role"])
            .select("table_name", "check_name", "column_name",
                    F.coalesce(F.col("number").cast("string"), F.col("shown")).alias("value"), F.col("n").alias("rows")))


def _met(counted: DataFrame, single: list[int], *value: str) -> DataFrame:
    """The counted values that may be findings, with the rows that hold the value as a key (``parents``)."""
    # a finding needs two rows, or a domain that foreign keys point at, or a broken row rule
    met = counted.where((F.col("n") > 1) | ~F.col("domain").isin(single)).groupBy("domain", *value).agg(
        F.max(F.when(~child_role("role"), F.col("n"))).alias("parents"),
        # at most one entry per foreign key of the domain, or per row rule
        F.collect_list(F.struct("role", "n", "number", "shown")).alias("own"))
    return met.select("domain", "parents", F.explode("own").alias("o")).select("domain", "parents", "o.*")


def child_role(name: str) -> Column:
    return F.col(name) != PARENT


def _name(c: Check) -> tuple[str, str, str]:
    return c.table, c.kind, c.column
