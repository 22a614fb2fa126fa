"""Table maintenance as batch change sets.

The reference writes one row per web form; here every operation takes
DataFrames of changes. Appends return the new rows only; updates and deletes
return the new table, or, with ``changed_only``, the rows that an update changed
(``sinks.append_rows`` and ``sources.ranges`` write either without touching the
rest). Keys of changes are matched with joins; Spark's size estimates and AQE
choose between broadcast and shuffle.

Surrogate keys (AUTO_INCREMENT) are ``after + position`` of the new row in a
caller-given total order: ``after`` is the recorded high-water mark of the
table (``sinks.KeyMarks``), so no append reads the base, and the position comes
from the distributed ``global_index`` (per-partition counts, no single-partition
window). The admin guard's counts and boundary key are the only values read back
to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crmlake.functions.predicates import ACCENT_COLLATION, as_timestamp
from crmlake.functions.scalars import blank_to_null, derive_username, strip_ws
from crmlake.operators.paging import global_index
from crmlake.sources.readers import apply_defaults
from crmlake.sources.schemas import Table
from crmlake.sources.sizes import join_partitions

# Fixed values of the reference's write paths.
DEFAULT_ACCOUNT_PASSWORD = "123456"
SIGNUP_ROLE = "guest"
SIGNUP_STATUS = "Inactive"
MIN_USERNAME = 4
MIN_PASSWORD = 6


def next_keys(new: DataFrame, key: str, order, after: int) -> DataFrame:
    """Give ``new`` rows the keys ``after + 1 ..`` in ``order``. The rows are written once,
    sorted (``global_index``); whatever is derived from the result reads them from there."""
    staged = new.drop(key) if key in new.columns else new
    return (global_index(staged, order, "__pos")
            .withColumn(key, F.lit(after).cast("long") + F.col("__pos")).drop("__pos"))


def append(new: DataFrame, table: Table, as_of, order, after: int,
           optional: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """The rows an INSERT of ``new`` adds, with column DEFAULTs and surrogate
    keys after ``after``; ``columns`` (default: all of the contract) of them.

    ``optional`` text columns (form fields for nullable foreign keys and
    dates) turn blank into NULL before the cast, as the reference's
    ``x or None``.
    """
    staged = new
    for col in optional:
        if col in staged.columns:
            staged = staged.withColumn(col, blank_to_null(F.col(col).cast("string")))
    keyed = apply_defaults(next_keys(staged, table.key, order, after), table, as_of)
    return keyed.select(*(columns or keyed.columns))


def replace_rows(base: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows whose key is in ``changed`` replaced by those of ``changed``."""
    keys = changed.select(F.col(key).alias("__key")).distinct()
    kept = base.join(keys, base[key] == keys["__key"], "left_anti")
    return kept.unionByName(changed.select(*base.columns))


def latest_change(changes: DataFrame, key: str, seq: str | None) -> DataFrame:
    """One change per key: the one with the highest ``seq`` (last writer
    wins). Without ``seq`` there is no last writer: two changes for one key
    raise an error when the result is computed. Changes of a NULL key match
    no row and are left out."""
    cols = [c for c in changes.columns if c != key]
    change = F.struct(*[F.col(c) for c in cols])
    grouped = changes.filter(F.col(key).isNotNull()).groupBy(key)
    if seq is None:
        many = F.raise_error(F.concat(F.lit("several changes without an order for key "),
                                      F.col(key).cast("string")))
        one = (grouped.agg(F.first(change).alias("__one"), F.count(F.lit(1)).alias("__n"))
               .select(key, F.when(F.col("__n") > 1, many).otherwise(F.col("__one")).alias("__c")))
    else:
        one = grouped.agg(F.max_by(change, F.col(seq)).alias("__c"))
    return one.select(key, *[F.col(f"__c.{c}").alias(c) for c in cols])


def update_by_key(base: DataFrame, changes: DataFrame, key: str, columns: list[str],
                  seq: str | None = None, matched_flag: str | None = None, changed_only: bool = False,
                  rows: int | None = None) -> DataFrame:
    """``UPDATE base SET c = change.c WHERE key = change.key``.

    Several changes for one key need ``seq`` (see ``latest_change``). A NULL in a change sets NULL (it is an assignment, not a merge). Base
    rows sharing a key all receive the change. Columns absent from ``base``
    are added (NULL where unchanged). ``changed_only`` leaves out the other rows.
    With ``rows``, about how many ``base`` has, a large join is dealt by them (``sources.sizes``).
    """
    changes = changes.select(key, *columns, *([seq] if seq else []))
    dealt = join_partitions(base, key, rows, changes, key) if rows is not None else None
    if dealt:
        base, changes = base.repartition(dealt, key), changes.repartition(dealt, key)
    ch = latest_change(changes, key, seq)
    ch = ch.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in columns],
                   F.lit(True).alias("__hit"))
    out = base.join(ch, base[key] == ch["__key"], "inner" if changed_only else "left")
    hit = F.col("__hit").isNotNull()
    sets = {}
    for c in columns:
        old = F.col(c) if c in base.columns else F.lit(None)
        sets[c] = F.when(hit, F.col(f"__new_{c}")).otherwise(old.cast(ch.schema[f"__new_{c}"].dataType))
    out = out.withColumns(sets)
    if matched_flag:
        out = out.withColumn(matched_flag, hit)
    return out.drop("__key", "__hit", *[f"__new_{c}" for c in columns])


def stamp_on_transition(base: DataFrame, changes: DataFrame, key: str, status: str, stamp: str,
                        stamp_values: list[str], as_of, extra: list[str] = (),
                        preserve_existing: bool = False, seq: str | None = None,
                        rows: int | None = None) -> DataFrame:
    """Apply a status change and (re)stamp a timestamp.

    For changed rows: ``stamp = as_of`` when the new status is in
    ``stamp_values``, else NULL (so moving a resolved ticket to Closed erases
    ResolvedAt, as the reference does). ``preserve_existing`` keeps an
    existing stamp instead of re-stamping. Unchanged rows keep their stamp.
    ``rows`` as in ``update_by_key``.
    """
    out = update_by_key(base, changes, key, [status, *extra], seq=seq, matched_flag="__changed", rows=rows)
    old = F.col(stamp) if stamp in base.columns else F.lit(None).cast("timestamp_ntz")
    fresh = as_timestamp(as_of)
    stamped = F.when(F.col(status).isin(list(stamp_values)),
                     F.coalesce(old, fresh) if preserve_existing else fresh)
    new_stamp = F.when(F.col("__changed"), stamped).otherwise(old).cast("timestamp_ntz")
    return out.withColumn(stamp, new_stamp).drop("__changed")


def delete_by_key(base: DataFrame, keys: DataFrame, key: str, keys_col: str | None = None) -> DataFrame:
    """``DELETE FROM base WHERE key IN (keys)`` (NULL keys ignored)."""
    k = keys.select(F.col(keys_col or key).alias("__del")).filter(F.col("__del").isNotNull()).distinct()
    return base.join(k, base[key] == k["__del"], "left_anti")


def delete_cascade(parent: DataFrame, parent_key: str, children: dict[str, tuple[DataFrame, str]],
                   keys: DataFrame, keys_col: str | None = None) -> dict[str, DataFrame]:
    """Delete parents and every child row pointing at them.

    Returns ``{"parent": .., child_name: ..}`` snapshots; the key set is
    computed once and reused by every anti join.
    """
    k = keys.select(F.col(keys_col or parent_key).alias("__del")).filter(F.col("__del").isNotNull()).distinct()
    out = {"parent": parent.join(k, parent[parent_key] == k["__del"], "left_anti")}
    for name, (child, fk) in children.items():
        out[name] = child.join(k, child[fk] == k["__del"], "left_anti")
    return out


def delete_nullify(parent: DataFrame, parent_key: str, nullify: dict[str, tuple[DataFrame, str]],
                   keys: DataFrame, keys_col: str | None = None,
                   cascade: dict[str, tuple[DataFrame, str]] | None = None,
                   restrict: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """Delete parents; NULL the foreign key in ``nullify`` children,
    delete rows of ``cascade`` children, and report rows of ``restrict``
    children (NOT NULL foreign keys) that would be orphaned as
    ``violations_<name>`` instead of leaving a half-applied state."""
    k = keys.select(F.col(keys_col or parent_key).alias("__del")).filter(F.col("__del").isNotNull()).distinct()
    k = k.withColumn("__hit", F.lit(True))
    out = {"parent": parent.join(k.select("__del"), parent[parent_key] == k["__del"], "left_anti")}
    for name, (child, fk) in nullify.items():
        j = child.join(k, child[fk] == k["__del"], "left")
        out[name] = (j.withColumn(fk, F.when(F.col("__hit").isNotNull(), F.lit(None)).otherwise(F.col(fk))
                                  .cast(child.schema[fk].dataType))
                     .drop("__del", "__hit"))
    for name, (child, fk) in (cascade or {}).items():
        out[name] = child.join(k.select("__del"), child[fk] == k["__del"], "left_anti")
    for name, (child, fk) in (restrict or {}).items():
        out[f"violations_{name}"] = child.join(k.select("__del"), child[fk] == k["__del"], "left_semi")
    return out


def apply_enrollments(requests: DataFrame, classes: DataFrame, students: DataFrame, table: Table, as_of,
                      order, after: int, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """Register a batch of enrollment requests. The requests are written once, in
    order, and all three results read them from there:

    * enrollments: the new rows, ``FinalFee = TotalFee - Discount``, status
      Confirmed, enroll date ``as_of``;
    * classes: the changed rows, ``CurrentStudents += number of requests for
      the class`` (no seat check, as the reference);
    * students: the changed rows, every requesting student's status becomes
      Enrolled (even if already Studying, as the reference).
    """
    keyed = next_keys(requests, table.key, order, after)
    fee = F.coalesce(F.col("TotalFee"), F.lit(0)).cast("decimal(12,2)")
    disc = F.coalesce(F.col("Discount"), F.lit(0)).cast("decimal(12,2)")
    new = (keyed.withColumn("TotalFee", fee).withColumn("Discount", disc)
           .withColumn("FinalFee", (fee - disc).cast("decimal(12,2)"))
           .withColumn("Status", F.lit("Confirmed"))
           .withColumn("EnrollDate", as_timestamp(as_of).cast("date")))
    new = apply_defaults(new, table, as_of)
    per_class = keyed.groupBy(F.col("ClassID").alias("__cls")).agg(F.count(F.lit(1)).alias("__n"))
    cl = classes.join(per_class, classes["ClassID"] == per_class["__cls"])
    cl = cl.withColumn("CurrentStudents", (F.coalesce(F.col("CurrentStudents"), F.lit(0)) + F.col("__n"))
                       .cast(classes.schema["CurrentStudents"].dataType))
    who = keyed.select(F.col("StudentID")).distinct().withColumn("Status", F.lit("Enrolled"))
    st = update_by_key(students, who, "StudentID", ["Status"], changed_only=True)
    return {"enrollments": new.select(*(columns or new.columns)), "classes": cl.select(*classes.columns),
            "students": st.select(*students.columns)}


def guarded_delete(users: DataFrame, keys: DataFrame, key: str = "UserID",
                   role: str = "Role", status: str = "Status") -> dict[str, DataFrame]:
    """Delete accounts, but never the last active admin.

    The removals count as applied one after the other in key order: an admin
    (active or not) is refused once at most one active admin is left. With
    ``a`` active admins the admins after the (a-1)-th active one of the batch
    are refused, so one boundary key decides; it is among the batch's two
    last active admins. Returns ``{"users": snapshot, "refused": refused keys}``.
    """
    k = keys.select(F.col(key).alias("__del")).filter(F.col("__del").isNotNull()).distinct()
    k = k.withColumn("__hit", F.lit(True))
    marked = users.join(k, users[key] == k["__del"], "left").withColumn("__t", F.col("__hit").isNotNull())
    is_admin = F.col(role) == "admin"
    active_admin = is_admin & (F.col(status) == "Active")
    counts = marked.agg(F.count_if(active_admin).alias("a"),
                        F.count_if(active_admin & F.col("__t")).alias("d")).first()
    active, in_batch = counts["a"], counts["d"]
    if active <= 1:
        too_late = F.lit(True)
    elif in_batch < active - 1:
        too_late = F.lit(False)
    else:
        last_two = [r[0] for r in marked.filter(active_admin & F.col("__t"))
                    .orderBy(F.col(key).desc()).select(key).limit(2).collect()]
        too_late = F.col(key) > F.lit(last_two[in_batch - (active - 1)])
    refused = F.coalesce(F.col("__t") & is_admin & too_late, F.lit(False))
    snapshot = marked.filter(~F.col("__t") | refused).drop("__del", "__hit", "__t")
    return {"users": snapshot,
            "refused": marked.filter(refused).select(key)}


def _text_key(column: str, mode: str) -> Column:
    """What UNIQUE compares: the text itself, or the text under the database's collation."""
    if mode not in ("binary", "ci_ai"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.collate(F.col(column), ACCENT_COLLATION) if mode == "ci_ai" else F.col(column)


def derive_accounts(people: DataFrame, existing: DataFrame, table: Table, as_of, after: int,
                    id_col: str = "EmployeeID", email_col: str = "Email",
                    name_col: str = "FullName", mode: str = "binary") -> DataFrame:
    """Accounts for people from their e-mail local part
    (``lower(replace(substring_index(email,'@',1),'.','_'))``), role
    employee, default password; ``INSERT IGNORE``: usernames already taken
    (by an existing account or an earlier person of the batch) are skipped;
    ``mode="ci_ai"`` holds usernames equal as the database does (case, accents and
    trailing blanks ignored). Returns the new account rows, keys after ``after``."""
    cand = people.select(derive_username(email_col).alias("Username"), F.col(id_col), F.col(name_col))
    cand = cand.filter(F.col("Username").isNotNull())
    first = (cand.groupBy(_text_key("Username", mode).alias("__k"))
             .agg(F.min_by(F.struct("Username", F.col(id_col), F.col(name_col)), F.struct(F.col(id_col), "Username")).alias("__p"))
             .select("__k", F.col("__p.Username").alias("Username"), F.col(f"__p.{id_col}").alias(id_col),
                     F.col(f"__p.{name_col}").alias(name_col)))
    taken = existing.select(_text_key("Username", mode).alias("__u")).filter(F.col("__u").isNotNull()).distinct()
    fresh = first.join(taken, first["__k"] == taken["__u"], "left_anti").drop("__k")
    fresh = (fresh.withColumn("Password", F.lit(DEFAULT_ACCOUNT_PASSWORD))
             .withColumn("Role", F.lit("employee")))
    return append(fresh, table, as_of, [id_col, "Username"], after)


def signup_outcomes(requests: DataFrame, existing: DataFrame, seq: str = "seq", mode: str = "binary") -> DataFrame:
    """Validate sign-up requests in the reference's order of checks.

    Fields are stripped first. Outcomes: ``missing`` (blank username,
    password or full name), ``username_short`` (< 4), ``password_short``
    (< 6), ``confirm_mismatch``, ``duplicate`` (taken by an account, or by
    an earlier valid request of the batch, by ``seq``), else ``ok``.
    ``mode="ci_ai"`` holds usernames equal as the database does.
    """
    r = requests.select(F.col(seq), strip_ws("Username").alias("Username"),
                        strip_ws("Password").alias("Password"), strip_ws("Confirm").alias("Confirm"),
                        strip_ws("FullName").alias("FullName"))
    blank = lambda c: F.coalesce(F.length(F.col(c)), F.lit(0)) == 0
    pre = (F.when(blank("Username") | blank("Password") | blank("FullName"), F.lit("missing"))
           .when(F.length("Username") < MIN_USERNAME, F.lit("username_short"))
           .when(F.length("Password") < MIN_PASSWORD, F.lit("password_short"))
           .when(~F.col("Password").eqNullSafe(F.col("Confirm")), F.lit("confirm_mismatch")))
    r = r.withColumn("__pre", pre).withColumn("__k", _text_key("Username", mode))
    valid = r.filter(F.col("__pre").isNull())
    first = valid.groupBy(F.col("__k").alias("__u")).agg(F.min(seq).alias("__first"))
    taken = existing.select(_text_key("Username", mode).alias("__t")).filter(F.col("__t").isNotNull()).distinct()
    r = r.join(first, r["__k"] == first["__u"], "left").drop("__u")
    r = r.join(taken.withColumn("__exists", F.lit(True)),
               r["__k"] == F.col("__t"), "left").drop("__t")
    outcome = (F.when(F.col("__pre").isNotNull(), F.col("__pre"))
               .when(F.col("__exists").isNotNull(), F.lit("duplicate"))
               .when(F.col(seq) != F.col("__first"), F.lit("duplicate"))
               .otherwise(F.lit("ok")))
    return r.select(seq, "Username", "FullName", outcome.alias("outcome"))


def accept_signups(outcomes: DataFrame, requests: DataFrame, table: Table, as_of, after: int,
                   seq: str = "seq", columns: list[str] | None = None) -> DataFrame:
    """The new rows of accepted sign-ups, inactive guest accounts."""
    ok = outcomes.filter(F.col("outcome") == "ok").select(seq)
    rows = (requests.join(ok, seq, "left_semi")
            .select(F.col(seq), strip_ws("Username").alias("Username"),
                    strip_ws("Password").alias("Password"), strip_ws("FullName").alias("FullName"))
            .withColumn("Role", F.lit(SIGNUP_ROLE)).withColumn("Status", F.lit(SIGNUP_STATUS)))
    return append(rows, table, as_of, [seq], after, columns=columns)


def append_activity(entries: DataFrame, table: Table, as_of, order, after: int,
                    columns: list[str] | None = None) -> DataFrame:
    """S15 (batch): new activity rows with LogIDs after ``after``; entries without a time get ``as_of``."""
    return append(entries, table, as_of, order, after, columns=columns)
