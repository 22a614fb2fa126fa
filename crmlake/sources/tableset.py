"""Table providers for real deployments.

The reports take any object whose attributes are the tables (``employees``,
``customers``, ...). ``TableSet`` builds one from stored tables, conformed to
the contracts, either from files (one folder per table, any Spark file
format) or from the live relational database over JDBC. For JDBC, a table
with a numeric key is read as ``num_partitions`` parallel key-range queries
(bounds from one ``MIN/MAX`` query), so no single connection carries a
whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crmlake.sources import schemas as S
from crmlake.sources.readers import scan, scan_jdbc
from crmlake.sources.sinks import KeyMarks, append_keyed

# attribute name -> contract (CRM and training-centre databases)
CRM_TABLES = {
    "employees": S.EMPLOYEES, "customers": S.CUSTOMERS, "products": S.PRODUCTS,
    "opportunities": S.OPPORTUNITIES, "interactions": S.INTERACTIONS,
    "tickets": S.SUPPORT_TICKETS, "users": S.USERS, "activity": S.ACTIVITY_LOG,
}
EDU_TABLES = {
    "staff": S.STAFF, "courses": S.COURSES, "classes": S.CLASSES, "students": S.STUDENTS,
    "enrollments": S.ENROLLMENTS, "payments": S.PAYMENTS, "consultations": S.CONSULTATIONS,
    "feedbacks": S.FEEDBACKS, "edu_users": S.EDU_USERS, "edu_activity": S.EDU_ACTIVITY_LOG,
}
# table names in the reference's databases
DB_NAMES = {"ActivityLog": "ActivityLog", "EduActivityLog": "ActivityLog", "EduUsers": "Users"}


class TableSet:
    """Lazily opened, contract-conformed tables."""

    def __init__(self, spark: SparkSession, opener, tables: dict[str, S.Table], root: str | None = None):
        self.spark = spark
        self._root = root
        self._opener = opener
        self._tables = tables
        self._open: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        if name not in self._open:
            self._open[name] = self._opener(self._tables[name])
        return self._open[name]

    def view(self, name: str) -> DataFrame:
        return getattr(self, name)

    @classmethod
    def files(cls, spark: SparkSession, root: str, fmt: str = "parquet",
              tables: dict[str, S.Table] | None = None) -> "TableSet":
        """``<root>/<ContractName>`` folders (e.g. ``.../Customers``)."""
        root = root.rstrip("/")
        return cls(spark, lambda t: scan(spark, f"{root}/{t.name}", t, fmt),
                   tables or {**CRM_TABLES, **EDU_TABLES}, root if fmt == "parquet" else None)

    def _marks(self) -> KeyMarks:
        if self._root is None:
            raise ValueError("appends need a TableSet over Parquet folders")
        return KeyMarks(self.spark, f"{self._root}/_key_marks")

    def after(self, name: str, key: str) -> int:
        """Where new keys of table ``name`` begin (its recorded mark)."""
        return self._marks().after(self._tables[name].name, getattr(self, name), key)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add new rows (with keys) to a stored table and record its mark."""
        table = self._tables[name]
        append_keyed(rows, f"{self._root}/{table.name}", table.name, table.key, self._marks())
        self._open.pop(name, None)

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, properties: dict, num_partitions: int = 16,
             tables: dict[str, S.Table] | None = None) -> "TableSet":
        """The live database (e.g. ``jdbc:mysql://host/crm_db``)."""
        def open_table(t: S.Table) -> DataFrame:
            name = DB_NAMES.get(t.name, t.name)
            bounds = scan_jdbc(spark, url, f"(SELECT MIN({t.key}) AS lo, MAX({t.key}) AS hi FROM {name}) b",
                               properties).first()
            if bounds is None or bounds["lo"] is None:
                return scan_jdbc(spark, url, name, properties, table=t)
            return scan_jdbc(spark, url, name, properties, partition_column=t.key,
                             lower=int(bounds["lo"]), upper=int(bounds["hi"]) + 1,
                             num_partitions=num_partitions, table=t)
        return cls(spark, open_table, tables or CRM_TABLES)
