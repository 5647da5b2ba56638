"""Sources: documents by key, CSV and Excel extracts with change tracking, keyed lookups and enrichment from them."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import keep_last
from ..store import Files
from ..types import source_type


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def normal_name(name: str) -> str:
    """Letters and digits of a column name; whatever else lies between becomes one underscore."""
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def resolve_column(columns: list[str], name: str) -> str:
    """A column by its name, else without case, else by its normal name."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower(), lambda c: normal_name(c) == normal_name(name)):
        found = [c for c in columns if same(c)]
        if found:
            return found[0]
    raise KeyError(f"no column {name}; there are {', '.join(columns)}")


# documents


def read_documents(spark: SparkSession, path: str, root: type, keys: list[str] | None = None) -> DataFrame:
    """JSON documents of a root class, one a file; the key is the file's name without its ending. Broken ones have
    _corrupt_record set."""
    schema = T.StructType([*source_type(root).fields, T.StructField("_corrupt_record", T.StringType())])
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    key = F.regexp_extract(file_path(), r"([^/]+?)(\.json)?$", 1)
    rows = files.select(key.alias("_key"), parsed.alias("_doc")).select("_key", "_doc.*")
    if keys is not None:
        rows = rows.filter(F.col("_key").isin(*keys))
    return with_order(rows)


def file_path() -> Column:
    """Where a row was read, as its path is written: the metadata's is a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def with_order(rows: DataFrame) -> DataFrame:
    """rows with _ord, the key itself, for sources that have no order of their own: whole keys, in order of code points."""
    return rows if "_ord" in rows.columns else rows.withColumn("_ord", F.col("_key"))


def document(spark: SparkSession, path: str, root: type, key: str) -> DataFrame:
    """One document; ValueError if it is missing or broken."""
    found = read_documents(spark, path, root, [key])
    row = found.select("_corrupt_record").first()
    if row is None or row["_corrupt_record"] is not None:
        raise ValueError(f"no readable document {key} in {path}")
    return found.drop("_corrupt_record")


def text_files(spark: SparkSession, path: str, included: tuple[str, ...] = ("*.md",), excluded: tuple[str, ...] = ()) -> DataFrame:
    """filename and content of the files below a folder whose names fit a pattern and none of the excluded ones."""
    like = lambda p: "(^|.*/)" + re.escape(p).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    name = F.regexp_replace(file_path(), r"^file:/*", "/")
    rows = files.select(name.alias("filename"), F.col("value").alias("content"))
    keep = F.lit(False)
    for p in included:
        keep = keep | F.col("filename").rlike(like(p))
    for p in excluded:
        keep = keep & ~F.col("filename").rlike(like(p))
    return rows.filter(keep)


# tables


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV or Excel file as a table; other endings are refused."""
    ending = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if ending == "csv":
        return spark.read.options(**({"header": True, "inferSchema": True, "multiLine": True, "escape": '"'} | options)).csv(path)
    if ending in ("xlsx", "xls"):
        from .workbook import read_workbook

        return read_workbook(spark, path, ending, **options)
    raise ValueError(f"can't read {path}: not a CSV or Excel file")


class TableSource:
    """A staging table that files are imported into, by key, with a ledger of what was imported.

    A file whose checksum is known is skipped; a changed one replaces its own earlier rows. Rows without a key go; of
    rows of one key, within a file and across files, the last imported holds."""

    def __init__(self, spark: SparkSession, path: str, key: str, name: str = "table", mapper: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.key_name, self.name, self.mapper = spark, path.rstrip("/"), key, snake_case(name), mapper
        self.files = Files(spark)

    # storage: a version folder for rows and one for the ledger, named in a pointer file

    def _versions(self) -> dict:
        import json

        pointer = f"{self.path}/{self.name}.json"
        return json.loads(self.files.read(pointer)) if self.files.exists(pointer) else {}

    def _commit(self, rows: DataFrame, ledger: DataFrame) -> None:
        import json
        import uuid

        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{self.name}/{version}")
        ledger.write.parquet(f"{self.path}/imported_files/{version}")
        self.files.write(f"{self.path}/{self.name}.json", json.dumps({"rows": f"{self.name}/{version}", "ledger": f"imported_files/{version}"}))

    def _stored(self) -> DataFrame | None:
        v = self._versions()
        return self.spark.read.parquet(f"{self.path}/{v['rows']}") if v else None

    def ledger(self) -> DataFrame:
        v = self._versions()
        if v:
            return self.spark.read.parquet(f"{self.path}/{v['ledger']}")
        return self.spark.createDataFrame([], "file_path string, checksum string, import_date string, row_count long")

    def rows(self) -> DataFrame:
        """The staging table."""
        stored = self._stored()
        if stored is None:
            raise ValueError(f"nothing was imported into {self.name}")
        return stored.drop("_source_file", "_import")

    @property
    def key(self) -> str:
        return resolve_column(self.rows().columns, self.key_name)

    # import

    def checksum(self, path: str) -> str:
        """SHA-256 of a file, computed where it is read."""
        return self.spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()["h"]

    def changed(self, path: str) -> bool | None:
        """None: a new file; False: the same as before; True: changed."""
        known = self.ledger().filter(F.col("file_path") == path).select("checksum").first()
        return None if known is None else known["checksum"] != self.checksum(path)

    def import_file(self, path: str, **options) -> dict[str, int]:
        """Imports a file unless it is known: rows, skipped (without a key), inserted, updated."""
        if self.changed(path) is False:
            return {"rows": 0, "skipped": 0, "inserted": 0, "updated": 0}
        read = load_table(self.spark, path, **options)
        return self.import_rows(read, path, self.checksum(path))

    def import_rows(self, read: DataFrame, path: str, checksum: str = "") -> dict[str, int]:
        key = resolve_column(read.columns, self.key_name)
        ledger = self.ledger()
        number = ledger.agg(F.count(F.lit(1)).alias("n")).first()["n"] + 1
        last = self._stored().agg(F.max("_import").alias("m")).first()["m"] if self._versions() else None
        number = max(number, (last or 0) + 1)
        numbered = read.withColumn("_row", F.monotonically_increasing_id())
        new = keep_last(numbered, key, "_row").drop("_row").withColumn("_source_file", F.lit(path)).withColumn("_import", F.lit(number).cast("long"))
        total, without = read.count(), read.filter(F.col(key).isNull()).count()
        stored = self._stored()
        before = stored.filter(F.col("_source_file") != path) if stored is not None else None
        n_new = new.count()
        n_met = new.join(before.select(F.col(key)), key, "left_semi").count() if before is not None else 0
        both = keep_last(before.unionByName(new, allowMissingColumns=True), key, "_import") if before is not None else new
        entry = self.spark.createDataFrame([(path, checksum, datetime.now(UTC).isoformat(), n_new)], ledger.schema)
        self._commit(both, ledger.filter(F.col("file_path") != path).unionByName(entry))
        return {"rows": total, "skipped": without, "inserted": n_new - n_met, "updated": n_met}

    def delete_file(self, path: str) -> None:
        stored = self._stored()
        if stored is not None:
            self._commit(stored.filter(F.col("_source_file") != path), self.ledger().filter(F.col("file_path") != path))

    # lookups

    def all_keys(self) -> DataFrame:
        """Distinct keys as text, ascending."""
        return distinct_keys(self.rows(), self.key)

    def by_key(self, value) -> DataFrame:
        return self.by_field(self.key, value)

    def by_field(self, name: str, value) -> DataFrame:
        """The first row, by key, whose column has a value."""
        return self.mapped(lookup(self.rows(), self.key, resolve_column(self.rows().columns, name), value))

    def mapped(self, rows: DataFrame) -> DataFrame:
        return self.mapper(rows) if self.mapper else rows

    def documents(self, keys: list[str] | None = None) -> DataFrame:
        """Mapped rows with _key, the key as text, and _ord, its place in the order of keys."""
        key, rows = self.key, self.rows()
        if keys is not None:
            rows = rows.filter(F.col(key).cast("string").isin(*keys))
        rows = self.mapped(rows.withColumn("_key", F.col(key).cast("string")))
        return with_order(rows)


def distinct_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).select(F.col(key)).distinct().orderBy(key).select(F.col(key).cast("string").alias("key"))


def lookup(rows: DataFrame, key: str, column: str, value) -> DataFrame:
    return rows.filter(F.col(column) == F.lit(value)).orderBy(F.col(key).asc_nulls_last()).limit(1)


# enrichment


def parse_pull(spec: str, labels: list[str]) -> tuple[str, str] | None:
    """("Label", "field") of "label.field", the label in any case; None if there is no such label."""
    if spec.count(".") != 1:
        return None
    label, name = spec.split(".")
    found = next((x for x in labels if x.lower() == label.lower()), None)
    return (found, name) if found and name else None


def pull(nodes: DataFrame, field: str, table: DataFrame, column: str, key: str) -> DataFrame:
    """Rows of a table that nodes ask for by a field's value: the first by key for each distinct value; _value says which."""
    values = nodes.select(F.col(field).cast("string").alias("_value")).filter(F.col("_value").isNotNull() & (F.col("_value") != "")).distinct()
    rest = [c for c in table.columns if c != column]
    first = table.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min_by(F.struct(*rest), F.struct(F.col(key).isNull(), F.col(key))).alias("_row"))
    first = first.select(F.col(column).cast("string").alias("_value"), F.col(column), *[F.col("_row")[c].alias(c) for c in rest])
    return values.join(first, "_value")


def json_map(text: Column) -> Column:
    """A JSON object's values as text; an empty map for anything else."""
    return F.coalesce(F.from_json(text, T.MapType(T.StringType(), T.StringType())), F.create_map().cast("map<string,string>"))
