"""Where the datamart tables live: a folder of parquet tables, or a database."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsward.operators.datamart import Load, build_load, max_id
from newsward.operators.records import RECORD_COLUMNS
from newsward.session import stage

# Table names and columns.
DETAILS = "d_media_monitor_details"
COUNTRIES = "d_countries"
COMPANIES = "d_company_details"
INCIDENT_THEMES = "d_incidents_themes"
INCIDENT_COUNTRIES = "d_incidents_countries"
SCHEMAS = {
    DETAILS: "id bigint, " + ", ".join(f"{name} string" for name in RECORD_COLUMNS),
    COUNTRIES: "id bigint, country string",
    COMPANIES: "company_id string",
    INCIDENT_THEMES: "incident_id bigint, theme_id int",
    INCIDENT_COUNTRIES: "incident_id bigint, country_id bigint",
}


# A load finds its number taken at most so often before it gives up.
TRIES = 10
LOADS = "_loads"
LOAD = "seq bigint, load_id string, attempt string"


class LoadConflict(Exception):
    """Other loads were committed in the meantime, more often than a load tries."""


@dataclass
class Snapshot:
    """The committed loads as they were at one time: their attempts by load, and the last number."""

    attempts: dict[str, str]
    last: int


class ParquetMart:
    """A folder of tables that change as one: a load writes its rows beside the others' and
    becomes visible with one file, its manifest, written last.

    Readers see committed loads only, so a load that fails between any two writes leaves
    nothing to be seen. Manifests are numbered; a load may only take the number
    after the last one it has read. Of two loads at a time the second to commit finds its number taken, and
    works out its ids again from what the first has brought.

    A load that is run again, even after other loads, takes the place of its earlier attempt. It keeps the
    countries it brought and their ids, and its detail ids if it has as many records as
    before; with another number it gets new ids behind all others. No dimension row is renumbered or lost.
    Rows of attempts that never committed stay on disk, unread.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def snapshot(self) -> Snapshot:
        """One small row per load that was ever committed."""
        try:
            rows = self.spark.read.schema(LOAD).json(f"{self.root}/{LOADS}").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        rows.sort(key=lambda row: row["seq"])
        return Snapshot({row["load_id"]: row["attempt"] for row in rows}, rows[-1]["seq"] if rows else 0)

    def read(self, table: str, only_load: str | None = None, at: Snapshot | None = None) -> DataFrame:
        """The rows of the committed loads, or of one of them, as of now or of a snapshot."""
        attempts = (at or self.snapshot()).attempts
        seen = [a for load, a in attempts.items() if only_load in (None, load)]
        schema = SCHEMAS[table]
        try:
            stored = self.spark.read.schema(f"{schema}, attempt string").parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return stored.where(F.col("attempt").isin(seen)).drop("attempt")

    def write(self, table: str, rows: DataFrame, attempt: str) -> None:
        columns = [field.split(" ")[0] for field in SCHEMAS[table].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/{table}/attempt={attempt}")

    def commit(self, load_id: str, attempt: str, at: Snapshot) -> bool:
        """Make an attempt visible, unless another load was committed since ``at``."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs, content = jvm.org.apache.hadoop.fs, json.dumps({"seq": at.last + 1, "load_id": load_id, "attempt": attempt})
        final = fs.Path(f"{self.root}/{LOADS}/{at.last + 1:012d}.json")
        # Names with a leading dot are not read. The file is whole before it gets its name,
        # and a name that is taken is refused.
        hidden = fs.Path(f"{self.root}/{LOADS}/.{attempt}")
        files = final.getFileSystem(conf)
        out = files.create(hidden, True)
        out.write(bytearray(content.encode()))
        out.close()
        context = fs.FileContext.getFileContext(files.makeQualified(final).toUri(), conf)
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(hidden), files.makeQualified(final), plain)
        except Py4JJavaError as error:
            if not isinstance_of(error, "FileAlreadyExistsException"):
                raise
            files.delete(hidden, False)
            return False
        return True


def isinstance_of(error: Py4JJavaError, name: str) -> bool:
    return error.java_exception.getClass().getName().endswith(name)


class JdbcMart:
    """The same tables in a database. Connection options come from the caller's job.

    Loads are not told apart here: a load that is run again appends its rows again, so
    the caller must delete what a failed load has written first. Untested.
    """

    def __init__(self, spark: SparkSession, options: dict[str, str]):
        self.spark = spark
        self.options = {"batchsize": "10000", **options}

    def snapshot(self) -> Snapshot:
        return Snapshot({}, 0)

    def commit(self, load_id: str, attempt: str, at: Snapshot) -> bool:
        return True

    def read(self, table: str, only_load: str | None = None, at: Snapshot | None = None) -> DataFrame:
        if only_load is not None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.format("jdbc").options(**self.options, dbtable=table).load()

    def write(self, table: str, rows: DataFrame, attempt: str) -> None:
        writer = rows.write.format("jdbc").options(**self.options, dbtable=table)
        writer.mode("append").save()


def load_datamart(
    mart: ParquetMart | JdbcMart,
    records: DataFrame,
    order_by: list[str],
    load_id: str,
    bridges: bool = True,
) -> Load:
    """Append the records, the new countries and the bridge rows, all or nothing. The records are
    staged, as they are counted, sorted and written, so that each is classified once. If another load commits
    first, the ids are worked out again, at most ``TRIES`` times."""
    records = stage(records)
    for _ in range(TRIES):
        at, attempt = mart.snapshot(), uuid.uuid4().hex
        load = _write_attempt(mart, records, order_by, load_id, bridges, at, attempt)
        if mart.commit(load_id, attempt, at):
            return load
    raise LoadConflict(f"load {load_id} found other loads committed {TRIES} times")


def _write_attempt(mart, records: DataFrame, order_by: list[str], load_id: str, bridges: bool, at: Snapshot, attempt: str) -> Load:
    own = mart.read(DETAILS, load_id, at).agg(F.count("*"), F.min("id")).first()
    again = own[0] > 0 and own[0] == records.count()
    last = own[1] - 1 if again else max_id(mart.read(DETAILS, at=at))
    load = build_load(records, stage(mart.read(COUNTRIES, at=at)), order_by, last, bridges)
    if bridges:
        # What this load brought before stays, under its ids.
        brought = mart.read(COUNTRIES, load_id, at).unionByName(load.countries.select("id", "country"))
        mart.write(COUNTRIES, brought, attempt)
    mart.write(DETAILS, load.details.select("id", *RECORD_COLUMNS), attempt)
    if bridges:
        mart.write(INCIDENT_THEMES, load.incident_themes, attempt)
        mart.write(INCIDENT_COUNTRIES, load.incident_countries, attempt)
    return load
