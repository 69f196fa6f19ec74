"""State of the runs as plain Parquet folders.

Every run writes its own ``run_id=N`` folder under each table, and its row in
``runs`` last. Readers look only at runs with a row there, so a lost run leaves
nothing visible and writing it again replaces its folders. A run's cost follows
its own rows: vacancies are kept as per-run sightings over a base, folded when
read, and :meth:`RunStore.compact_vacancies` renews the base.

Run ids and versions of the base are claimed by the exclusive create of a file, which
file systems of a cluster and of one machine do in one step (object stores where
conditional writes are switched on). A claim is never given back; ids of lost runs stay unused.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolesift.operators.state import fold_sightings

TABLES = {
    "sources": "source_id string, company_name string, careers_url string, parser_type string, country_hint string, "
    "selectors map<string,string>, enabled boolean, created_at timestamp, updated_at timestamp",
    "sightings": "source_id string, canonical_hash string, external_id string, url string, title string, "
    "location string, description string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp",
    "matches": "source_id string, canonical_hash string, score double, matched_terms array<string>, "
    "geo_pass boolean, decision string, created_at timestamp",
    "notifications": "source_id string, canonical_hash string, channel string, sent_at timestamp, dedupe_until timestamp",
    "runs": "started_at timestamp, finished_at timestamp, status string, sources_total long, jobs_fetched long, "
    "jobs_matched long, jobs_sent long, error_summary string, trigger string",
}
TABLES["vacancy_base"] = TABLES["sightings"] + ", first_run long, last_run long"
TABLES["errors"] = "source_id string, error string"
# the last run a base holds, and earlier ones it does not as they were not published yet
TABLES["bases"] = "upto long, open array<long>"
# runs after which the job renews the base of the vacancies: a day of half hours
COMPACT_EVERY = 48


@dataclass(frozen=True)
class RunStore:
    spark: SparkSession
    root: str

    def _path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _claim(self, name: str, content: str = "") -> bool:
        """Whether the file of this name is ours: created just now, by us alone."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path('claims')}/{name}")
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(target.getParent())
        if files.getUri().getScheme() == "file":
            try:
                with open(target.toUri().getPath(), "x") as out:
                    out.write(content)
            except FileExistsError:
                return False
            return True
        try:
            out = files.create(target, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        out.write(content.encode())
        out.close()
        return True

    def _claimed(self, name: str) -> str:
        path = f"{self._path('claims')}/{name}"
        return self.spark.read.text(path, wholetext=True).first()[0] if self._exists(path) else ""

    def _next(self, kind: str, last: int) -> int:
        """The first number after ``last`` that nobody has claimed."""
        number = last + 1
        while not self._claim(f"{kind}-{number}"):
            number += 1
        return number

    def claim_run(self, trigger: str | None = None) -> int:
        """A run id that no other run has; of a trigger the one it claimed first."""
        if trigger is None:
            return self._next("run", self.last_run() or 0)
        name = "trigger-" + hashlib.sha256(trigger.encode()).hexdigest()
        known = self._claimed(name)
        if not known:
            mine = self._next("run", self.last_run() or 0)
            known = str(mine) if self._claim(name, str(mine)) else self._claimed(name) or str(mine)
        return int(known)

    def _scan(self, table: str) -> DataFrame:
        schema = TABLES[table] + ", run_id long"
        if not self._exists(self._path(table)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema + ", until_day int" if table == "notifications" else schema)
        return rows.parquet(self._path(table)).drop("until_day")

    def runs(self) -> DataFrame:
        return self._scan("runs")

    def last_run(self) -> int | None:
        """Highest published run, read from the partition column alone."""
        return self.runs().agg(F.max("run_id")).first()[0]

    def is_published(self, run_id: int) -> bool:
        return self.runs().filter(F.col("run_id") == run_id).limit(1).count() > 0

    def of_trigger(self, trigger: str) -> DataFrame:
        """The published run that a trigger started, if any."""
        return self.runs().filter(F.col("trigger") == trigger)

    def read(self, table: str) -> DataFrame:
        """Rows of published runs; the run list prunes folders."""
        return self._scan(table).join(self.runs().select("run_id"), "run_id", "left_semi")

    def of_run(self, table: str, run_id: int | None) -> DataFrame:
        """What one run wrote, published or not; its folder alone is read."""
        return self._scan(table).filter(F.col("run_id") == F.lit(run_id)).drop("run_id")

    def sources(self) -> DataFrame:
        """The snapshot of the latest published run."""
        return self.of_run("sources", self.last_run())

    def vacancies(self) -> DataFrame:
        return self._folded().drop("run_id", "first_run")

    def _folded(self) -> DataFrame:
        """Vacancies with the first and the last run that saw each."""
        version, upto, late = self._base()
        rows = self.read("sightings").withColumns({"first_run": F.col("run_id"), "last_run": F.col("run_id")})
        if version:
            since = (F.col("run_id") > upto) | F.col("run_id").isin(late)
            rows = rows.filter(since).drop("run_id").unionByName(self.of_run("vacancy_base", version))
        return fold_sightings(rows, "first_run", "last_run")

    def _base(self) -> tuple[int, int, list[int]]:
        """Version of the published base, the last run it holds and the earlier ones it does not; zeros without one."""
        found = self._scan("bases").agg(F.max(F.struct("run_id", "upto", "open"))).first()[0]
        return (found[0], found[1], found[2] or []) if found else (0, 0, [])

    def compact_vacancies(self, after: int = 1) -> None:
        """Fold all sightings into a new version of the base once ``after`` runs have come since
        the last. A version has a number and folder of its own and counts only when its row is
        there, so a compaction that is lost, repeated or done by two changes nothing. Runs
        with a lower id that are not published yet are noted and read beside the base later."""
        last, (version, upto, _) = self.last_run() or 0, self._base()
        if last - upto >= after:
            every = self.spark.range(1, last + 1).toDF("run_id")
            late = [r[0] for r in every.join(self.runs().select("run_id"), "run_id", "left_anti").collect()]  # few
            # a run published from here on may be in the base and read beside it: folding it twice changes nothing
            mine = self._next("base", version)
            self.write("vacancy_base", mine, self._folded().withColumnRenamed("run_id", "last_run"))
            self.write("bases", mine, self.spark.createDataFrame([(last, late)], TABLES["bases"]))

    def _notice_days(self) -> list[int]:
        """The days, counted from 1970, on which notices end: folders of their own, listed without opening one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("notifications"))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("until_day="))

    def live_notices(self, now: datetime) -> DataFrame:
        """Notices of published runs that end on the day of ``now`` or later; no older folder is opened."""
        root = self._path("notifications")
        today = int(now.timestamp() // 86_400)
        paths = [f"{root}/until_day={d}" for d in self._notice_days() if d >= today]
        schema = TABLES["notifications"] + ", run_id long"
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema + ", until_day int").option("basePath", root).parquet(*paths)
        return rows.drop("until_day").join(self.runs().select("run_id"), "run_id", "left_semi")

    def retire_notices(self, before: datetime) -> None:
        """Delete the notices that ended on a day before that of ``before``; no later run can be held back by them."""
        for day in self._notice_days():
            if day < int(before.timestamp() // 86_400):
                self._delete(f"{self._path('notifications')}/until_day={day}")

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _write_notices(self, run_id: int, rows: DataFrame) -> None:
        """Notices under the days they end. They are written to a folder of the run's own, as writers of one
        folder would clear each other's unfinished files, and each day's part then takes its place."""
        root = self._path("notifications")
        for day in self._notice_days():  # what a lost attempt of this run left, maybe under other days
            self._delete(f"{root}/until_day={day}/run_id={run_id}")
        day = F.floor(F.unix_micros("dedupe_until") / 86_400_000_000).cast("int")
        rows.withColumn("until_day", day).write.mode("overwrite").partitionBy("until_day").parquet(f"{root}/_run-{run_id}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        own = at(f"{root}/_run-{run_id}")
        files = own.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for part in files.listStatus(own):
            name = part.getPath().getName()
            if name.startswith("until_day="):
                files.mkdirs(at(f"{root}/{name}"))
                if not files.rename(part.getPath(), at(f"{root}/{name}/run_id={run_id}")):
                    raise OSError(f"notices of run {run_id} could not be moved to {name}")
        files.delete(own, True)

    def write(self, table: str, run_id: int, rows: DataFrame) -> None:
        columns = StructType.fromDDL(TABLES[table]).fieldNames()
        if table == "notifications":
            self._write_notices(run_id, rows.select(*columns))
        else:
            rows.select(*columns).write.mode("overwrite").parquet(f"{self._path(table)}/run_id={run_id}")
