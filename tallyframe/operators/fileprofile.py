"""Profiles that are kept up file by file: only files that changed are read again.

Of every file the counts of its distinct values are kept, which add up exactly: two files'
counts together are those of both. All facts of a profile follow from the counts. A refresh
compares the files' sizes and times with those recorded, reads the files that differ, and
takes up the new counts with one rename; a failed refresh leaves the former ones.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe import session
from tallyframe.functions import kinds
from tallyframe.functions.text import number_sql, strip_sql
from tallyframe.operators.ordered import running_sums
from tallyframe.operators.profile import COLUMN_SCHEMA, LONG_TEXT, SAMPLE_VALUES, with_rules
from tallyframe.operators.quartiles import between, wanted_ranks
from tallyframe.session import pin, small_frame, small_tasks
from tallyframe.sources.files import fingerprint
from tallyframe.sources.versions import Versions

MANIFEST = "path string, print string, folder string, n_rows bigint"
ROWS = -1  # the position under which a file's rows are counted
_VALUE = ["whole", "number", "text", "digest", "marks"]


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: files read, kept as they were, and no longer there."""

    read: list[str]
    kept: list[str]
    gone: list[str]


class FileProfiles:
    """The profile of a folder of Parquet files of one schema, kept under ``store``, which all executors see."""

    def __init__(self, spark: SparkSession, dataset: str, store: str):
        self.spark, self.dataset, self.versions = spark, dataset, Versions(spark, store)

    # --- keeping the counts -----------------------------------------------------

    def _manifest(self) -> DataFrame:
        name = self.versions.current()
        if name is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.versions.path}/manifests/{name}")

    def _files(self) -> DataFrame:
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.dataset)
        return listed.select(F.col("_metadata.file_path").alias("path"),
                             fingerprint(F.col("length"), F.col("modificationTime")).alias("now"))

    def _size(self) -> int:
        """Bytes of all files together."""
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.dataset)
        return listed.agg(F.sum("length")).first()[0] or 0

    def stale(self) -> DataFrame:
        """``path, state``: files that are ``new``, ``changed`` or ``gone`` since the last refresh. Reads no data."""
        return self._manifest().join(self._files(), "path", "full").select("path", F.when(F.col("now").isNull(), "gone").when(
            F.col("print").isNull(), "new").when(F.col("print") != F.col("now"), "changed").alias("state")).where("state IS NOT NULL")

    def refresh(self) -> Refresh:
        """Read the files that are new or changed, and forget those that are gone."""
        now = {r.path: r.now for r in self._files().collect()}  # a row per file
        known = {r.path: r for r in self._manifest().collect()}
        read = sorted(p for p, mark in now.items() if p not in known or known[p]["print"] != mark)
        kept = sorted(set(now) - set(read))
        gone = sorted(set(known) - set(now))
        if read or gone:
            rows = [tuple(known[p]) for p in kept] + (self._count(read, now) if read else [])
            manifest = uuid.uuid4().hex
            small_frame(self.spark, rows, MANIFEST).coalesce(1).write.parquet(f"{self.versions.path}/manifests/{manifest}")
            self.versions.use(manifest)
            used = {r[2].split("/")[0] for r in rows}
            for old in set(self.versions.by_age("manifests")) - {manifest}:
                self.versions.remove("manifests", old)
            for old in set(self.versions.by_age("counts")) - used:
                self.versions.remove("counts", old)
        return Refresh(read, kept, gone)

    def changed_rows(self, paths: list[str]) -> DataFrame:
        """The rows of some files, columns by position, and the file of each."""
        frame = self.spark.read.parquet(*paths)
        names = [f"c{i}" for i in range(len(frame.columns))]
        return frame.select(*[frame[f"`{c}`"].alias(n) for c, n in zip(frame.columns, names)],
                            F.md5(F.col("_metadata.file_path")).alias("file"))

    def _count(self, paths: list[str], prints: dict[str, str]) -> list[tuple]:
        """Write the value counts of some files, each file's in a folder of its own; their manifest rows."""
        size, fields = self._size(), self.schema().fields
        rows = spread(self.changed_rows(paths), size)
        cells = [F.struct(F.lit(i).alias("pos"), *_slots(f"c{i}", f.dataType)) for i, f in enumerate(fields)]
        cells.append(F.struct(F.lit(ROWS).alias("pos"), *_slots("true", None)))
        each = rows.select("file", F.inline(F.array(*cells)))
        present = (F.col("pos") == ROWS) | F.coalesce(F.col("whole").isNotNull() | F.col("number").isNotNull() | F.col("text").isNotNull(), F.lit(False))
        counts = each.where(present).groupBy("file", "pos", *_VALUE).agg(F.count("*").alias("n"))
        version = uuid.uuid4().hex
        with small_tasks(self.spark, size):
            counts.write.partitionBy("file").parquet(f"{self.versions.path}/counts/{version}")
        written = self.spark.read.schema("pos int, n bigint, file string").parquet(f"{self.versions.path}/counts/{version}")
        sizes = {r.file: r.n for r in written.where(F.col("pos") == ROWS).collect()}
        named = {r.path: r.file for r in small_frame(self.spark, [(p,) for p in paths], "path string").select(
            "path", F.md5("path").alias("file")).collect()}
        # a file without rows has no folder
        return [(p, prints[p], f"{version}/file={named[p]}", sizes.get(named[p], 0)) for p in paths]

    def schema(self):
        return self.spark.read.parquet(self.dataset).schema

    # --- reading them -----------------------------------------------------------

    def counts(self) -> DataFrame:
        """The counts of all files together: ``pos``, the value in one of four slots, ``n``."""
        folders = [f"{self.versions.path}/counts/{r.folder}" for r in self._manifest().where("n_rows > 0").collect()]
        schema = "pos int, whole bigint, number double, text string, digest binary, marks int, n bigint"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders).groupBy("pos", *_VALUE).agg(F.sum("n").alias("n"))

    def profile(self, sample_values: int = SAMPLE_VALUES) -> DataFrame:
        """The profile of all files, as ``profile`` gives it, from the counts alone.

        Long texts among samples and modal values are looked up in the files, by digest.
        """
        with small_tasks(self.spark, self._size()):
            return self._profile(sample_values)

    def _profile(self, sample_values: int) -> DataFrame:
        fields, counts = self.schema().fields, pin(self.counts())
        value = F.coalesce(F.col("whole").cast("double"), "number")
        at = counts.where(F.col("pos") >= 0)
        mean = at.groupBy("pos").agg((F.sum(value * F.col("n")) / F.sum("n")).alias("mean"))
        least = F.struct("whole", "number", "text", "digest")
        marks = F.coalesce("marks", F.expr(_marks("text")))
        facts = at.join(F.broadcast(mean), "pos").groupBy("pos").agg(
            F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.first("mean").alias("mean"),
            F.coalesce(F.min("whole").cast("string"), F.min("number").cast("string")).alias("low"),
            F.coalesce(F.max("whole").cast("string"), F.max("number").cast("string")).alias("high"),
            F.sqrt(F.sum(F.col("n") * F.pow(value - F.col("mean"), 2)) / F.when(F.sum("n") > 1, F.sum("n") - 1)).alias("std"),
            F.min(F.struct((-F.col("n")).alias("neg"), *_VALUE[:4])).alias("top"),
            F.sum(F.when(marks.isin(1, 3), F.col("n"))).alias("spaced"), F.sum(F.when(marks >= 2, F.col("n"))).alias("numeric"))
        found = {r.pos: r for r in facts.collect()}  # a row per column, as all that follows
        n_rows = counts.where(F.col("pos") == ROWS).agg(F.sum("n")).first()[0] or 0
        order = F.expr("row_number() OVER (PARTITION BY pos ORDER BY whole, number, text NULLS FIRST, digest NULLS FIRST)")
        smallest: dict[int, list] = {}
        for r in at.withColumn("place", order).where(F.col("place") <= sample_values).select(
                "pos", "place", least.alias("v"), _shown().alias("shown")).orderBy("pos", "place").collect():
            smallest.setdefault(r.pos, []).append(r)
        quartiles = self._quartiles(at, {i: found[i].n for i, f in enumerate(fields) if i in found and kinds.kind_of(f.dataType) in kinds.RANGED})
        rows = []
        for i, field in enumerate(fields):
            kind, f = kinds.kind_of(field.dataType), found.get(i)
            ranged = kind in kinds.RANGED
            modal = f is not None and not ranged and kind != kinds.BOOLEAN
            ends = (None, None) if not f or not ranged else (f.low, f.high)
            rows.append((
                i, field.name, field.dataType.simpleString(), kind, n_rows, f.n if f else 0, f.n_distinct if f else 0,
                [self._whole(i, r.shown, r.v.digest) for r in smallest.get(i, [])], *ends,
                f.mean if f and ranged else None, f.std if f and ranged else None, *(quartiles.get(i) or [None] * 3),
                self._whole(i, f.top.text, f.top.digest) if modal else None, -f.top.neg if modal else None,
                (f.spaced or 0) if f and kind == kinds.STRING else 0, (f.numeric or 0) if f and kind == kinds.STRING else 0))
        return with_rules(small_frame(self.spark, rows, COLUMN_SCHEMA))

    def _quartiles(self, at: DataFrame, sizes: dict[int, int]) -> dict[int, list[float]]:
        """Read off the running sums of the counts, at the few places that are wanted."""
        wanted = [(i, rank) for i, n in sizes.items() for low, high, _ in wanted_ranks(n) for rank in {low, high}]
        if not wanted:
            return {}
        numbers = at.select("pos", F.coalesce(F.col("whole").cast("double"), "number").alias("v"), "n").where("v IS NOT NULL")
        grouped = numbers.groupBy("pos", "v").agg(F.sum("n").alias("n"))
        run = running_sums(grouped, ["pos"], ["v"], {"upto": "n"})
        places = small_frame(self.spark, wanted, "col int, rank bigint")
        hit = run.join(F.broadcast(places), (F.col("pos") == F.col("col")) & (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        value = {(r.pos, r.rank): r.v for r in hit.select("pos", "rank", "v").collect()}
        return {i: [between(value[i, low], value[i, high], w) for low, high, w in wanted_ranks(n)] for i, n in sizes.items()}

    def _whole(self, i: int, text, digest) -> str | None:
        """A text that was kept as its beginning and digest, looked up in the files."""
        if digest is None:
            return text
        table = self.spark.read.parquet(self.dataset)
        field = table.schema.fields[i]
        texts = table.select(kinds.as_text(table[f"`{field.name}`"], field.dataType).alias("t"))
        return texts.where((F.left("t", F.lit(LONG_TEXT)) == text) & (F.unhex(F.sha2("t", 256)) == F.lit(bytes(digest)))).first()[0]


def spread(rows: DataFrame, size: int) -> DataFrame:
    """The rows of files of ``size`` bytes, dealt so that no task counts a whole large row group."""
    tasks = -(-size // session.TASK_BYTES)
    if tasks < 2:
        return rows
    return rows.withColumn("__place", F.monotonically_increasing_id()).repartition(tasks, "__place").drop("__place")


def _slots(name: str, dtype) -> list:
    """A value in the slot of its kind; long text as its beginning, digest and marks."""
    kind = kinds.kind_of(dtype) if dtype is not None else None
    none = lambda t: F.lit(None).cast(t)
    whole = F.col(name).cast("bigint") if kind == kinds.INTEGER else none("bigint")
    number = F.col(name).cast("double") if kind == kinds.FLOAT else none("double")
    text = digest = marks = None
    if kind not in (None, kinds.INTEGER, kinds.FLOAT):
        value = kinds.text_sql(name, dtype)
        long = f"length({value}) > {LONG_TEXT}"
        text = F.expr(f"CASE WHEN {long} THEN left({value}, {LONG_TEXT}) ELSE {value} END")
        if kind in (kinds.STRING, kinds.OTHER):
            digest = F.expr(f"CASE WHEN {long} THEN unhex(sha2({value}, 256)) END")
            marks = F.expr(f"CASE WHEN {long} THEN {_marks(value)} END")
    return [whole.alias("whole"), number.alias("number"), (none("string") if text is None else text).alias("text"),
            (none("binary") if digest is None else digest).alias("digest"), (none("int") if marks is None else marks).alias("marks")]


def _marks(x: str) -> str:
    """1 where spaces surround the text, plus 2 where it reads as a number."""
    return (f"(CASE WHEN {x} <> {strip_sql(x)} THEN 1 ELSE 0 END + CASE WHEN {number_sql(x)} IS NOT NULL THEN 2 ELSE 0 END)")


def _shown():
    return F.coalesce(F.col("whole").cast("string"), F.col("number").cast("string"), "text")
