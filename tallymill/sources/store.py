"""Layer tables as immutable Parquet parts, and the commit that makes new ones current.

A table is the union of its parts. A load writes new parts to fresh folders, then appends one small Parquet file
to the commit log, which names the parts added and removed. Readers follow the log, so they see all of a load's
tables or none. The log has one writer at a time.

Values of single rows change without a rewrite: a change file has the generated key of each such row and its new values
(schemas.CHANGEABLE), and readers put the newest ones in place of the row's own. Change files are parts as well, so they
become visible with the rest of a commit. Rows that are rewritten take their changes in, and these leave the change files.

The log keeps the number of rows of every part and the range of one column, so counts and the search for parts need no
scan of the table. Summaries (operators/summaries.py) are kept per part, too, written right after it: those of all current
parts, and of what change files moved, add up to those of the table. Parts are merged by size, see `Store.compact`.
"""

from __future__ import annotations

import functools
import math
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .. import schemas
from ..operators.summaries import BITS_DDL, BITS_OF, COUNTED_KEYS, REQUIRED, SUMMARIES, SUMMARISED, row_bits
from .literals import literal_rows
from .seeds import seed_categories, seed_unknown_members

_LOG = "commitId long, tableName string, part string, path string, lastKey long, rowCount long, low string, high string"
# Packs hashes and other texts that hold no repeats, too, and reads as fast. The lowest level takes half the time of the
# default one, for files of the same size.
CODEC = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
# Parts of a size that are merged into one of the next, and rows from which a part stays as it is.
FAN, FULL_ROWS = 8, 200_000_000
# Change files are folded into the rows when they have more than this share of a table's rows.
FOLD_SHARE = 1 / 16
# From this many changes only rows that may be changed are moved to meet them, told by a bitmap of the keys' places. It has
# a bit for each key ever given out, and is not used for tables of more.
MANY_CHANGES, MARKED_KEYS = 200_000, 1 << 30


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="tallymill-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local one only where none is set and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or _local_scratch()).rstrip("/")


_SCRATCH = "tallymill.scratch"


@contextmanager
def temporary(spark: SparkSession):
    """What is materialised inside is deleted at the end, that of an inner block with its outermost one.

    The folder's name is a local property of the thread, which threads started with inheritable_thread_target take over.
    """
    context = spark.sparkContext
    if context.getLocalProperty(_SCRATCH):
        yield
        return
    name = f"scratch-{uuid.uuid4().hex}"
    context.setLocalProperty(_SCRATCH, name)
    try:
        yield
    finally:
        context.setLocalProperty(_SCRATCH, None)
        path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back: cuts lineage, survives lost executors.

    Inside of `temporary` it lasts as long as that, unless it is to be kept.
    """
    spark = df.sparkSession
    scratch = None if keep else spark.sparkContext.getLocalProperty(_SCRATCH)
    path = "/".join(filter(None, [shared_folder(spark), scratch, f"{what}-{uuid.uuid4().hex}"]))
    df.write.options(**CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def changes_of(table: str) -> str:
    """Name under which the log lists a table's change files."""
    return f"{table}.changes"


def summaries_of(table: str) -> list[str]:
    """Names under which the log lists what is kept about the table's parts, and what its change files moved."""
    sums = [f"{table}.{name}" for name in SUMMARIES] if table in schemas.CHANGEABLE else []
    return sums + [f"{name}.moved" for name in sums] + [f"{table}.bits"] * (table in BITS_OF)


def ddl_of(table: str) -> str:
    """Columns of a table, of its change files, or of a summary."""
    base, _, changes = table.partition(".")
    if not changes:
        return schemas.TABLES[table]
    if changes == "bits":
        return BITS_DDL
    if changes != "changes":
        return SUMMARIES[changes.removesuffix(".moved")].ddl
    kinds = {field.split()[0]: field for field in schemas.TABLES[base].split(", ")}
    return ", ".join([kinds[schemas.GENERATED_KEYS[base]], "changeNumber long", *[kinds[c] for c in schemas.CHANGEABLE[base]]])


def overlaid(table: str, rows: DataFrame, changes: DataFrame | None, many: bool = False) -> DataFrame:
    """Rows with the newest changed values in place of their own. With `many` changes the other rows are not moved."""
    if changes is None:
        return rows
    key = schemas.GENERATED_KEYS[table]
    newest = _newest(table, changes)

    def laid_over(rows: DataFrame) -> DataFrame:
        return _with_new(table, rows.join(newest, key, "left"))

    if not many:
        return laid_over(rows)
    told, columns = marked(rows, changes, key), rows.columns
    return told.filter(~F.col("_marked")).select(columns).unionByName(laid_over(told.filter("_marked").select(columns)))


def _newest(table: str, changes: DataFrame) -> DataFrame:
    """Per key its newest values, as `_new`."""
    values = F.struct(*schemas.CHANGEABLE[table])
    return changes.groupBy(schemas.GENERATED_KEYS[table]).agg(F.max_by(values, F.col("changeNumber")).alias("_new"))


def _with_new(table: str, both: DataFrame) -> DataFrame:
    """Rows with the values of `_new`, if there are any, in place of their own."""
    return both.select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in schemas.CHANGEABLE[table] else F.col(c)
        for c in both.columns if c != "_new"
    ])


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows with `_marked`: whether `keys` has their key, or another one less than a step away. Rows are not moved: the
    bitmaps of the keys' places, 32,768 to a bitmap, are sent to all of them."""
    place = F.floor(F.col(key) / schemas.KEY_STEP)
    bucket, position = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    bits = keys.select(bucket.alias("_bucket"), position.alias("_p")).filter("_bucket IS NOT NULL").groupBy("_bucket").agg(
        F.bitmap_construct_agg("_p").alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, F.pmod(position, F.lit(8)).cast("int")) == 1
    both = rows.withColumn("_bucket", bucket).join(F.broadcast(bits), "_bucket", "left")
    return both.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias("_marked"))


def many_changes(changes: int, last_key: int) -> bool:
    return changes >= MANY_CHANGES and last_key <= MARKED_KEYS * schemas.KEY_STEP


def range_text(c: Column, kind: str) -> Column:
    """A value as the log keeps it: text in the order of the values."""
    return F.lpad(c.cast("string"), 20, "0") if kind == "bigint" else c.cast("string")


class Tables(dict):
    """Tables by name, with what the store knows about them. As a plain dictionary, or with other tables put in, nothing is
    known, and everything is counted from the rows."""

    def __init__(self, rows: dict[str, DataFrame], sums: dict[str, DataFrame], bits: dict[str, DataFrame], counts: dict[str, int]):
        super().__init__(rows)
        self.sums, self.bits, self.counts = sums, bits, counts


def _tables(spark: SparkSession, paths: Callable[[str], dict[str, str]], rows: Callable[[str], DataFrame], counts: dict[str, int]) -> Tables:
    """`paths`: current parts by name. Summaries are used where every part of the table has one."""
    def read(name: str) -> DataFrame | None:
        found = list(paths(name).values())
        return spark.read.schema(ddl_of(name)).parquet(*found) if found else None

    def complete(table: str, name: str) -> bool:
        return bool(paths(table)) and set(paths(table)) == set(paths(name))

    sums: dict[str, DataFrame] = {}
    if all(complete("factTransaction", f"factTransaction.{name}") for name in SUMMARIES):
        for name, summary in SUMMARIES.items():
            parts, moved = read(f"factTransaction.{name}"), read(f"factTransaction.{name}.moved")
            # Rows that went elsewhere leave a sum of none behind.
            sums[name] = summary.added(parts if moved is None else parts.unionByName(moved)).filter("n <> 0")
    bits = {table: read(f"{table}.bits") for table in BITS_OF if complete(table, f"{table}.bits")}
    return Tables({table: rows(table) for table in schemas.TABLES}, sums, bits, counts)


class Store:
    """Current rows of all tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._seen: tuple[list, dict[str, int]] | None = None

    def _file(self, name: str):
        """A path below the root and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> DataFrame | None:
        path, system = self._file("commits")
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/commits") if system.exists(path) else None

    def _entries(self) -> tuple[list, dict[str, int]]:
        """The log's entries of the parts that are current, oldest first, and the last key of each table. What was replaced
        stays in the log and is not collected."""
        if self._seen is None:
            log = self._log()
            if log is None:
                self._seen = [], {}
            else:
                entry = F.struct("path", "rowCount", "low", "high", "commitId")
                newest = log.groupBy("tableName", "part").agg(F.max_by(entry, F.col("commitId")).alias("e"))
                keys = log.groupBy("tableName").agg(F.max("lastKey").alias("lastKey")).collect()
                current = newest.filter("e.path IS NOT NULL").select("tableName", "part", "e.*").collect()
                current.sort(key=lambda e: (e.commitId, e.part))
                self._seen = current, {k.tableName: k.lastKey or 0 for k in keys}
        return self._seen

    def last_commit(self) -> int:
        """Number of the newest commit in the log."""
        log = self._log()
        return (log.agg(F.max("commitId")).first()[0] or 0) if log is not None else 0

    def claim(self, number: int) -> None:
        """Take a commit number: its empty file is created, and must not be there yet."""
        path, system = self._file(f"claims/{number}")
        try:
            system.create(path, False).close()
        except Py4JJavaError as problem:
            if system.exists(path):
                raise RuntimeError(
                    f"commit {number} was made by another writer; start again from its tables (or remove {path}, "
                    "if that writer died before its log entry)") from problem
            raise

    def refresh(self) -> "Store":
        """Look at the commit log again, to see what another session has committed."""
        self._seen = None
        return self

    def parts(self, table: str) -> dict[str, str]:
        return {e.part: e.path for e in self._entries()[0] if e.tableName == table}

    def last_key(self, table: str) -> int:
        """Last surrogate key ever given out, from the log instead of a scan."""
        return self._entries()[1].get(table, 0)

    def sizes(self, table: str) -> dict[str, int | None]:
        """Rows of each current part, from the log; None for parts of logs that don't have it."""
        return {e.part: e.rowCount for e in self._entries()[0] if e.tableName == table}

    def row_count(self, table: str) -> int | None:
        """Rows of the table, from the log; None where it doesn't tell."""
        sizes = list(self.sizes(table).values())
        return sum(sizes) if sizes and None not in sizes else None

    def changes(self, table: str) -> DataFrame | None:
        """All rows of the table's change files, if there are any."""
        return self.read(changes_of(table))

    def read(self, name: str) -> DataFrame | None:
        """All parts that the log lists under a name, as they are."""
        paths = list(self.parts(name).values())
        return self.spark.read.schema(ddl_of(name)).parquet(*paths) if paths else None

    def tables(self) -> Tables:
        """All tables, with their summaries and counts."""
        counts = {table: n for table in schemas.TABLES if (n := self.row_count(table)) is not None}
        return _tables(self.spark, self.parts, self.table, counts)

    def table(
        self, table: str, parts: list[str] | None = None, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows
    ) -> DataFrame:
        """Current rows, or the seed rows of a table that was never written; `parts` reads only those. `shape` shortens rows
        that are read before changes are laid over them."""
        known = self.parts(table)
        if not known and parts is None:
            if table == "dimSpendingCategory":
                return seed_categories(self.spark)
            return seed_unknown_members(self.spark, table)
        paths = [path for part, path in known.items() if parts is None or part in parts]
        if not paths:
            return literal_rows(self.spark, [], schemas.TABLES[table])
        many = many_changes(sum(n or 0 for n in self.sizes(changes_of(table)).values()), self.last_key(table))
        return overlaid(table, shape(self.spark.read.schema(schemas.TABLES[table]).parquet(*paths)), self.changes(table), many)

    def parts_with(self, table: str, column: str, values: DataFrame) -> list[str]:
        """Parts that hold rows with one of the given values (a frame with that column). Only parts whose range of the
        column, by the log, meets that of the values are looked into."""
        entries = [e for e in self._entries()[0] if e.tableName == table]
        if schemas.PRUNED_BY.get(table) == column:
            kind = schemas.struct(schemas.TABLES[table])[column].dataType.simpleString()
            text = range_text(F.col(column), kind)
            low, high = values.agg(F.min(text), F.max(text)).first()
            entries = [e for e in entries if low is not None and (e.low is None or (e.low <= high and low <= e.high))]
        if not entries:
            return []
        part = F.regexp_extract("_path", f"/{table}/([0-9a-f]+)/", 1).alias("part")
        rows = self.spark.read.schema(schemas.TABLES[table]).parquet(*[e.path for e in entries])
        rows = rows.select(column, F.col("_metadata.file_path").alias("_path"))
        found = rows.join(values.select(column).distinct(), column, "left_semi").select(part).distinct()
        return [row.part for row in found.collect()]

    def compact(self, fan: int = FAN, full_rows: int = FULL_ROWS, fold_share: float = FOLD_SHARE) -> dict[str, int]:
        """Merge parts by size; returns the rows rewritten, by table.

        A part's tier is the power of `fan` in its number of rows. `fan` neighbours (by age) of one tier become one
        part of a higher tier, so a row is rewritten once per tier: over n loads as n log n, and a part of `full_rows`
        never again. Change files are merged likewise; the parts that they are about are rewritten once the files
        have more than `fold_share` of the table's rows.
        """
        with temporary(self.spark):
            return self._compact(fan, full_rows, fold_share)

    def _compact(self, fan: int, full_rows: int, fold_share: float) -> dict[str, int]:
        change, written = self.begin(), {}

        def merge(table: str, parts: list[str]) -> None:
            if table in schemas.TABLES:
                change.replace(table, parts, self.table(table, parts=parts))
            else:
                paths = [self.parts(table)[part] for part in parts]
                change.replace(table, parts, self.spark.read.schema(ddl_of(table)).parquet(*paths))
            written[table] = written.get(table, 0) + change.entry_rows(table)

        for table in schemas.TABLES:
            changes = changes_of(table)
            sizes = {part: n or 0 for part, n in self.sizes(table).items()}
            changed = sum(n or 0 for n in self.sizes(changes).values())
            if changed > fold_share * sum(sizes.values()):
                key = schemas.GENERATED_KEYS[table]
                parts = self.parts_with(table, key, self.changes(table).select(key))
                for part in parts:
                    merge(table, [part])
                sizes = {part: n for part, n in sizes.items() if part not in parts}
            else:
                for group in neighbours({p: n or 0 for p, n in self.sizes(changes).items()}, fan, math.inf):
                    merge(changes, group)
            for group in neighbours(sizes, fan, full_rows):
                merge(table, group)
        if change.entries:
            change.commit()
        return written

    def fork(self, root: str) -> "Store":
        """A store of its own with the same tables: it lists the same parts, which are never written again."""
        log = self._log()
        if log is not None:
            log.coalesce(1).write.parquet(f"{root.rstrip('/')}/commits")
        return Store(self.spark, root)

    def begin(self) -> "Change":
        return Change(self)

    def register(self, names: list[str] | None = None) -> None:
        for name in names or list(schemas.TABLES):
            layer = "bronze" if name in schemas.BRONZE_TABLES else "silver"
            self.table(name).createOrReplaceTempView(f"{layer}_{name}")


def tier(rows: int, fan: int) -> int:
    found = 0
    while rows >= fan:
        rows, found = rows // fan, found + 1
    return found


def neighbours(sizes: dict[str, int], fan: int, full_rows: float) -> list[list[str]]:
    """Groups of `fan` parts of one tier, in the order given; parts of `full_rows` are left out."""
    by_tier: dict[int, list[str]] = {}
    for part, rows in sizes.items():
        if rows < full_rows:
            by_tier.setdefault(tier(rows, fan), []).append(part)
    return [parts[k:k + fan] for parts in by_tier.values() for k in range(0, len(parts) - fan + 1, fan)]


class Change:
    """New parts written by one load; readers see none of them before `commit`."""

    def __init__(self, store: Store):
        self.store, self.spark, self.entries = store, store.spark, []
        self.base = store.last_commit()

    def last_key(self, table: str) -> int:
        written = [key for name, _, path, key, *_ in self.entries if name == table and path and key]
        return max([self.store.last_key(table), *written])

    def entry_rows(self, table: str) -> int:
        """Rows of the part of the table that was written last."""
        return next(rows for name, _, path, _, rows, *_ in reversed(self.entries) if name == table and path)

    def append(
        self, table: str, df: DataFrame, shape: Callable[[DataFrame], DataFrame] | None = None,
        widen: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """Add rows as a new part; existing parts are not read or written. Returns the new rows.

        `shape` adds columns that can be made of a row's others; they are not moved when rows are gathered in files, and
        neither are those that `widen` looks up, which must leave the rows where they are.
        """
        part = uuid.uuid4().hex
        path = f"{self.store.root}/{table}/{part}"
        kinds = {f.name: f.dataType.simpleString() for f in schemas.struct(ddl_of(table))}
        rows = df if shape else df.select(*kinds)
        key, pruned = schemas.GENERATED_KEYS.get(table), schemas.PRUNED_BY.get(table)
        # Counted while the part is written: no second pass over its rows.
        numbers = {"n": F.count(F.lit(1))}
        if key:
            numbers["key"] = F.max(key)
        if pruned:
            numbers |= {"low": F.min(range_text(F.col(pruned), kinds[pruned])), "high": F.max(range_text(F.col(pruned), kinds[pruned]))}
        if table in schemas.CLUSTERING:
            # Files of even size, however uneven the groups are; a date window then reads few of them.
            group, order = schemas.CLUSTERING[table]
            rows = rows.withColumn("_group", F.expr(group)).hint("rebalance", "_group").drop("_group")
            rows = (widen(rows) if widen else rows).sortWithinPartitions(*order)
        if shape:
            rows = shape(rows).select(*kinds)
        seen = Observation()
        rows.observe(seen, *[value.alias(name) for name, value in numbers.items()]).write.options(**CODEC).parquet(path)
        found = seen.get
        self.entries.append((table, part, path, found.get("key"), found["n"], found.get("low"), found.get("high")))
        written = self.spark.read.schema(ddl_of(table)).parquet(path)
        self._summarise(table, part, written)
        return written

    def _summarise(self, table: str, part: str, rows: DataFrame) -> None:
        """Write the summaries of a part, side by side."""
        jobs = {f"{table}.{name}": summary.of(rows) for name, summary in SUMMARIES.items()} if table in schemas.CHANGEABLE else {}
        if table in BITS_OF:
            jobs[f"{table}.bits"] = row_bits(table, rows)
        self._write_all(jobs, part)

    def _write_all(self, jobs: dict[str, DataFrame], part: str) -> None:
        def write(name: str) -> None:
            jobs[name].write.parquet(f"{self.store.root}/{name}/{part}")

        if jobs:
            with ThreadPoolExecutor(len(jobs)) as pool:
                running = [pool.submit(inheritable_thread_target(self.spark)(write), name) for name in jobs]
                for job in running:
                    job.result()
        self.entries += [(name, part, f"{self.store.root}/{name}/{part}", None, None, None, None) for name in jobs]

    def remove(self, table: str, parts: list[str]) -> None:
        """Parts that were current go with the commit; those of this change have not been seen by anyone."""
        for name in [table, *[n for n in summaries_of(table) if not n.endswith(".moved")]]:
            self.entries = [e for e in self.entries if e[0] != name or e[1] not in parts]
            known = self.store.parts(name)
            self.entries += [(name, part, None, None, None, None, None) for part in parts if part in known]

    def replace(self, table: str, parts: list[str], df: DataFrame) -> DataFrame:
        """Put rows in place of whole parts. Returns the new rows.

        The rows have been read with their changes, so these are taken out of the change files.
        """
        before = self._paths(table)
        written = self.append(table, df)
        self.remove(table, parts)
        changes = changes_of(table)
        if table in schemas.CHANGEABLE and parts and (paths := self._paths(changes)):
            key = schemas.GENERATED_KEYS[table]
            rows = self.spark.read.schema(ddl_of(changes)).parquet(*paths.values())
            left = materialise(rows.join(written.select(key), key, "left_anti"), "changes-left")
            if left.isEmpty():
                for name in SUMMARIES:
                    self.remove(f"{table}.{name}.moved", list(self._paths(f"{table}.{name}.moved")))
            else:
                # The new part's own sums have what these changes moved.
                taken = rows.join(written.select(key), key, "left_semi")
                old = self.spark.read.schema(schemas.TABLES[table]).parquet(*[before[p] for p in parts if p in before])
                old = materialise(old.join(taken.select(key).distinct(), key, "left_semi"), "changed-rows")
                self._move(table, overlaid(table, old, taken), old)
                self.append(changes, left)
            self.remove(changes, list(paths))
        return written

    def _move(self, table: str, old: DataFrame, new: DataFrame) -> None:
        self._write_all({f"{table}.{name}.moved": summary.moved(old, new) for name, summary in SUMMARIES.items()}, uuid.uuid4().hex)

    def put(self, table: str, df: DataFrame) -> DataFrame:
        """Replace the whole table."""
        written = self.append(table, df)
        self.drop(table)
        return written

    def drop(self, table: str) -> None:
        """Remove the parts and change files that were there before."""
        for name in (table, changes_of(table), *[n for n in summaries_of(table) if n.endswith(".moved")]):
            self.remove(name, list(self.store.parts(name)))

    def alter(self, table: str, rows: DataFrame) -> None:
        """Give rows new values: `rows` has the generated key and the columns of schemas.CHANGEABLE, one row per key."""
        new = self.append(changes_of(table), rows.withColumn("changeNumber", F.lit(self.base + 1).cast("long")))
        key = schemas.GENERATED_KEYS[table]
        # Of the row's name the summaries ask whether it is there.
        there = {name: F.when(F.col(name).isNotNull(), F.lit("")) for name in BITS_OF[table] if name in REQUIRED and name not in COUNTED_KEYS}
        old = self.store.table(table, shape=lambda rows: rows.select(
            *[there.get(c, F.col(c)).alias(c) for c in rows.columns if c in {key, *schemas.CHANGEABLE[table], *SUMMARISED}]))
        if many_changes(self.entry_rows(changes_of(table)), self.store.last_key(table)):
            old = marked(old, new, key).filter("_marked").drop("_marked")
        both = materialise(old.join(_newest(table, new), key), "changed-rows")
        self._move(table, both.drop("_new"), _with_new(table, both))

    def _paths(self, table: str) -> dict[str, str]:
        paths = self.store.parts(table)
        for name, part, path, *_ in self.entries:
            if name == table:
                paths[part] = path
        return {part: path for part, path in paths.items() if path}

    def table(self, table: str) -> DataFrame:
        """The table as it will be after the commit."""
        rows = self.spark.read.schema(schemas.TABLES[table]).parquet(*self._paths(table).values())
        changes = self._paths(changes_of(table))
        if not changes:
            return rows
        many = many_changes(sum(self._sizes()[changes_of(table), part] or 0 for part in changes), self.last_key(table))
        return overlaid(table, rows, self.spark.read.schema(ddl_of(changes_of(table))).parquet(*changes.values()), many)

    def _sizes(self) -> dict[tuple[str, str], int | None]:
        """Rows of parts by table and part, those of this change included."""
        return {(e.tableName, e.part): e.rowCount for e in self.store._entries()[0]} | {(e[0], e[1]): e[4] for e in self.entries}

    def tables(self) -> Tables:
        """All tables as they will be after the commit, with their summaries and counts."""
        rows = self._sizes()
        sizes = {table: [rows[table, part] for part in self._paths(table)] for table in schemas.TABLES}
        return _tables(self.spark, self._paths, self.table, {table: sum(n) for table, n in sizes.items() if None not in n})

    def commit(self) -> int:
        """Make the parts current. Of two writers that saw the same log, the second fails and publishes nothing."""
        number = self.base + 1
        rows = [(number, *entry) for entry in self.entries]
        self.store.claim(number)
        literal_rows(self.spark, rows, _LOG).coalesce(1).write.mode("append").parquet(f"{self.store.root}/commits")
        self.store.refresh()
        return number
