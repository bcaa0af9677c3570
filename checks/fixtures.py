"""Loaded layers that the registered queries read, built from the given tables once per session and folder."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymill import schemas
from tallymill.plans import gold, silver
from tallymill.session import tune
from tallymill.sources.feed import checking_feed, credit_feed, feed_metadata
from tallymill.sources.files import Stage, stage_files
from tallymill.sources.store import Store, materialise, shared_folder

CHUNK = 5000
_cache: dict[tuple, object] = {}


@dataclass
class Layers:
    stage: Stage
    store: Store
    tables: dict[str, DataFrame]
    gold: dict[str, DataFrame]


def once(spark: SparkSession, sf_dir: str, what: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _cache:
        _cache[key] = build()
    return _cache[key]


def new_store(spark: SparkSession, what: str) -> Store:
    return Store(spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}")


def build_layers(spark: SparkSession, stage: Stage, what: str) -> Layers:
    store = new_store(spark, what)
    tables = silver.load(store, stage)
    return Layers(stage, store, tables, {name: view(tables) for name, view in gold.VIEWS.items()})


def staged(spark: SparkSession, sf_dir: str) -> Stage:
    """Both feeds as a load would stage them. Their texts are made where rows are read, first for Bronze, from numbered
    rows that are written already."""
    def build() -> Stage:
        tune(spark)
        checking, credit = silver.together(
            spark,
            lambda: checking_feed(spark, sf_dir),
            lambda: credit_feed(spark, sf_dir),
        )
        metadata = materialise(feed_metadata(checking, credit), "feed-files")
        return Stage(metadata, checking, credit, numbered=True)
    return once(spark, sf_dir, "stage", build)


def layers(spark: SparkSession, sf_dir: str) -> Layers:
    return once(spark, sf_dir, "layers", lambda: build_layers(spark, staged(spark, sf_dir), "warehouse"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = staged(spark, sf_dir)
    return silver.prepare(silver.unify_sources(stage.checking, stage.credit))


def part_name(name, row_number):
    """Feed rows are spread over files of CHUNK rows; five digits are no account number."""
    place = F.lpad(F.floor((row_number - 1) / CHUNK).cast("string"), 5, "0")
    return F.replace(name, F.lit("_Activity"), F.concat(F.lit("_Activity_p"), place))


def _writer(root: str, headers: dict[str, str]):
    names, titles = list(headers.values()), list(headers)

    def write(rows: pa.Table) -> pa.Table:
        from pyarrow import csv, fs

        name = rows["part"][0].as_py()
        named = rows.sort_by("sourceRowNumber").select(names).rename_columns(titles)
        system, folder = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as stream:
            csv.write_csv(named, stream)
        return pa.table({"part": pa.array([name], pa.string()), "n": [rows.num_rows]})

    return write


def _whole_files(write):
    """Rows of a file that come one after another, all CHUNK of them, are written where they are; the other rows go on."""
    def split(batches):
        held, part, n = [], None, 0

        def leave():
            rows = pa.Table.from_batches(held)
            numbers = rows["sourceRowNumber"]
            if part is not None and len(rows) == CHUNK and pc.min(numbers).as_py() % CHUNK == 1 and pc.all(
                    pc.equal(pc.pairwise_diff(numbers.combine_chunks(), 1)[1:], 1)).as_py():
                write(rows)
            else:
                yield from rows.to_batches()

        for batch in batches:
            ends = pc.run_end_encode(batch.column("part")).run_ends.to_pylist() if batch.num_rows else []
            for start, end in zip([0, *ends], ends):
                name = batch.column("part")[start].as_py()
                if held and (name != part or n >= CHUNK):
                    yield from leave()
                    held, n = [], 0
                held.append(batch.slice(start, end - start))
                part, n = name, n + end - start
        if held:
            yield from leave()

    return split


def landing(spark: SparkSession, sf_dir: str) -> str:
    """The feed as CSV files of at most CHUNK rows, in one folder per source shape."""
    def build() -> str:
        stage = staged(spark, sf_dir)
        root = f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
        for folder, rows, headers in [
            ("checking", stage.checking, schemas.CHECKING_HEADERS), ("card", stage.credit, schemas.CREDIT_HEADERS)
        ]:
            texts = [F.nullif(F.col(name), F.lit("")).alias(name) for name in headers.values()]
            files = rows.select(part_name(F.col("sourceFileName"), F.col("sourceRowNumber")).alias("part"), "sourceRowNumber", *texts)
            write = _writer(f"{root}/{folder}", headers)
            # The feed is sorted, so that few files have rows in several tasks; only these move.
            parted = files.mapInArrow(_whole_files(write), files.schema)
            parted.groupBy("part").applyInArrow(write, "part string, n long").count()
        return root
    return once(spark, sf_dir, "landing", build)


def landed_stage(spark: SparkSession, sf_dir: str) -> Stage:
    return once(spark, sf_dir, "landed-stage", lambda: stage_files(spark, landing(spark, sf_dir)))


def landed_layers(spark: SparkSession, sf_dir: str) -> Layers:
    return once(spark, sf_dir, "landed", lambda: build_layers(spark, landed_stage(spark, sf_dir), "landed"))
