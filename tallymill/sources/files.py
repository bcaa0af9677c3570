"""Discovery, profiling and reading of transaction CSV files."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import schemas
from ..operators.joins import lookup
from ..operators.numbering import dedupe
from .literals import literal_rows
from .records import broken_files, one_spelling, read_broken
from .store import materialise

CSV_GLOB, CSV_NAME = "*.[cC][sS][vV]", r"\.[cC][sS][vV]$"
# Bytes of a file that are in memory at once while it is profiled.
CHUNK_BYTES = 8 << 20
# Files that one scan is planned from.
GROUP_FILES = 20_000
# Fixed value: an isolated group of exactly four digits in a file name.
FOUR_DIGITS = r"(?<!\d)(\d{4})(?!\d)"


@dataclass
class Stage:
    """Staged input of a load: file metadata, the rows of the two source shapes, and the files of no known shape.

    `numbered` says that no two rows of a file share a row number, `written` that both frames read a written copy.
    """

    metadata: DataFrame
    checking: DataFrame
    credit: DataFrame
    skipped: DataFrame | None = None
    numbered: bool = False
    written: bool = False


def _system(path: str):
    """The file system of a path as Spark writes it, and the path there."""
    from pyarrow import fs

    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _list_folders(batches):
    """What the given folders hold, one level down. Names that start with . or _ are hidden, as in Spark's own scans."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for folder in batch["path"]:
            system, name = _system(folder)
            for found in system.get_file_info(fs.FileSelector(name)):
                if not found.base_name.startswith((".", "_")):
                    is_folder = found.type == fs.FileType.Directory
                    rows.append((f"{folder.rstrip('/')}/{found.base_name}", 0 if is_folder else found.size, is_folder))
        yield pd.DataFrame(rows, columns=["path", "length", "folder"]).astype({"length": "int64", "folder": "bool"})


def list_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(path, length) of every CSV with any bytes below the root, or of the given files.

    Folders are listed by tasks, level by level, into written tables: the driver sees no path. A root that does not exist
    holds nothing.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if not isinstance(root, str):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        return reader.load(root).select("path", "length") if root else literal_rows(spark, [], "path string, length long")
    path = jvm.org.apache.hadoop.fs.Path(root)
    system, found = path.getFileSystem(conf), literal_rows(spark, [], "path string, length long")
    if not system.exists(path):
        return found
    top = system.getFileStatus(path)
    if not top.isDirectory():
        return literal_rows(spark, [(top.getPath().toString(), top.getLen())], "path string, length long")
    folders = literal_rows(spark, [(top.getPath().toString(),)], "path string")
    while True:
        level = folders.mapInPandas(_list_folders, "path string, length long, folder boolean")
        level = materialise(level, "listing")
        found = found.unionByName(level.filter(~F.col("folder") & (F.col("length") > 0) & F.rlike("path", F.lit(CSV_NAME))).select("path", "length"))
        folders = level.filter("folder").select("path")
        if folders.isEmpty():
            return found
        folders = folders.repartition(F.col("path"))


def discover_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(path, length) of every CSV below the root, or of the given files, by path."""
    return list_files(spark, root).orderBy("path")


def _profile(chunk_bytes: int):
    """Profile of whole files, read in chunks: hash and first line."""
    def profile(batches):
        for batch in batches:
            rows = []
            for path in batch["path"]:
                system, name = _system(path)
                digest, head, in_head = hashlib.sha256(), [], True
                with system.open_input_stream(name) as stream:
                    while chunk := stream.read(chunk_bytes):
                        digest.update(chunk)
                        if in_head:
                            line = re.split(rb"[\r\n]", chunk, maxsplit=1)
                            head.append(line[0])
                            in_head = len(line) == 1
                # Bytes that are no UTF-8 may spoil a name, and so the file's shape, but not the load.
                rows.append((path, digest.hexdigest(), b"".join(head).decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["path", "sourceFileHash", "head"])

    return profile


def file_contents(spark: SparkSession, root: str | list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, sourceFileHash, head): SHA-256 of the bytes, and the header line. Files are streamed, so their size does
    not matter."""
    paths = list_files(spark, root).select("path")
    # A listing is a few short rows; what they name is dealt out to all cores, and stays so whatever its size.
    tasks = max(1, min(paths.count(), 4 * spark.sparkContext.defaultParallelism))
    return paths.repartition(tasks, "path").mapInPandas(_profile(chunk_bytes), "path string, sourceFileHash string, head string")


def header_names(head: Column) -> Column:
    """Column names in the first line: byte order mark dropped, quotes removed, doubled quotes restored."""
    line = F.regexp_extract(head, r"^\x{FEFF}?([^\r\n]*)", 1)
    fields = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,"]*)'), 1)
    return F.transform(
        fields,
        lambda f: F.when(f.startswith('"'), F.replace(F.regexp_extract(f, '^"(.*)"$', 1), F.lit('""'), F.lit('"')))
        .otherwise(f),
    )


def file_type(headers: Column) -> Column:
    """Checking is tested first; NULL for a shape that is not supported."""
    def has_all(required) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), headers)) == 0
    return F.when(has_all(schemas.CHECKING_HEADERS), schemas.CHECKING_TYPE).when(
        has_all(schemas.CREDIT_HEADERS), schemas.CREDIT_TYPE
    )


def account_columns(name: Column, kind: Column) -> dict[str, Column]:
    groups = F.regexp_extract_all(name, F.lit(FOUR_DIGITS), 1)
    return {
        "accountType": F.when(kind == schemas.CHECKING_TYPE, "checking").otherwise("creditCard"),
        "accountLastFour": F.when(F.size(groups) > 0, F.try_element_at(groups, F.lit(-1))).otherwise("unknown"),
    }


def shaped_files(contents: DataFrame) -> DataFrame:
    """Contents with the names in their header and the shape these make, NULL for one that is not supported."""
    return contents.withColumn("layout", header_names(F.col("head"))).withColumn("sourceFileType", file_type(F.col("layout")))


def classify_files(contents: DataFrame) -> DataFrame:
    """Supported files with name, path, header layout, hash, type and account; see `skipped_files` for the others."""
    return (
        shaped_files(contents).filter(F.col("sourceFileType").isNotNull())
        .withColumn("sourceFileName", F.element_at(F.split("path", "/"), -1))
        .withColumns(account_columns(F.col("sourceFileName"), F.col("sourceFileType")))
        .select(
            "sourceFileName", F.col("path").alias("sourceFilePath"), "sourceFileHash", "sourceFileType",
            "accountType", "accountLastFour", "layout",
        )
    )


def skipped_files(contents: DataFrame) -> DataFrame:
    """(path, sourceFileHash, head) of files whose header is of no supported shape."""
    return shaped_files(contents).filter(F.col("sourceFileType").isNull()).select("path", "sourceFileHash", "head").orderBy("path")


# A field of a record, with the comma before it.
_FIELDS = r'(?:^|,)("(?:[^"]|"")*"[^,]*|[^,]*)'


def _named(rows: DataFrame, path: Column, layout: list[str], headers: dict[str, str], *place: str) -> DataFrame:
    """The wanted columns of parsed rows. A row with anything in a field beyond the header fails, wherever it stands: such
    rows come with their text, as they have more fields than columns."""
    beyond = F.slice(F.regexp_extract_all("_corrupt", F.lit(_FIELDS), F.lit(1)), len(layout) + 1, 1 << 20)
    surplus = F.exists(beyond, lambda f: F.regexp_replace(f, r'[\s"]', "") != "")
    checked = F.when(F.coalesce(surplus, F.lit(False)), F.raise_error(F.concat(F.lit("a row has more fields than the header: "), path))).otherwise(path)
    return rows.select(*[F.col(f"`{header}`").alias(name) for header, name in headers.items()], checked.alias("_path"), *place)


def _row_schema(layout: list[str]) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` string" for name in [*layout, "_corrupt"])


def read_rows(spark: SparkSession, paths: list[str], layout: list[str], headers: dict[str, str]) -> DataFrame:
    """All-text rows of files that share one header layout, with their place: block and slot.

    No record has more than one line. Blocks depend on how this scan splits the files: number rows from one written copy.
    """
    raw = spark.read.schema(_row_schema(layout)).options(
        header=True, quote='"', escape='"', columnNameOfCorruptRecord="_corrupt").csv(paths)
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_slot"))
    return _named(rows, one_spelling(F.col("_file")), layout, headers, "_block", "_slot")


def file_blocks(rows: DataFrame) -> DataFrame:
    """(_path, _block, _first, _n): first slot and row count of every file block, one entry per input split."""
    return rows.groupBy("_path", "_block").agg(F.min("_slot").alias("_first"), F.count("*").alias("_n"))


def with_row_number(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Row number in file order, without moving rows. `rows` is a written copy, `blocks` comes from that copy.

    The rows of a file block are consecutive within one task, so a row's place is its distance from the block's
    first row plus the rows of the earlier blocks. A row whose block is unknown fails.
    """
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = lookup(rows, blocks, ["_path", "_block"], spread=["_slot"])
    place = (F.col("_slot") - F.col("_first") + F.col("_before") + 1).cast("long")
    lost = F.raise_error(F.concat(F.lit("no block for a row of "), F.col("_path"))).cast("long")
    return numbered.withColumn("sourceRowNumber", F.when(F.col("_first").isNull(), lost).otherwise(place)).drop(
        "_first", "_before", "_block", "_slot")


def with_lineage(rows: DataFrame, files: DataFrame) -> DataFrame:
    lineage = files.select(
        one_spelling(F.col("sourceFilePath")).alias("_path"), "sourceFileName", "sourceFileHash", "sourceFileType"
    )
    return lookup(rows, lineage, ["_path"], spread=["sourceRowNumber"], how="inner").drop("_path")


def _in_groups(rows: DataFrame, size: int):
    """(layout, paths) of up to `size` files each; the driver holds the paths of one group at a time."""
    for row in rows.select("layout").distinct().collect():
        same, last = rows.filter(F.col("layout") == F.lit(row.layout)).select("sourceFilePath"), ""
        while paths := [r.sourceFilePath for r in same.filter(F.col("sourceFilePath") > last).orderBy("sourceFilePath").limit(size).collect()]:
            yield list(row.layout), paths
            last = paths[-1]


def _stage_rows(
    spark: SparkSession, files: DataFrame, kind: str, headers: dict[str, str], ddl: str, multi_line: bool, group: int
) -> tuple[DataFrame, DataFrame]:
    """Staged rows of one file type and the rows per path. Rows are read once, into a copy that both numbers and counts
    come from. Files are scanned in groups, whose paths alone go through the driver."""
    staged, counts = literal_rows(spark, [], ddl), literal_rows(spark, [], "_path string, rowCount long")
    for layout, paths in _in_groups(files.filter(F.col("sourceFileType") == kind), group):
        spelled = dict(literal_rows(spark, [(p,) for p in paths], "p string").select("p", one_spelling(F.col("p"))).collect())
        found = set(spelled.values() if multi_line else broken_files(spark, paths))
        broken, plain = [p for p in paths if spelled[p] in found], [p for p in paths if spelled[p] not in found]
        if plain:
            rows = materialise(read_rows(spark, plain, layout, headers), "raw")
            blocks = materialise(file_blocks(rows), "blocks")
            staged = staged.unionByName(with_lineage(with_row_number(rows, blocks), files))
            counts = counts.unionByName(blocks.groupBy("_path").agg(F.sum("_n").alias("rowCount")))
        if broken:
            parsed = read_broken(spark, broken, _row_schema(layout))
            rows = materialise(_named(parsed, F.col("_path"), layout, headers, "sourceRowNumber"), "raw")
            staged = staged.unionByName(with_lineage(rows, files))
            counts = counts.unionByName(rows.groupBy("_path").agg(F.count("*").alias("rowCount")))
    return staged, counts


def stage_files(
    spark: SparkSession, root: str | list[str], known_hashes: DataFrame | None = None, multi_line: bool = False,
    group: int = GROUP_FILES,
) -> Stage:
    """Profile and read all supported files below the root, or the given ones.

    Of files with equal bytes the one with the lowest name is read. With `known_hashes` (a sourceFileHash
    column), files already loaded are skipped. Files with line breaks inside quotes are found and read by `records`;
    `multi_line` reads all files that way. A folder that does not exist is an empty one.
    """
    contents = materialise(file_contents(spark, root), "contents")
    files = classify_files(contents)
    if known_hashes is not None:
        files = new_files(files, known_hashes)
    files = materialise(dedupe(files, ["sourceFileHash"], [F.col("sourceFileName"), F.col("sourceFilePath")]), "files")
    checking, checking_counts = _stage_rows(
        spark, files, schemas.CHECKING_TYPE, schemas.CHECKING_HEADERS, schemas.STAGED_CHECKING, multi_line, group
    )
    credit, credit_counts = _stage_rows(
        spark, files, schemas.CREDIT_TYPE, schemas.CREDIT_HEADERS, schemas.STAGED_CREDIT, multi_line, group
    )
    metadata = (
        files.withColumn("_path", one_spelling(F.col("sourceFilePath")))
        .join(checking_counts.unionByName(credit_counts), "_path", "left")
        .withColumn("rowCount", F.coalesce("rowCount", F.lit(0)))
        .select(schemas.struct(schemas.FILE_METADATA).names)
    )
    return Stage(metadata, checking, credit, skipped_files(contents), numbered=True)


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose bytes were not loaded before, under whatever name."""
    return files.join(known.select("sourceFileHash"), "sourceFileHash", "left_anti").select(files.columns)
