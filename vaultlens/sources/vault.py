"""Reader of a vault: every Markdown file of a tree, empty and hidden ones too.

Spark's text and binary sources leave out empty files and paths that begin
with _ or a dot, and escape names; this source lists the tree itself, leaves
out only the folders and files it is told to, reads texts with universal
newlines and can narrow the walk to a folder before any file is opened. The
path is a local one or a URI of any file system that Arrow reads; the driver
lists the upper folders only, each task lists and reads the trees below them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from vaultlens.functions import frontmatter as fm
from vaultlens.functions import text as T
from vaultlens.sources.tables import is_moc

#: Folders, or files of such names, that are no part of a vault.
SKIP_DIRS = (".obsidian", ".trash", ".smart-env", ".archive", ".git")
SCHEMA = "path string, rel_path string, folder string, stem string, text string, is_valid boolean"


#: Trees into which the driver divides a vault before tasks go on listing.
TREES = 64


class _Part(InputPartition):
    def __init__(self, files: list[str], trees: list[str]):
        self.files, self.trees = files, trees


class VaultReader(DataSourceReader):
    def __init__(self, options: dict):
        given = options["path"]
        self.uri = given.rstrip("/") if "://" in given else os.path.abspath(given)
        self.folder = options.get("folder", "").strip("/")
        self.skip = {s for s in options.get("skip_dirs", ",".join(SKIP_DIRS)).split(",") if s}
        self.exclude = {s for s in options.get("exclude", "").split("\n") if s}
        self.errors = options.get("errors", "strict")
        self.per = int(options.get("files_per_partition", 500))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri else (fs.LocalFileSystem(), self.uri)

    def _list(self, at: fs.FileSystem, root: str, tree: str) -> tuple[list[str], list[str]]:
        """Files and folders right below a tree, relative to the vault."""
        files, trees = [], []
        for x in at.get_file_info(fs.FileSelector(f"{root}/{tree}" if tree else root)):
            rel = f"{tree}/{x.base_name}" if tree else x.base_name
            if x.base_name in self.skip:
                continue
            if x.type == fs.FileType.Directory:
                trees.append(rel)
            elif rel.endswith(".md") and x.base_name not in self.exclude:
                files.append(rel)
        return sorted(files), sorted(trees)

    def partitions(self) -> list[InputPartition]:
        at, root = self._open()
        if at.get_file_info(f"{root}/{self.folder}" if self.folder else root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"{self.uri}/{self.folder}")
        files: list[str] = []
        trees = [self.folder]
        while trees and len(trees) < TREES:
            found = [self._list(at, root, t) for t in trees]
            files += [f for of, _ in found for f in of]
            trees = [t for _, of in found for t in of]
        parts = [_Part(files[k : k + self.per], []) for k in range(0, len(files), self.per)]
        return [*parts, *(_Part([], [t]) for t in trees)] or [_Part([], [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        at, root = self._open()
        yield from self._batches(at, root, partition.files)
        trees = list(partition.trees)
        while trees:
            files, more = self._list(at, root, trees.pop())
            trees += more
            yield from self._batches(at, root, files)

    def _batches(self, at: fs.FileSystem, root: str, files: list[str]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(files), self.per):
            rows = [self._row(at, root, rel) for rel in files[k : k + self.per]]
            types = [pa.string()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    def _row(self, at: fs.FileSystem, root: str, rel: str) -> tuple:
        with at.open_input_stream(f"{root}/{rel}", compression=None) as f:
            raw = f.read()
        try:
            text, valid = raw.decode("utf-8"), True
        except UnicodeDecodeError:
            if self.errors == "strict":
                raise
            text, valid = raw.decode("utf-8", "replace"), False
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        return f"{self.uri}/{rel}", rel, os.path.dirname(rel), os.path.basename(rel)[:-3], text, valid


class VaultSource(DataSource):
    """Format 'vault': options path, folder, skip_dirs (by commas), exclude (file names, by line), errors (strict or replace), files_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return VaultReader(dict(self.options))


def read_vault(spark: SparkSession, path: str, *, exclude: list[str] | tuple[str, ...] = (), **options: str) -> DataFrame:
    """The files of a vault; exclude names files, wherever they are, that are left out unread."""
    spark.dataSource.register(VaultSource)
    return spark.read.format("vault").options(path=path, exclude="\n".join(exclude), **options).load()


def strict_notes(files: DataFrame) -> DataFrame:
    """The audit dialect: frontmatter only where the text begins with ---, H1 titles, string fields."""
    gate = files["text"].startswith("---") & (F.size(F.split("text", "---", 3)) == 3)
    return _notes(files, gate, strict=True)


def lenient_notes(files: DataFrame) -> DataFrame:
    """The dedup dialect: frontmatter wherever there are two ---, titles from file names, no maps of content."""
    n = _notes(files, F.size(F.split("text", "---", 3)) == 3, strict=False)
    return n.where(~is_moc(F.coalesce("note_type", F.lit("")), "title"))


def _notes(files: DataFrame, gate: F.Column, *, strict: bool) -> DataFrame:  # type: ignore[name-defined]
    parts = F.split("text", "---", 3)
    j = files.withColumn("frontmatter", F.when(gate, fm.yaml_json(F.get(parts, F.lit(1))))).withColumn("body", T.strip(F.when(gate, F.get(parts, F.lit(2))).otherwise(F.col("text"))))
    tags = F.coalesce(F.from_json(F.get_json_object("frontmatter", "$.tags"), "array<string>"), F.array().cast("array<string>"))
    field = lambda k: F.get_json_object("frontmatter", f"$.{k}")
    typed = (lambda c: F.coalesce(c, F.lit(""))) if strict else (lambda c: c)
    return j.select(
        "path", "rel_path", "folder", "stem",
        (T.h1_title("text", "stem") if strict else F.col("stem")).alias("title"),
        typed(field("note_type")).alias("note_type"), typed(field("source_doc")).alias("source_doc"), field("date").alias("date"),
        "frontmatter", "body", (F.array_distinct(tags) if strict else tags).alias("tags"),
        T.links_normalised("body").alias("links"), T.word_count("body").alias("words"), (T.strip("text") == "").alias("is_blank"),
    )


def find_note(files: DataFrame, query: str, notes_folder: str = "Notes", moc_folder: str = "MOCs") -> DataFrame:
    """The file a name means, if any: by path, at the top, in the notes' folder, in that of maps, anywhere."""
    name = query.removesuffix(".md")
    stem = os.path.basename(name)
    rank = (
        F.when(F.col("path").isin(query, name + ".md"), 0)
        .when(F.col("rel_path") == name + ".md", 1)
        .when(F.col("rel_path") == f"{notes_folder}/{name}.md", 2)
        .when(F.col("rel_path") == f"{moc_folder}/{name}.md", 3)
        .when((F.col("stem") == stem) & ~F.col("rel_path").rlike(r"(^|/)\."), 4)
    )
    return files.withColumn("rank", rank).where("rank is not null").orderBy("rank", "rel_path").limit(1).drop("rank")
