"""Markdown trees: reading ``.md`` files, writing documents to tables or files.

Files written one by one are never all old or all new. ``MarkdownTree`` is for readers
that must not see that: files of a new version lie beside the old ones, a manifest
says which file a path has, and the manifest counts once it is committed.

Trees have as many files as documents, so the driver never lists them: tasks list folders,
or take names from the manifest, and open the files.
"""

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.storage import Commits, RunFolder, existing, located

#: Files that a task opens; folders that a task lists.
FILES_PER_TASK, FOLDERS_PER_TASK = 4096, 1024
#: Names and bytes of a batch that a task hands on.
BATCH_NAMES, BATCH_BYTES = 4096, 1 << 22
#: Parts of a path that Spark's file sources see: none is empty or begins with a dot, or, without an
#: equals sign, with an underscore; of folders a few more.
_FOLDER = r"(?:(?!\.|_(?!(?:common_)?metadata|[^/]*=)|(?!_(?:common_)?metadata)[^/]*\._COPYING_(?:/|\z))[^/]+)"
_FOLDERS = rf"\A{_FOLDER}(?:/{_FOLDER})*\z"
_FILES = rf"\A(?:{_FOLDER}/)*(?!\.|_(?![^/]*=))[^/]*\.md\z"
_FOUND = "root string, place string, name binary, folder boolean"


def read_markdown_tree(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, content)`` of every ``.md`` file below a directory, which may be a pattern.

    Hidden names and empty files are passed over, as by Spark's own readers. The names are
    listed when this is called, level by level, a folder in one task.
    """
    found = existing(spark, directory)
    if not found:
        return spark.read.format("binaryFile").load(directory)  # tells that it is not there
    run, name = RunFolder(spark, "listed"), F.col("name").cast("string")
    rows = [(root, place, b"", True) if folder else (*_parted(root, place), False) for root, place, folder in found]
    level, levels = run.keep(spark.createDataFrame(rows, _FOUND), "level_0"), 1
    while folders := level.filter("folder").count():
        below = _inside(_spread(level.filter("folder"), folders, FOLDERS_PER_TASK))
        seen = F.when(F.col("folder"), name.rlike(_FOLDERS)).otherwise(name.rlike(_FILES))
        level, levels = run.keep(below.filter(seen), f"level_{levels}"), levels + 1
    files = spark.read.schema(_FOUND).parquet(*(f"{run.path}/level_{n}" for n in range(levels))).filter("NOT folder")
    path = F.concat(F.rtrim("root", F.lit("/")), F.lit("/"), name)
    files = files.filter(name.rlike(_FILES)).select(
        F.regexp_replace(path, r"\Afile:/+", "/").alias("path"), "place", "name"
    )
    return _texts(files if len(found) == 1 else files.dropDuplicates(["path"]))


def _parted(root: str, place: str) -> tuple[str, str, bytes]:
    """Folder, its URI, and name of a file."""
    folder, _, name = root.rpartition("/")
    return folder, place.rpartition("/")[0] + "/", name.encode()


def _spread(rows: DataFrame, n: int, per_task: int) -> DataFrame:
    """``n`` narrow rows dealt to all cores, and at most ``per_task`` or so to a task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(min(n, cores), -(-n // per_task), 1))


def _stores() -> Callable[[str], tuple]:
    """A function that gives the store of a URI, and its path there with a slash behind; stores are opened once."""
    places: dict[str, tuple] = {}

    def opened(place: str) -> tuple:
        from pyarrow import fs

        if place not in places:
            system, root = fs.FileSystem.from_uri(place)
            places[place] = system, root.rstrip("/").encode() + b"/"
        return places[place]

    return opened


def _inside(folders: DataFrame) -> DataFrame:
    """What lies in folders, by name below the root."""
    opened = _stores()

    def entries(system, folder: bytes) -> Iterator[tuple[bytes, bool]]:
        from pyarrow import fs

        if isinstance(system, fs.LocalFileSystem):  # one name at a time
            try:
                with os.scandir(folder) as found:
                    yield from ((e.name, e.is_dir()) for e in found if e.is_dir() or e.is_file())
            except FileNotFoundError:
                pass  # gone since it was listed
        else:
            for info in system.get_file_info(fs.FileSelector(folder.decode(), allow_not_found=True)):
                yield info.base_name.encode(), info.type == fs.FileType.Directory

    def batch(root: str, place: str, found: list[tuple[bytes, bool]]) -> pa.RecordBatch:
        names, kinds = zip(*found)
        columns = [pa.array([root] * len(found)), pa.array([place] * len(found)), pa.array(names, pa.binary()), pa.array(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["root", "place", "name", "folder"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for root, place, name in zip(*(rows[c].to_pylist() for c in ("root", "place", "name"))):
                system, below = opened(place)
                found: list[tuple[bytes, bool]] = []
                for entry, folder in entries(system, below + name):
                    found.append((name + b"/" + entry if name else entry, folder))
                    if len(found) == BATCH_NAMES:
                        yield batch(root, place, found)
                        found = []
                if found:
                    yield batch(root, place, found)

    return folders.mapInArrow(run, _FOUND)


def _texts(files: DataFrame, lost: bool = False) -> DataFrame:
    """``(path, content)`` of ``files(path, place, name)`` that are not empty, opened by tasks.

    A file that is not there ends the run, unless it may be ``lost``.
    """
    opened = _stores()

    def batch(texts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*texts)], names=["path", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple[bytes, bytes]] = []
        size = 0
        for names in batches:
            for path, place, name in zip(*(names[c].to_pylist() for c in ("path", "place", "name"))):
                system, below = opened(place)
                try:
                    with system.open_input_file(below + name) as file:
                        content = file.read()
                except FileNotFoundError:
                    if not lost:
                        raise
                    continue
                if content:
                    texts.append((path, content))
                    size += len(content)
                if size >= BATCH_BYTES or len(texts) == BATCH_NAMES:
                    yield batch(texts)
                    texts, size = [], 0
        if texts:
            yield batch(texts)

    # As in writing, names travel as bytes.
    names = files.select(F.col("path").cast("binary"), "place", F.col("name").cast("binary"))
    rows = _spread(names, files.count(), FILES_PER_TASK).mapInArrow(run, "path binary, content binary")
    return rows.select(*(F.col(c).cast("string").alias(c) for c in ("path", "content")))


def write_document_table(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The primary sink: documents as Parquet rows ``(path, content)``."""
    _published(documents).write.mode(mode).parquet(path)


def write_markdown_tree(documents: DataFrame, directory: str = "") -> DataFrame:
    """Write one file per document; ``(path, error)`` of each, ``error`` null if written.

    ``documents`` is a result of ``convert`` or of ``sync``; rows without content
    are passed over. Paths lie below ``directory``, when it is given. On a cluster
    that must be a place that all executors share, as a URI or as a path in Spark's
    default file system. A name that is null or cannot be
    written is that document's error and ends nothing. A file is written under
    another name in its folder and then moved, so a task that is run again leaves
    whole files only.
    """
    spark = documents.sparkSession
    if not directory and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, name a shared directory")
    place = located(spark, directory) if directory else ""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(place) if place else (fs.LocalFileSystem(), "")
        below = root.rstrip("/").encode() + b"/" if root else b""

        def put(target: bytes, content: pa.Scalar) -> None:
            folder, slash, _ = target.rpartition(b"/")
            if folder:
                system.create_dir(folder, recursive=True)
            part = folder + slash + uuid.uuid4().hex.encode() + b".part"
            try:
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, target)
            except OSError:
                if system.get_file_info([part.decode()])[0].type != fs.FileType.NotFound:
                    system.delete_file(part)
                raise

        for batch in batches:
            errors = []
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    if not name.is_valid:
                        raise ValueError("it has no name")
                    put(below + name.as_py(), content)
                    errors.append(None)
                except (OSError, ValueError, pa.ArrowException) as failure:
                    errors.append(f"failed to write file: {failure}")
            told = pa.array(errors, pa.string())
            yield pa.RecordBatch.from_arrays([batch["name"], told], names=["name", "error"])

    # Names travel as bytes: one that was cut inside a character is no valid text.
    rows = _published(documents).select(
        F.col("path").cast("binary").alias("name"), F.col("content").cast("binary")
    )
    told = rows.mapInArrow(write, "name binary, error string")
    return RunFolder(spark, "written").keep(
        told.select(F.col("name").cast("string").alias("path"), "error"), "files"
    )


def _published(documents: DataFrame) -> DataFrame:
    path = "path" if "path" in documents.columns else "file_path"
    return documents.filter(F.col("content").isNotNull()).select(F.col(path).alias("path"), "content")


class MarkdownTree:
    """A tree of Markdown files below ``directory`` of which readers see whole versions.

    ``files/<version>/`` has the files that a version wrote, ``manifests/<version>/`` the table
    ``(path, file, revision)`` of all its files, those taken over from earlier versions
    among them, so only changed documents are written. One writer publishes at a time.
    """

    _MANIFEST = "path string, file string, revision string"

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self._commits = Commits(spark, self.directory)

    def publish(self, documents: DataFrame, whole: bool = False) -> DataFrame:
        """Commit a version with these documents; ``(path, error)`` of each that was to be written.

        ``documents`` is a result of ``convert`` or of ``sync``; rows without content
        are passed over. Other paths keep their files, or are gone if the documents
        are the ``whole`` tree. A document that cannot be written keeps its old file, if
        any. A run that ends before the commit leaves the old version as it was.
        """
        run = RunFolder(self.spark, "tree")
        last = self._commits.latest()
        name = f"v{1 if last is None else last[0] + 1}_{uuid.uuid4().hex}"
        given = run.keep(_published(documents), "documents")
        told = write_markdown_tree(given, f"{self.directory}/files/{name}")
        written = told.filter("error IS NULL").select("path").distinct()
        revisions = given.groupBy("path").agg(F.max(F.sha2("content", 256)).alias("revision"))
        file = F.concat(F.lit(f"{name}/"), F.ltrim("path", F.lit("/")))
        rows = written.join(revisions, "path").select("path", file.alias("file"), "revision")
        if last is not None:
            kept = self.manifest().join(written, "path", "left_anti")
            if whole:
                kept = kept.join(given.select("path"), "path", "left_semi")
            rows = rows.unionByName(kept)
        rows.write.parquet(f"{self.directory}/manifests/{name}")
        self._commits.commit(1 if last is None else last[0] + 1, name=name)
        return told

    def manifest(self) -> DataFrame:
        """``(path, file, revision)`` of the last version; ``revision`` is the SHA-256 of the file."""
        last = self._commits.latest()
        if last is None:
            return self.spark.createDataFrame([], self._MANIFEST)
        return self.spark.read.schema(self._MANIFEST).parquet(f"{self.directory}/manifests/{last[1]['name']}")

    def read(self) -> DataFrame:
        """``(path, content)`` of the last version, as ``sync`` takes it.

        Files are opened by their names in the manifest. Names and files that
        ``read_markdown_tree`` passes over are passed over.
        """
        file = F.col("file")
        # Names with line breaks never came back.
        seen = self.manifest().filter(file.rlike(_FILES) & file.rlike(r"\A.*\z"))
        found = existing(self.spark, f"{self.directory}/files")
        place = found[0][1] if found else ""
        return _texts(seen.select("path", F.lit(place).alias("place"), file.alias("name")), lost=True)
