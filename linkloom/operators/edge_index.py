"""A stored link graph that many crawls share.

Cutting links out of all texts is most of a crawl's work, and few texts change between
crawls. The index keeps the links of every document with the revision its text had.
An update needs the texts of new and changed documents only, searches no others and
replaces their edges; a crawl with the index reads no text.

A version is a table of sources, ``(src, revision)``, and a table of edges, bucketed
by source. Both are written before the version is committed, so a crawl meanwhile,
or after an update that broke off, sees the version before.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.crawl import DOCUMENTS_PER_BUCKET
from linkloom.operators.links import document_links, link_sources
from linkloom.operators.storage import Commits, RunFolder

EDGES_SCHEMA = "src string, pos int, url string, dst string"
SOURCES_SCHEMA = "src string, revision string"


class EdgeIndex:
    """The link graph stored below ``path``, which all executors have to reach.

    One update runs at a time. Versions that are no longer wanted can be deleted
    once no crawl reads them.
    """

    def __init__(self, spark: SparkSession, path: str, documents_per_bucket: int = DOCUMENTS_PER_BUCKET):
        self.spark = spark
        self.path = path.rstrip("/")
        self.documents_per_bucket = documents_per_bucket
        self._commits = Commits(spark, self.path)
        self._shown: dict[str, str] = {}

    def update(self, files: DataFrame, contents: DataFrame) -> int:
        """Bring the index in step with a snapshot; the version that holds it.

        ``contents`` has the texts that belong to the revisions in ``files``; those of
        documents whose revision the index knows may be left out, so the texts
        landed since the last update are enough. Documents that are no longer there, or
        can no longer be read, lose their edges. If no revision has changed, no text
        is read, and if no document has gone either, the version stays.
        """
        run = RunFolder(self.spark, "edge_index")
        revision = F.coalesce("modified_time", F.lit("")).alias("revision")
        sources = files.join(link_sources(files), "file_id", "left_semi").select(F.col("file_id").alias("src"), revision)
        sources = run.keep(sources.distinct(), "sources")
        last = self._commits.latest()
        if last is None:
            return self._write(run, 1, sources, document_links(contents, files))
        version, facts = last
        known = self.sources()
        changed = run.keep(sources.join(known, ["src", "revision"], "left_anti").select("src").distinct(), "changed")
        gone = run.keep(known.join(sources, "src", "left_anti").select("src").distinct(), "gone")
        none_changed = changed.isEmpty()
        if none_changed and gone.isEmpty():
            return version
        edges = self.edges().join(changed.unionByName(gone), "src", "left_anti")
        if not none_changed:
            texts = contents.join(changed.withColumnRenamed("src", "file_id"), "file_id", "left_semi")
            edges = edges.unionByName(document_links(texts, files))
        return self._write(run, version + 1, sources, edges)

    def _write(self, run: RunFolder, version: int, sources: DataFrame, edges: DataFrame) -> int:
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(partitions, 1 + sources.count() // self.documents_per_bucket)
        folder = f"{self.path}/version_{version}_{uuid.uuid4().hex}"
        sources.write.parquet(f"{folder}/sources")
        name = f"{run.name}_edges"
        (
            edges.select("src", F.col("pos").cast("int").alias("pos"), "url", "dst")
            .repartition(buckets, "src")
            .write.option("path", f"{folder}/edges")
            .bucketBy(buckets, "src")
            .sortBy("src")
            .saveAsTable(name)
        )
        self.spark.sql(f"DROP TABLE {name}")
        self._commits.commit(version, folder=folder, buckets=str(buckets))
        return version

    def _latest(self) -> dict[str, str]:
        last = self._commits.latest()
        if last is None:
            raise ValueError(f"no edge index in {self.path}: update it first")
        return last[1]

    def sources(self) -> DataFrame:
        """``(src, revision)`` of every document whose links are in the index."""
        return self.spark.read.schema(SOURCES_SCHEMA).parquet(f"{self._latest()['folder']}/sources")

    def edges(self) -> DataFrame:
        """``(src, pos, url, dst)`` of the last version, bucketed by source.

        Buckets are known to Spark by a table in the session's catalog; ``close``
        drops these names.
        """
        facts = self._latest()
        folder = facts["folder"]
        if folder not in self._shown:
            name = f"edge_index_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {name} ({EDGES_SCHEMA}) USING parquet"
                f" CLUSTERED BY (src) SORTED BY (src) INTO {facts['buckets']} BUCKETS LOCATION '{folder}/edges'"
            )
            self._shown[folder] = name
        return self.spark.table(self._shown[folder])

    def close(self) -> None:
        """Drop the names from the session's catalog; the tables stay."""
        for name in self._shown.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._shown = {}
