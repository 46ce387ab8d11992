"""Watching a folder: files whose size stayed the same between two polls are converted, in micro-batches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

ENDINGS = (".pdf", ".docx", ".xlsx")


def sizes_of(folder: str) -> dict[str, int]:
    found = {}
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if name.endswith(ENDINGS) and not name.startswith("~$"):
            try:
                found[name] = os.path.getsize(os.path.join(folder, name))
            except OSError:  # gone meanwhile
                continue
    return found


class StableFiles(DataSource):
    """Source `stable_files`: (name, size) of a folder's files, each once its size is positive and the same as at the last poll."""

    @classmethod
    def name(cls) -> str:
        return "stable_files"

    def schema(self) -> str:
        return "name string, size long"

    def simpleStreamReader(self, schema):
        return StableReader(self.options["path"])


class StableReader(SimpleDataSourceStreamReader):
    """The offset has what a poll saw (waiting: name and size) and which files it gave out (done, until they change or go)."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"waiting": {}, "done": {}}

    def read(self, start: dict):
        now = sizes_of(self.folder)
        kept = {n: s for n, s in start["done"].items() if now.get(n) == s}
        ready = {n: s for n, s in now.items() if s > 0 and start["waiting"].get(n) == s and n not in kept}
        return iter(sorted(ready.items())), {"waiting": {n: s for n, s in now.items() if n not in ready and n not in kept}, "done": kept | ready}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(sorted((n, s) for n, s in end["done"].items() if start["done"].get(n) != s))


def unique(folder: str, name: str) -> str:
    """A free path for name in the folder: name, then stem_1, stem_2 and so on."""
    stem, ending = os.path.splitext(name)
    path, k = os.path.join(folder, name), 0
    while os.path.exists(path):
        k += 1
        path = os.path.join(folder, f"{stem}_{k}{ending}")
    return path


def converted(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Documents of the named files, read by Spark."""
    from plumaria.sources.office import office_documents

    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    files = spark.read.format("binaryFile").load(folder).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return office_documents(files.join(F.broadcast(wanted), "name", "left_semi"))


def stable_sizes(polls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of observations (keys, order, size) those that StableReader would call ready, were each a poll: a positive size, the same as at the poll before."""
    before = F.lag("size").over(Window.partitionBy(*keys).orderBy(*order))
    return polls.withColumn("before", before).where((F.col("size") > 0) & (F.col("size") == F.col("before"))).drop("before")


def to_vault(spark: SparkSession, notes: str, config) -> None:
    """Publishes a folder's notes into the vault of a config.Config, organises it, and relates it if the settings say so."""
    from plumaria.plans import vault as P
    from plumaria.sources import lexicon

    title = config.vault_subdir or None
    P.publish_folder(spark, notes, config.notes_dir, (config.vault_tag,) if config.vault_tag else (), True, title)
    P.organise_vault(spark, config.notes_dir, title)
    if config.auto_relate:
        P.relate_vault(spark, config.notes_dir, lexicon.load(spark, config.relate_lexicon), config.settings())


def watch(spark: SparkSession, folder: str, notes: str, archive: str, errors: str, checkpoint: str, every: str = "3 seconds", overwrite: bool = False, vault=None):
    """Starts the query: convert, write notes and warnings, then publish, organise and relate where a vault is set (a config.Config), and move sources to the archive or the errors folder. Stop it with .stop().

    A batch that runs again finds its moved files gone and its notes the same, so nothing is done twice. What fails in the vault does not undo a conversion.
    Relating reads cached profiles and weighs the whole vault again, as one new note changes every weight.
    """
    from plumaria.operators.layout import office_metadata
    from plumaria.sinks.vault import convert

    spark.dataSource.register(StableFiles)

    def act(batch: DataFrame, _: int) -> None:
        names = [r["name"] for r in batch.collect() if os.path.exists(os.path.join(folder, r["name"]))]  # the files of one poll
        if not names:
            return
        docs = office_metadata(converted(batch.sparkSession, folder, names)).persist()
        convert(docs, notes, errors, overwrite)
        if vault is not None and docs.where("status = 'ok'").count():
            try:
                to_vault(batch.sparkSession, notes, vault)
            except Exception as e:  # the notes are written already
                print(f"vault: {type(e).__name__}: {e}")
        for r in docs.select("source", "status").collect():
            to = archive if r["status"] == "ok" else errors
            os.makedirs(to, exist_ok=True)
            os.replace(os.path.join(folder, r["source"]), unique(to, r["source"]))
        docs.unpersist()

    rows = spark.readStream.format("stable_files").option("path", folder).load()
    return rows.writeStream.foreachBatch(act).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()
