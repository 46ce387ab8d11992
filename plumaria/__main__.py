"""python -m plumaria convert | publish | organise | relate | watch, with settings from a YAML file and flags."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from plumaria.config import Config


def convert(spark: SparkSession, c: Config) -> dict:
    """Converts the documents of a folder whose notes are not there yet (or all, to overwrite); counts by status."""
    import os

    from pyspark.sql import functions as F

    from plumaria.operators.layout import office_metadata
    from plumaria.sinks import vault as V
    from plumaria.sources.office import list_files, office_documents

    files = list_files(spark, c.input_dir, c.recursive).withColumn("name", F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*)\.\w+$", 1))
    there = spark.createDataFrame([(f.removesuffix(".md"),) for f in (os.listdir(c.output_dir) if os.path.isdir(c.output_dir) else []) if f.endswith(".md")], "name string")
    todo = V.unpublished(files, there).where(F.lit(c.overwrite) | (F.col("status") == "ok"))  # skipped before anything of them is read
    found = office_metadata(office_documents(todo.drop("status", "name")), c.language).persist()
    counts = V.convert(found, c.output_dir, c.errors_dir, c.overwrite, lambda status, name, detail: print(status, name, detail))
    skipped = 0 if c.overwrite else V.unpublished(files, there).where("status = 'skip'").count()
    found.unpersist()
    return counts | {"skip": counts.get("skip", 0) + skipped}


def run(spark: SparkSession, command: str, c: Config) -> dict:
    from plumaria.plans import vault as P
    from plumaria.sources import lexicon

    if command == "convert":
        return convert(spark, c)
    if command == "publish":
        return P.publish_folder(spark, c.output_dir, c.notes_dir, (c.vault_tag,) if c.vault_tag else (), c.overwrite, c.vault_subdir or None)
    if command == "organise":
        return P.organise_vault(spark, c.notes_dir, c.vault_subdir or None)
    if command == "relate":
        return P.relate_vault(spark, c.notes_dir, lexicon.load(spark, c.relate_lexicon), c.settings())
    raise ValueError(command)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="plumaria", description=__doc__)
    p.add_argument("command", choices=("convert", "publish", "organise", "relate", "watch"))
    p.add_argument("--config", default="config.yaml")
    p.add_argument("--input", dest="input_dir")
    p.add_argument("--output", dest="output_dir")
    p.add_argument("--errors", dest="errors_dir")
    p.add_argument("--vault", dest="vault_dir")
    p.add_argument("--subdir", dest="vault_subdir")
    p.add_argument("--tag", dest="vault_tag")
    p.add_argument("--lexicon", dest="relate_lexicon")
    p.add_argument("--threshold", dest="relate_threshold", type=float)
    p.add_argument("--top-k", dest="relate_top_k", type=int)
    p.add_argument("--recursive", action="store_true", default=None)
    p.add_argument("--overwrite", action="store_true", default=None)
    p.add_argument("--interval", default="3 seconds")
    a = vars(p.parse_args(argv))
    command, interval = a.pop("command"), a.pop("interval")
    c = Config.load(a.pop("config"))
    for name, value in a.items():
        if value is not None:
            setattr(c, name, value)
    if command in ("publish", "organise", "relate") and not c.notes_dir:
        p.error("--vault is needed")
    spark = SparkSession.builder.appName("plumaria").getOrCreate()
    if command == "watch":
        from plumaria.streaming.watch import watch

        watch(spark, c.watch_dir, c.output_dir, c.processed_dir, c.errors_dir, f"{c.errors_dir}/_state", interval, c.overwrite, c if c.vault_dir else None).awaitTermination()
    else:
        print(json.dumps(run(spark, command, c), ensure_ascii=False))


if __name__ == "__main__":
    main()
