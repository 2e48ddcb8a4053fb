"""Tables by name, their schemas and counts, and change sets (survey group SRC)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_counts(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """A row for each table with its number of rows."""
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in names]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def changed(df: DataFrame, key: str, updates: DataFrame, deletes: DataFrame) -> DataFrame:
    """df without the deleted and updated keys, with the updated or new rows."""
    gone = updates.select(key).unionByName(deletes.select(key)).distinct()
    return df.join(gone, key, "left_anti").unionByName(updates)


def table_list(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Name, rows and bytes of each table; the bytes are those of its files that have rows."""
    out = None
    for name in names:
        files = table(spark, sf_dir, name).groupBy("_metadata.file_path").agg(F.max("_metadata.file_size").alias("size"), F.count("*").alias("n"))
        one = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).select(F.lit(name).alias("name"), "n_rows", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def lexicon(rows: DataFrame, column: str) -> DataFrame:
    """category and word of JSON objects of categories with lists of words."""
    words = rows.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("category", "words"))
    return words.select("category", F.explode("words").alias("word"))


def aliased(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns under their canonical names, found by name or alias with letter case and outer spaces ignored; of several for
    one name the first stays, others go, as do columns of no name."""
    chosen: dict[str, str] = {}
    for column in df.columns:
        plain = column.strip().lower()
        for name, others in names.items():
            if plain in {name.lower(), *(o.lower() for o in others)}:
                chosen.setdefault(name, column)
    return df.select(*(df[f"`{c}`"].alias(n) for n, c in chosen.items()))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a local one where none is set, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/lexigrid-exports"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Both sides of a csv file, so that any text comes back: quotes around every text tell an empty one from null, quotes inside
#: are doubled, and line ends and outer spaces stay.
CSV = {"header": "true", "quoteAll": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n"}


def csv_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of csv files as export() writes them. A field may go over many lines, so a file is read by one task."""
    return spark.read.schema(schema).options(**CSV | {"multiLine": "true"}).csv(path)


def export(df: DataFrame, kind: str, path: str | None = None, bom: bool = False) -> str:
    """Writes csv (with a header; null is \\N, and a text \\N isn't told from it), json or parquet; bom: csv files begin with a
    byte order mark. Gives the path."""
    path = path or shared_path(df.sparkSession, f"export-{kind}")
    if kind == "csv":
        head = [F.col(c).alias(("\ufeff" if bom and k == 0 else "") + c) for k, c in enumerate(df.columns)]
        # Quotes around the first name would come before the mark; without them, texts are quoted where they need it.
        df.select(*head).write.options(**CSV | ({"quoteAll": "false", "emptyValue": '""'} if bom else {})).csv(path)
    elif kind == "json":
        df.write.json(path)
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"{kind} isn't one of csv, json, parquet")
    return path


class Rounds:
    """Tables of iterations in the shared folder: each name holds the last one written, and the one before is deleted, so a loop
    leaves one table a name behind. close() deletes those too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """df as a table that is read back: cuts lineage, and survives lost executors."""
        path = shared_path(self.spark, name)
        df.write.options(**options).parquet(path)
        self._delete(self.paths.get(name))
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self.paths.values():
            self._delete(path)
        self.paths = {}

    def _delete(self, name: str | None) -> None:
        if name:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
