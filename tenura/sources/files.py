"""Reading delivered files, writing gold, scores and predictions."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.functions.sizing import ensure_checkpoint_dir

DELIMITERS = (",", ";", "\t", "|")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: one evaluation, short lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_raw_text(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """CSV with every column as text and empty strings kept; a missing path is an error.

    Quotes inside a quoted value are doubled, and such a value may hold line breaks.
    """
    text = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("delimiter", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return text.na.fill("")


def scan_parquet_or_csv(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def _guess(head: list[bytes], utf8: bool) -> tuple[str, int]:
    """Delimiter that is commonest in the first lines, and the columns of the first one."""
    lines = [h.decode("utf-8" if utf8 else "latin-1").rstrip("\r") for h in head]
    times = {d: sum(line.count(d) for line in lines) for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: times[d])
    return (best, lines[0].count(best) + 1) if times[best] else ("inconnu", 1)


def _is_utf8(line: bytes) -> bool:
    try:
        line.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


class _FileDigest:
    """Running digest of one file from its lines. The line reader drops a byte order mark and the
    end of the last line; which of them the file has follows from its size."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.total, self.lines = path, size, 0, 0
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
        self.head: list[bytes] = []
        self.utf8 = True

    def add(self, line: bytes) -> None:
        if self.lines:
            self.plain.update(b"\n")
            self.marked.update(b"\n")
        self.plain.update(line)
        self.marked.update(line)
        self.total += len(line) + 1
        self.lines += 1
        self.utf8 = self.utf8 and _is_utf8(line)
        if len(self.head) < 5:
            self.head.append(line)

    def row(self) -> dict:
        digest = self.marked if self.size > self.total else self.plain
        if self.size - self.total in (0, 3):
            digest.update(b"\n")
        delimiter, columns = _guess(self.head, self.utf8)
        return {
            "chemin": self.path, "sha256": digest.hexdigest(), "encodage": "utf-8-sig" if self.utf8 else "latin-1",
            "separateur": delimiter, "nb_colonnes": columns, "nb_lignes": self.lines,
        }


DIGEST = "chemin string, sha256 string, encodage string, separateur string, nb_colonnes int, nb_lignes bigint"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by file and place; one file at a time, one line at a time."""
    now: _FileDigest | None = None
    for frame in batches:
        for path, size, value in zip(frame["chemin"], frame["taille"], frame["ligne"], strict=True):
            if now is None or now.path != path:
                if now is not None:
                    yield pd.DataFrame([now.row()])
                now = _FileDigest(path, int(size))
            now.add(bytes(value))
    if now is not None:
        yield pd.DataFrame([now.row()])


def source_manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per file: size, date, SHA-256, encoding, delimiter, columns, lines.

    A digest runs over a file from its first byte to its last. The splittable line reader feeds it:
    lines are dealt out by file and sorted by place (Spark spills that sort), then go through a task
    one by one, so a file of any size takes constant memory. Spark's readers pass over empty files.
    """
    listing = spark.read.format("binaryFile").load(list(paths)).select(
        F.col("path").alias("chemin"), F.col("length").alias("taille_octets"),
        F.col("modificationTime").alias("date_modification"),
    )
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        meta["file_path"].alias("chemin"), meta["file_size"].alias("taille"),
        meta["file_block_start"].alias("bloc"), F.monotonically_increasing_id().alias("rang"),
        F.col("value").cast("binary").alias("ligne"),
    )
    ordered = lines.repartition("chemin").sortWithinPartitions("chemin", "bloc", "rang")
    digest = ordered.select("chemin", "taille", "ligne").mapInPandas(_digests, DIGEST)
    # the listing writes file:/..., the reader file:///...
    key = lambda df: df.withColumn("_k", F.regexp_replace("chemin", "^file:/+", "file:/"))
    return key(listing).join(key(digest).drop("chemin"), "_k", "left").drop("_k")


def write_gold(
    df: DataFrame,
    path: str,
    sources: DataFrame | None = None,
    simulated: Sequence[str] = (),
    n_raw: int | None = None,
    note: str = "",
) -> DataFrame:
    """Write the gold table and a one-row JSON metadata table next to it.

    `n_raw` is the number of delivered rows; what the table has less was removed as copies.
    `sources` is a manifest (chemin, sha256) of the delivered files, written as a table of its own.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    meta = written.agg(F.count("*").alias("nb_lignes")).select(
        "nb_lignes",
        F.lit(len(df.columns)).alias("nb_colonnes"),
        F.array(*[F.lit(c) for c in df.columns]).alias("colonnes"),
        F.array(*[F.lit(c) for c in simulated]).cast("array<string>").alias("colonnes_simulees"),
        (F.lit(n_raw) - F.col("nb_lignes")).alias("doublons_supprimes"),
        F.lit(note).alias("note"),
    )
    if sources is not None:  # as many rows as files, so they stay rows
        sources.select("chemin", "sha256", "taille_octets").write.mode("overwrite").json(f"{path}_sources")
    meta.write.mode("overwrite").json(f"{path}_metadata")
    return spark.read.json(f"{path}_metadata")


def published_dates(spark: SparkSession, path: str) -> list[str]:
    """Dates that have a partition; read from the folder listing, not from the data."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("date_ref="))


def publish_scores(
    scores: DataFrame, path: str, date_ref: str, force: bool = False, summary: DataFrame | None = None
) -> bool:
    """Write one date partition; an existing date is left alone unless forced."""
    spark = scores.sparkSession
    if date_ref in published_dates(spark, path) and not force:
        return False
    (
        scores.withColumn("date_ref", F.lit(date_ref))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date_ref")
        .parquet(path)
    )
    if summary is not None:
        (
            summary.withColumn("date_ref", F.lit(date_ref))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date_ref")
            .json(f"{path}_synthese")
        )
    return True


def write_predictions_csv(
    df: DataFrame, path: str, threshold: float, key: str = "id", score: str = "p"
) -> DataFrame:
    """id, probability (4 decimals), decision, threshold, as CSV with a header."""
    out = df.select(
        key,
        F.bround(score, 4).alias("probabilite_churn"),
        (F.col(score) >= threshold).cast("int").alias("decision"),
        F.lit(float(threshold)).alias("seuil"),
    )
    out.write.mode("overwrite").option("header", True).csv(path)
    return scan_parquet_or_csv(df.sparkSession, path) if path.endswith(".csv") else out
