"""Readers and writers of the engine's tables: CSV, gz, JSON lines, label maps, hash tables, images, reports, models."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkverity.functions.hashing import bits_to_hex, hash_bits, let

CLAIMS = (
    "claim_id bigint, patient_id string, clinical_text string, claim_amount double, previous_claim_count int, img_patient_id string, "
    "img_modality string, img_study_desc string, cnn_score double, ela_score double, phash_score double, claim_ts timestamp"
)
FRAUD_TRAINING = (
    "icd_match_score double, cnn_forgery_score double, ela_score double, phash_score double, final_image_forgery_score double, claim_amount double, previous_claim_count double, fraud int"
)
#: Different lengths of picture sides, added up, whose matrices are broadcast (8 numbers each).
SENT_SIDES = 200_000
#: What cosines are rounded to. No cosine of the 32 places is within 0.018 of a unit of where rounding turns, so its last bits don't matter.
COSINE_UNIT = 2.0**-40
#: Coefficients of doubles are nearer than this to the exact ones by far (under 2^-32 grey levels of up to 16,320).
NEAR = 2.0**-20
PICTURES = "*.{png,jpg,jpeg,PNG,JPG,JPEG}"
NOTES = "note_id bigint, subject_id string, hadm_id bigint, note_type string, text string, labels array<string>"


def columns(schema: str) -> list[str]:
    """The column names of a schema of plain types."""
    return [part.split()[0] for part in schema.split(", ")]


def read_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV with header, every column a string."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=False, quote='"', escape='"')


def read_gz(spark: SparkSession, path: str, partitions: int = 64) -> DataFrame:
    """A gz CSV: one task a file reads it, so it is dealt out at once."""
    return read_strings(spark, path).repartition(partitions)


def write_table(df: DataFrame, path: str, *, compression: str = "none") -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression).csv(path)


def diagnosis_rows(spark: SparkSession, path: str) -> DataFrame:
    """code, description and row_ord of a diagnosis dictionary; the short description where there is one."""
    rows = read_strings(spark, path)
    description = next((c for c in ("ShortDescription", "LongDescription") if c in rows.columns), None)
    text = F.col(description) if description else F.lit(None).cast("string")
    return rows.select(F.col("Code").alias("code"), text.alias("description"), F.monotonically_increasing_id().alias("row_ord"))


def text_codes(spark: SparkSession, path: str, text: str = "text", codes: str = "icd_codes", sep: str = ";") -> DataFrame:
    from sparkverity.functions.text import split_codes

    rows = read_strings(spark, path).select(F.trim(text).alias("text"), split_codes(F.col(codes), sep).alias("codes"))
    return rows.where("text <> ''")


def read_lines(spark: SparkSession, path: str, schema: str = NOTES) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_label_map(labels: DataFrame, path: str) -> None:
    """(label, idx) rows; one small file."""
    labels.select("label", "idx").orderBy("idx").coalesce(1).write.mode("overwrite").json(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(label, idx) rows, or a list of labels one per line in order, by idx."""
    rows = spark.read.json(path)
    if "idx" in rows.columns:
        return rows.select("label", F.col("idx").cast("int").alias("idx")).orderBy("idx")
    listed = spark.read.text(path).select(F.from_json("value", "array<string>").alias("l"))
    return listed.select(F.posexplode("l").alias("idx", "label")).select("label", "idx").orderBy("idx")


def write_hashes(df: DataFrame, path: str) -> None:
    write_table(df.select("filename", "phash_hex"), path)


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """filename, phash_hex; the column may also be called phash."""
    rows = read_strings(spark, path)
    name = next(c for c in ("phash_hex", "phash") if c in rows.columns)
    return rows.select("filename", F.col(name).alias("phash_hex"))


def _pictures(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PICTURES).load(folder)
    base = folder.rstrip("/").removeprefix("file://")
    return rows.withColumn("path", F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), rf"^.*?{base}/", ""))


def image_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths (below the folder), sizes and times of its pictures, at any depth: a scan of the directory that opens no file.
    Empty files are not listed."""
    return _pictures(spark, folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths (below the folder) and sizes of its pictures, at any depth; contents are read only where asked for."""
    return _pictures(spark, folder).select("path", F.col("length").alias("bytes"), "content")


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row (path below the folder, content: binary) as a file of the store the folder is in; how many.
    A task that runs again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                store.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    rows = read_strings(spark, path)
    return rows.withColumn("Subject ID", F.trim("Subject ID")) if "Subject ID" in rows.columns else rows


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims as a JSON list or as JSON lines."""
    return spark.read.schema(CLAIMS).option("multiLine", True).json(path)


def write_reports(verified: DataFrame, path: str) -> None:
    """A JSON report per claim, in folders by recommendation."""
    sections = [c for c in ("icd", "image", "identity", "features", "fraud", "verdict") if c in verified.columns]
    report = F.to_json(F.struct("claim_id", *sections))
    verified.select(F.col("verdict.recommendation").alias("recommendation"), report.alias("value")).write.mode("overwrite").partitionBy("recommendation").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAUD_TRAINING).csv(path, header=True)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_trees(trees: DataFrame, path: str) -> None:
    """A model of trees as rows; one small file."""
    trees.coalesce(1).write.mode("overwrite").json(path)


def load_trees(spark: SparkSession, path: str) -> DataFrame:
    from sparkverity.operators.models import TREES

    return spark.read.schema(TREES).json(path)


def resize_cosines(n: Column, size: int = 32, keep: int = 8) -> Column:
    """keep rows of n whole numbers: the lowest cosines over size places, seen through bilinear reduction from n pixels.

    They count COSINE_UNIT / (2 * size). Cosines are rounded to COSINE_UNIT in the first quarter turn, the others are
    their mirror images, and weights are whole numbers of 1 / (2 * size), so all that is equal or zero by symmetry is so here.
    """
    n = n.cast("bigint")

    def weight(k: Column, i: Column) -> Column:
        at = F.greatest(F.lit(0), F.least(2 * size * (n - 1), (2 * k + 1) * n - size))
        return F.greatest(F.lit(0), 2 * size - F.abs(at - 2 * size * i))

    def cosine(u: Column, k: Column) -> Column:
        scale = F.when(u == 0, math.sqrt(1 / size)).otherwise(math.sqrt(2 / size))
        turn = (2 * k + 1) * u % (4 * size)
        half = F.least(turn, 4 * size - turn)
        quarter = F.rint(scale * F.cos(math.pi * F.least(half, 2 * size - half) / (2 * size)) / COSINE_UNIT).cast("bigint")
        return F.when(half > size, -quarter).otherwise(quarter)

    def number(u: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("bigint"), lambda s, k: s + cosine(u, k) * weight(k, i))

    return F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda u: F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: number(u, i)))


def _dot(kind: str, a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0).cast(kind), lambda s, v: (s + v).cast(kind))


def _transformed(pictures: DataFrame, size: int = 32, keep: int = 8) -> DataFrame:
    """Grey pictures (path, width, height, grey: binary) along their height: path, their keep rows (_t) and the matrix of the width (_b).

    Bilinear reduction to size x size and the cosine transform are both linear, so the coefficients are
    A P B' with one matrix for the height and one for the width: a table with a row per different length of
    a side, joined to the pictures. Unreadable pictures (no pixels, or another number of them) are left out.
    All are whole numbers (resize_cosines), which fit for sizes up to 512.
    """
    fit = pictures.where((F.col("width") > 0) & (F.col("height") > 0) & (F.length("grey") == F.col("width").cast("long") * F.col("height")))
    sides = fit.select(F.explode(F.array("width", "height")).alias("n")).distinct()
    sides = sides.select("n", resize_cosines(F.col("n"), size, keep).alias("m"))
    found = sides.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # numbers a matrix row; few sizes are sent to all tasks
    sides = F.broadcast(sides) if found <= SENT_SIDES else sides.hint("merge")
    places = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    byte = lambda grey, i: F.conv(F.hex(F.substring(grey, i + 1, F.lit(1))), 16, 10).cast("bigint")
    columns = lambda grey: F.transform(places("width"), lambda x: F.transform(places("height"), lambda y: byte(grey, y * F.col("width") + x)))
    rows = fit.withColumn("_columns", let(F.col("grey"), columns))  # grey may be an expression: worked out once
    rows = rows.join(sides.select(F.col("n").alias("height"), F.col("m").alias("_a")), "height").join(sides.select(F.col("n").alias("width"), F.col("m").alias("_b")), "width")
    return rows.select("path", "_b", F.transform("_a", lambda a: F.transform("_columns", lambda p: _dot("bigint", a, p))).alias("_t"))


def _products(number: str, total: str) -> Column:
    """The coefficients of _transformed, row by row; in whole numbers they are exact and their order doesn't matter."""
    down, across = F.col("_t").cast(f"array<array<{number}>>"), F.col("_b").cast(f"array<array<{number}>>")
    return F.flatten(let(across, lambda m: F.transform(down, lambda t: F.transform(m, lambda b: _dot(total, t, b)))))


def coefficients(pictures: DataFrame, size: int = 32, keep: int = 8) -> DataFrame:
    """path and the lowest keep x keep cosine coefficients of grey pictures (path, width, height, grey: binary), in grey levels."""
    unit = (COSINE_UNIT / (2 * size)) ** 2
    return _transformed(pictures, size, keep).select("path", F.transform(_products("double", "double"), lambda x: x * unit).alias("coefficients"))


def hash_table(pictures: DataFrame) -> DataFrame:
    """filename and phash_hex of grey pictures: a bit is 1 if its coefficient is above the median; what equals it isn't.

    Doubles tell unless the two middle coefficients are near each other; then whole numbers do. They have 32
    digits, which leave room for the half of a median.
    """
    exact = hash_bits(_products("decimal(20,0)", "decimal(38,0)").cast("array<decimal(32,0)>"))
    far = lambda s: F.element_at(s, 33) - F.element_at(s, 32) > NEAR / (COSINE_UNIT / 64) ** 2
    bits = lambda found: F.when(let(F.sort_array(found), far), hash_bits(found)).otherwise(exact)
    return _transformed(pictures).select(F.col("path").alias("filename"), bits_to_hex(let(_products("double", "double"), bits)).alias("phash_hex"))
