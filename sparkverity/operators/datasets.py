"""Building labelled data sets from clinical tables and image metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkverity.functions import text as T
from sparkverity.operators.ranking import hash_rank, running_sums

BROADCAST_CLASSES = 100_000
HEADER_TAGS = ["patientid", "studydate", "modality", "studydescription", "seriesdescription", "bodypartexamined", "manufacturer", "imagetype", "pixelspacing", "seriesinstanceuid"]


def diagnosis_dictionary(rows: DataFrame) -> DataFrame:
    """code, description; the last row (by row_ord, then by description) of a code wins, a null description is empty."""
    clean = rows.select(F.upper(F.trim("code")).alias("code"), F.coalesce("description", F.lit("")).alias("description"), "row_ord")
    return clean.groupBy("code").agg(F.max_by("description", F.when(F.col("row_ord").isNotNull(), F.struct("row_ord", "description"))).alias("description"))


def code_column(df: DataFrame) -> str:
    """Which of the known code columns this table has."""
    return next(c for c in ("icd_code", "icd9_code") if c in df.columns)


def _codes(diagnoses: DataFrame) -> DataFrame:
    code = T.normalize_code(F.col(code_column(diagnoses)))
    return diagnoses.select("hadm_id", code.alias("code")).where("hadm_id IS NOT NULL AND code <> ''")


def code_counts(diagnoses: DataFrame, min_count: int = 1) -> DataFrame:
    return _codes(diagnoses).groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def codes_by_admission(diagnoses: DataFrame) -> DataFrame:
    return _codes(diagnoses).groupBy("hadm_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def most_frequent(counts: DataFrame, k: int, min_count: int = 1) -> DataFrame:
    """The k commonest codes, ties by code."""
    return counts.where(F.col("n") >= min_count).orderBy(F.desc("n"), "code").limit(k)


def label_index(counts: DataFrame) -> DataFrame:
    """Dense index from 0 by frequency; a label list is small, so one window holds it."""
    return counts.select((F.row_number().over(Window.orderBy(F.desc("n"), "code")) - 1).alias("idx"), F.col("code").alias("label"), "n")


def label_counts(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("labels").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def kept_notes(notes: DataFrame, types: list[str] | None) -> DataFrame:
    """Notes of the wanted types, where the table has types at all."""
    return notes.where(F.col("note_type").isin(types)) if types and "note_type" in notes.columns else notes


def labelled_notes(notes: DataFrame, diagnoses: DataFrame, *, top_k: int = 200, min_count: int = 25, note_types: list[str] | None = None) -> DataFrame:
    """Notes with an admission that has at least one of the commonest codes; codes in the text are masked."""
    top = most_frequent(code_counts(diagnoses), top_k, min_count).select("code")
    labels = _codes(diagnoses).join(F.broadcast(top), "code").groupBy("hadm_id").agg(F.array_sort(F.collect_set("code")).alias("labels"))
    kept = kept_notes(notes, ["DS"] if note_types is None else note_types).where("hadm_id IS NOT NULL")
    return kept.join(labels.hint("merge"), "hadm_id").withColumn("text", T.mask_codes(F.col("text")))


def indexed(notes: DataFrame, label_list: list[str]) -> DataFrame:
    """label_indices of each note; labels outside the list are dropped, and notes left without any."""
    where = F.create_map(*(x for k, label in enumerate(label_list) for x in (F.lit(label), F.lit(k)))) if label_list else F.lit(None).cast("map<string,int>")
    known = F.filter("labels", lambda c: F.array_contains(F.lit(label_list), c))
    return notes.withColumn("label_indices", F.transform(known, lambda c: F.element_at(where, c))).where(F.size("label_indices") > 0)


def in_label_list(notes: DataFrame, label_list: list[str]) -> DataFrame:
    return notes.withColumn("labels", F.array_sort(F.array_intersect("labels", F.lit(label_list)))).where(F.size("labels") > 0)


def subject_split(notes: DataFrame, *, val_frac: float = 0.1, seed: int = 42) -> DataFrame:
    """split per subject, at least one in val; no subject on both sides."""
    ranked = hash_rank(notes.select("subject_id").where("subject_id IS NOT NULL").distinct(), "subject_id", seed)
    n_val = F.greatest(F.lit(1), F.floor(F.col("_total") * val_frac))
    return ranked.select("subject_id", F.when(F.col("_rank") <= n_val, "val").otherwise("train").alias("split"))


def split(df: DataFrame, key: str, ratio: float, *, by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """split column: the first floor(n ratio) of each class, in seeded order, are val."""
    ranked = hash_rank(df, key, seed, by)
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_total") * ratio), "val").otherwise("train")).drop("_rank", "_total")


def sample(df: DataFrame, key: str, n: int, *, seed: int = 42) -> DataFrame:
    return hash_rank(df, key, seed).where(F.col("_rank") <= n).drop("_rank", "_total")


def balanced(df: DataFrame, key: str, is_reference: Column, ratio: float = 1.0, *, seed: int = 42) -> DataFrame:
    """All reference rows, and as many of the others as ratio times their number."""
    marked = df.withColumn("_ref", is_reference)
    target = int(marked.where("_ref").count() * ratio)
    return marked.where("_ref").drop("_ref").unionByName(sample(marked.where("NOT _ref").drop("_ref"), key, target, seed=seed))


def described_examples(diagnoses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct (text, code) from the description of each code."""
    rows = _codes(diagnoses).join(dictionary.hint("merge"), "code", "left")
    return rows.select(T.description_text(F.col("description"), F.col("code")).alias("text"), "code").dropDuplicates(["text", "code"])


def image_headers(rows: DataFrame) -> DataFrame:
    """Header tags trimmed, Unknown where missing; the first two parts of the path as folders."""
    tags = [c for c in rows.columns if c in HEADER_TAGS]
    parts = F.split("file_path", "/")
    deep = F.size(parts) >= 2
    return rows.select(
        *(c for c in rows.columns if c not in tags), *(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unknown")).alias(c) for c in tags),
        F.when(deep, parts[0]).alias("patient_folder"), F.when(deep, parts[1]).alias("study_folder"),
    )


def with_metadata(headers: DataFrame, meta: DataFrame) -> DataFrame:
    """Headers left-joined on series if both sides have one, else on patient; metadata_matched tells the hits."""
    if "series_uid" in meta.columns and "seriesinstanceuid" in headers.columns:
        left, right = "seriesinstanceuid", "series_uid"
    elif "subject_id" in meta.columns:
        left, right = "patientid", "subject_id"
    else:
        return headers.withColumn("metadata_matched", F.lit(False))
    return headers.join(meta, headers[left] == meta[right], "left").withColumn("metadata_matched", meta[right].isNotNull())


def patient_profile(headers: DataFrame) -> DataFrame:
    sets = [c for c in ("modality", "studydescription", "studydate") if c in headers.columns]
    return headers.groupBy("patientid").agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in sets))


def image_dataset(headers: DataFrame, existing: DataFrame, root: str = "jpeg") -> DataFrame:
    """Headers whose picture exists, with its path, image types and localizer flag."""
    out = headers.withColumn("jpeg_path", F.concat(F.lit(f"{root}/"), T.swap_suffix(F.col("file_path"), ".jpg")))
    types = T.list_literal(F.col("imagetype"))
    return out.join(existing, "jpeg_path", "left_semi").withColumn("image_types", types).withColumn("is_localizer", F.coalesce(F.array_contains(types, "LOCALIZER"), F.lit(False)))


def authenticity(cls: Column) -> Column:
    return F.when(cls.isin("colon_aca", "colon_n", "lung_aca", "lung_n", "lung_scc"), "authentic").when(F.contains(cls, F.lit("forge")), "tampered")


def class_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def class_index(df: DataFrame, path: str = "file_path") -> DataFrame:
    """Class by folder, numbered by sorted name; up to BROADCAST_CLASSES names (counted) are sorted in one task
    and go to all, more are numbered by ranges of names."""
    names = df.select(class_of(F.col(path)).alias("class")).where("class IS NOT NULL").distinct()
    few = names.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    if few:
        names = names.withColumn("class_index", F.row_number().over(Window.orderBy("class")) - 1)
    else:
        after = running_sums(names.withColumn("_one", F.lit(1)), "class", ["_one"])
        names = after.select("class", (F.lit(names.count()) - F.col("cum__one")).cast("int").alias("class_index"))
    return df.withColumn("class", class_of(F.col(path))).join(F.broadcast(names) if few else names.hint("merge"), "class")


def first_rows(df: DataFrame, n: int, *order: str, by: list[str] | None = None) -> DataFrame:
    """The first n rows, or the first n of each group, in an explicit order."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def text_profile(df: DataFrame, key: str, keywords: list[str], *, n: int = 5, rows: int = 200, length: int = 400) -> DataFrame:
    """Up to n non-empty samples of each column whose name holds a keyword, from the first rows."""
    wanted = [c for c in df.columns if any(k in c.lower() for k in keywords)]
    few = df.orderBy(key).limit(rows).select(key, *wanted)
    long = few.unpivot([key], wanted, "column_name", "value").where("value IS NOT NULL AND trim(value) <> ''")
    return first_rows(long, n, key, by=["column_name"]).select("column_name", key, F.left("value", F.lit(length)).alias("sample"))
