"""Columns over clinical text and diagnosis codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shape of a diagnosis code, the code in running text, fields and patterns that name a patient,
#: words of diagnosis groups, and the code categories in scope.
CODE = r"\b([A-TV-Z][0-9]{2}(?:\.[0-9A-Za-z]{1,4})?)\b"
CODE_UPPER = r"\b([A-TV-Z][0-9]{2}(?:\.[0-9A-Z]{1,4})?)\b"
PATIENT_FIELDS = ["patient\\s*id", "patient\\s*identifier", "pid", "mrn", "uhid", "hospital\\s*id", "patient\\s*name", "name"]
COHORT_ID = r"TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}-\d{3}"
DOCUMENT_IDS = [r"(?i)Patient\s+ID[:\s]+([A-Z0-9\-]+)", r"(?i)MRN[:\s]+([0-9]+)", r"(?i)Subject\s+ID[:\s]+([A-Z0-9\-]+)"]
DIAGNOSIS_GROUPS = {
    "colon_cancer": r"\b(colon|colorectal|crc|adenocarcinoma)\b",
    "lung": r"\b(lung|pulmonary|bronchial)\b",
    "breast": r"\b(breast|mammary)\b",
    "prostate": r"\b(prostate)\b",
    "liver": r"\b(liver|hepatic|hepatocellular)\b",
    "pancreas": r"\b(pancreas|pancreatic)\b",
}
SCOPE = ["C18", "C19", "C20", "C25"]


def normalize_code(code: Column) -> Column:
    return F.coalesce(F.replace(F.upper(F.trim(code)), F.lit(" "), F.lit("")), F.lit(""))


def declared_codes(text: Column) -> Column:
    """Distinct codes in the text, upper case, sorted; none for a null text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + CODE), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, normalize_code)))


def explicit_codes(text: Column) -> Column:
    """Distinct codes of the upper-cased text in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(CODE_UPPER), F.lit(1)))


def mask_codes(text: Column, token: str = "[ICD_CODE]") -> Column:
    return F.regexp_replace(text, "(?i)" + CODE, token)


def category(code: Column) -> Column:
    return F.left(code, F.lit(3))


def same_category(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (category(a) == category(b)), F.lit(False))


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def patient_identifier(text: Column) -> Column:
    """The first non-empty identifier field of a note, at most 120 characters."""

    def field(name: str) -> Column:
        value = F.regexp_extract(text, rf"(?imd)^\s*{name}\s*[:\-]\s*([^\n\r]+)", 1)
        return F.nullif(F.left(F.regexp_replace(F.trim(value), r"\s+", " "), F.lit(120)), F.lit(""))

    return F.coalesce(*(field(n) for n in PATIENT_FIELDS))


def document_patient_id(text: Column) -> Column:
    return F.coalesce(_first(text, COHORT_ID, 0), *(_first(text, p, 1) for p in DOCUMENT_IDS))


def listed(*parts: tuple[Column, Column]) -> Column:
    """Array of the values whose condition holds, in order. An array without its nulls keeps a step of many
    such lists out of one generated method, which would be too long to be compiled to machine code."""
    return F.array_compact(F.array(*(F.when(condition, value) for condition, value in parts)))


def diagnosis_groups(text: Column) -> Column:
    return F.when(text.isNotNull(), listed(*((text.rlike("(?i)" + p), F.lit(k)) for k, p in DIAGNOSIS_GROUPS.items()))).otherwise(F.array().cast("array<string>"))


def in_scope(codes: Column) -> Column:
    return F.filter(codes, lambda c: category(c).isin(SCOPE))


def excerpt(text: Column, length: int = 1200) -> Column:
    return F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit(length))


def chosen_text(explicit: Column, document: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.nullif(F.trim(document), F.lit("")))


def description_text(description: Column, code: Column) -> Column:
    return F.concat(F.lit("Diagnosis: "), F.coalesce(F.nullif(description, F.lit("")), F.concat(F.lit("Diagnosis code "), code)), F.lit("."))


def multi_hot(labels: Column, label_list: Column) -> Column:
    return F.transform(label_list, lambda x: F.array_contains(labels, x).cast("int"))


def split_codes(cell: Column, sep: str = ";") -> Column:
    """Codes of a separated cell: trimmed, upper case, without empties; an empty list for a null cell."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), sep), lambda x: F.upper(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def extension_allowed(name: Column, allowed: list[str]) -> Column:
    return F.coalesce((F.instr(name, ".") > 0) & F.lower(F.substring_index(name, ".", -1)).isin(allowed), F.lit(False))


def mime_allowed(mime: Column, allowed: list[str]) -> Column:
    return F.coalesce(mime, F.lit("")).isin(["", *allowed])


def swap_suffix(path: Column, suffix: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", suffix)


def list_literal(text: Column) -> Column:
    """A list written as text, such as "['A', 'B']", as an array; null for unknown."""
    inner = F.regexp_replace(text, r"[\[\]'\" ]", "")
    return F.when(F.lower(text) != "unknown", F.filter(F.split(inner, ","), lambda x: x != ""))


def epoch_of(name: Column) -> Column:
    return F.regexp_extract(name, r"epoch_(\d+)", 1).try_cast("int")


def money(x: Column) -> Column:
    return F.format_number(x, 2)


def missing_safe(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))
