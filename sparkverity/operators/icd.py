"""Scoring declared diagnosis codes against predicted ones, and a keyword predictor."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkverity.functions import text as T
from sparkverity.functions.hashing import let
from sparkverity.operators.balls import most_similar

#: Fixed values of the keyword predictor: keyword, code, probability, in table order.
KEYWORDS = [
    ("hypertension", "I10", 0.89), ("hypertension", "I11.9", 0.52),
    ("diabetes", "E11.9", 0.85), ("diabetes", "E11.65", 0.71), ("diabetes", "E10.9", 0.38),
    ("cancer", "C50.9", 0.92), ("cancer", "C79.9", 0.48),
    ("pneumonia", "J18.9", 0.87), ("pneumonia", "J15.9", 0.61),
    ("copd", "J44.9", 0.91), ("copd", "J44.0", 0.54),
    ("asthma", "J45.9", 0.88), ("asthma", "J45.0", 0.43),
    ("covid", "U07.1", 0.94), ("covid", "J12.8", 0.39),
    ("fracture", "S72.9", 0.86), ("fracture", "S82.9", 0.47),
    ("heart", "I25.9", 0.82), ("heart", "I21.9", 0.56),
    ("stroke", "I63.9", 0.90), ("stroke", "I64", 0.44),
]
FALLBACK = [("Z00.0", 0.42), ("R50.9", 0.35), ("R10.9", 0.28)]


_PAIRS = "array<struct<code:string,prob:double>>"

#: What a model of the caller's does with a batch of texts: for each the codes with their probabilities, in order.
TextPredictor = Callable[[list[str]], list[list[tuple[str, float]] | dict[str, float]]]


def predicted_by(docs: DataFrame, load: Callable[[], TextPredictor], key: str = "doc_id") -> DataFrame:
    """key, rank (from 1), code and prob of texts (key, text) by a model of the caller's: load() is called once a
    task and returns a function from a batch of texts to their predictions. A null text is the empty one; a
    probability that is missing is 0; a text without predictions gives no row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = load()
        for batch in batches:
            found = predict([t or "" for t in batch.column("text").to_pylist()])
            rows = [(at, rank, code, float(p or 0.0)) for at, own in enumerate(found) for rank, (code, p) in enumerate(own.items() if isinstance(own, dict) else own, 1)]
            at, rank, codes, probs = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array(codes, pa.string()), pa.array(probs, pa.float64())], names=[key, "rank", "code", "prob"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, rank int, code string, prob double")


def keyword_predictor() -> TextPredictor:
    """The keyword predictor as such a model."""

    def predict(texts: list[str]) -> list[list[tuple[str, float]]]:
        return [[(code, p) for word, code, p in KEYWORDS if word in low] or FALLBACK for low in map(str.lower, texts)]

    return predict


WORDS = list(dict.fromkeys(word for word, _, _ in KEYWORDS))


def keyword_predictions(text: Column) -> Column:
    """Array of (code, prob) in table order; the fallback list if no keyword occurs."""
    return predictions_of(F.lower(text))


def words_found(low: Column) -> Column:
    """Which keywords a text in lower case holds, as a number with a bit per keyword."""
    bits = (F.when(F.contains(low, F.lit(w)), F.lit(1 << k)).otherwise(F.lit(0)) for k, w in enumerate(WORDS))
    return reduce(lambda a, b: a + b, bits)


def _outcomes(top_k: int | None = None) -> Column:
    """For each such number what is predicted, and the highest probability: a constant, so a row only looks it up."""
    found = []
    for bits in range(1 << len(WORDS)):
        own = ([(c, p) for w, c, p in KEYWORDS if bits >> WORDS.index(w) & 1] or FALLBACK)[:top_k]
        found.append({"predicted": [{"code": c, "prob": p} for c, p in own], "score": round(max(p for _, p in own), 4) if own else None})
    return F.from_json(F.lit(json.dumps(found)), f"array<struct<predicted:{_PAIRS},score:double>>")


def predictions_of(low: Column) -> Column:
    """The same for a text in lower case."""
    return F.get(_outcomes(), words_found(low))["predicted"]


def code_check(text: Column, top_k: int = 5) -> Column:
    """Struct of success, match_score, status, num_icds and predicted; status_text explains it."""
    return checked(words_found(F.lower(text)), text, top_k)


def checked(words: Column, text: Column, top_k: int = 5) -> Column:
    """The same, of the keywords that a text holds."""
    best = F.get(_outcomes(top_k), words)
    return _checked(best["predicted"], best["score"], F.coalesce(F.trim(text), F.lit("")) == "")


#: What is said of each status, before and after the score.
STATUS_TEXT = {
    "valid": ("High confidence ICD code match (score: ", "). Primary diagnosis appears legitimate."),
    "uncertain": ("Moderate confidence ICD code match (score: ", "). Recommend manual review."),
    "flagged": ("Low confidence ICD code match (score: ", "). Diagnosis codes may be mismatched."),
}
BLANK_TEXT = "Invalid input: clinical_text must be non-empty string"


def status_text(status: Column, score: Column) -> Column:
    out = F.lit(BLANK_TEXT)
    for name, (before, after) in STATUS_TEXT.items():
        out = F.when(status == name, F.concat(F.lit(before), F.format_string("%.2f", score), F.lit(after))).otherwise(out)
    return out


def _checked(predicted: Column, score: Column, blank: Column) -> Column:
    status = F.when(blank, "error").when(score >= 0.8, "valid").when(score >= 0.6, "uncertain").otherwise("flagged")
    return F.struct(
        (~blank).alias("success"), F.when(blank, 0.0).otherwise(score).alias("match_score"), status.alias("status"),
        F.when(blank, 0).otherwise(F.size(predicted)).alias("num_icds"), F.when(~blank, predicted).alias("predicted"),
    )


def ranked(predictions: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc("prob"), "code")
    return predictions.withColumn("rank", F.row_number().over(order))


def top_k(predictions: DataFrame, k: int = 10) -> DataFrame:
    return ranked(predictions).where(F.col("rank") <= k)


def related_codes(embeddings: DataFrame, dictionary: DataFrame, least: float = 0.65, **sizes) -> DataFrame:
    """Per declared code the dictionary code of largest cosine (first in code order on a tie) above ``least``.
    Any number of codes on either side: see ``balls``."""
    return most_similar(embeddings, dictionary, least, **sizes)


def by_document(predictions: DataFrame) -> DataFrame:
    """doc_id and its predictions, an array of (prob, code) by falling probability, then code."""
    order = F.struct((-F.col("prob")).alias("_neg"), F.col("code").alias("code"), F.col("prob").alias("prob"))
    listed = predictions.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("preds"))
    return listed.select("doc_id", F.transform("preds", lambda p: F.struct(p["code"].alias("code"), p["prob"].alias("prob"))).alias("preds"))


def _scored(declared: Column, preds: Column, best_match: Column, sim: Column) -> Column:
    """Struct of score, match_type and what it rests on, for one declared code and its document's predictions."""
    exact = F.array_max(F.transform(F.filter(preds, lambda p: p["code"] == declared), lambda p: p["prob"]))
    same = F.filter(F.slice(preds, 1, 10), lambda p: (p["code"] != "") & (T.category(p["code"]) == T.category(declared)))

    def ladder(x: Column) -> Column:
        is_exact = F.coalesce(x["exact"] >= 0.5, F.lit(False))
        is_category = ~is_exact & x["best"].isNotNull()
        is_related = ~is_exact & ~is_category & best_match.isNotNull()
        return F.struct(
            F.when(is_exact, 1.0).when(is_category, 0.6).when(is_related, 0.3).otherwise(0.0).alias("score"),
            F.when(is_exact, "exact_match").when(is_category, "same_category").when(is_related, "related").otherwise("mismatch").alias("match_type"),
            F.when(is_exact, x["exact"]).when(is_category, x["best"]["prob"]).alias("pred_prob"),
            F.when(is_category, x["best"]["code"]).alias("pred_top"),
            F.when(is_related, best_match).alias("best_match"), F.when(is_related, sim).alias("sim"),
        )

    return let(F.struct(exact.alias("exact"), F.get(same, F.lit(0)).alias("best")), ladder)


def score_declared(declared: DataFrame, predictions: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Per (doc_id, declared): score, match_type and what it rests on. First rule wins: the code
    itself at 0.5 or more, the best of ten predictions in its category, a related code, nothing."""
    out = declared.withColumn("declared", F.upper("declared")).join(by_document(predictions).hint("merge"), "doc_id", "left")
    if related is None:
        out = out.withColumn("best_match", F.lit(None).cast("string")).withColumn("sim", F.lit(None).cast("double"))
    else:
        out = out.join(related.hint("merge"), "declared", "left")
    return out.select("doc_id", "declared", _scored(F.col("declared"), F.col("preds"), F.col("best_match"), F.col("sim")).alias("_s")).select("doc_id", "declared", "_s.*")


def no_scorer(declared: DataFrame, predictions: DataFrame) -> DataFrame:
    """What stands in for a scorer that isn't given."""
    return declared.select("doc_id", "declared", F.lit(0.0).alias("score"), F.lit("no_scorer").alias("match_type"))


def explain(docs: DataFrame, predictions: DataFrame, scorer: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """A row per declared code: the document's top prediction, match type and score; a document
    without codes gives one no_declared row. docs: doc_id, text. The usual scorer (none given) works on
    each document's predictions as they are joined to it, once; another gets (doc_id, declared) rows."""
    with_preds = docs.select("doc_id", T.declared_codes(F.col("text")).alias("_codes")).join(by_document(predictions).hint("merge"), "doc_id", "left")
    top = F.get("preds", F.lit(0))
    rows = with_preds.select("doc_id", "preds", top["code"].alias("predicted_top"), top["prob"].alias("predicted_prob"), F.explode_outer("_codes").alias("declared"))
    if scorer is None:
        none = F.lit(None)
        s = _scored(F.upper("declared"), F.col("preds"), none.cast("string"), none.cast("double"))
        rows = rows.withColumn("_s", F.when(F.col("declared").isNotNull(), s)).withColumn("match_type", F.col("_s.match_type")).withColumn("score", F.col("_s.score"))
    else:
        scored = scorer(rows.where("declared IS NOT NULL").select("doc_id", "declared"), predictions).select("doc_id", "declared", "score", "match_type")
        rows = rows.join(scored.hint("merge"), ["doc_id", "declared"], "left")
    return rows.select(
        "doc_id", "declared", "predicted_top", F.coalesce("predicted_prob", F.lit(0.0)).alias("predicted_prob"),
        F.when(F.col("declared").isNull(), "no_declared").otherwise(F.col("match_type")).alias("match_type"), "score",
    )


def decision(score: Column, accept: float = 0.6, review: float = 0.3) -> Column:
    return F.when(score >= accept, "ACCEPT").when(score >= review, "REVIEW").otherwise("REJECT")


def decision_line(row: DataFrame) -> Column:
    line = F.format_string(
        "Declared: %s | Predicted: %s (p=%.3f) | Match: %s | Score: %.2f | Decision: %s",
        F.col("declared"), F.coalesce(F.nullif("predicted_top", F.lit("")), F.lit("None")), F.coalesce("predicted_prob", F.lit(0.0)),
        F.coalesce("match_type", F.lit("unknown")), F.col("score"), decision(F.col("score")),
    )
    return F.when(F.col("declared").isNull(), "No declared ICDs found.").otherwise(line)
