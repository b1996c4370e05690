"""Personal data by weak supervision, in SQL functions only.

Four base kinds are found by pattern and check (parts of an address, Luhn, number of digits) and
always stay. Further spans come from a pattern for candidates: access tokens, national ids, phone
numbers as written within several countries, bank accounts with or without blanks, and names (titled, or
two capitalised words). Three labelers vote on each candidate (yes, no or
nothing): a strict regex, a gazetteer of prefixes, countries and names, and the words before it.
Expectation-maximisation over the counts of vote patterns estimates, for each kind of span, how
reliable each labeler is and how likely each pattern is personal data (a kind with few candidates leans
on the mean reliabilities of all kinds); a logistic span classifier over votes and kinds is trained on
these likelihoods. Candidates it gives at least one half, and that overlap no base span, are added.

The pattern counts come from every document; there are at most 27 per kind, so they and the
classifier have a fixed size. Each text is read once: base spans and voted candidates, positions only,
are written to the shared folder, and both the counts and the result come from that table, which the lazy
result rests on. Texts never leave the row they are in: no shuffle but that of counts.
Matches of a long text are put together in runs of ``RUN`` pieces, and base spans near a candidate are
found by halving, so time grows with the text and not with its square.

Defined results: a null text is empty; without spans the digest is that of an empty string; the
private-use character U+E000 serves as a marker, one in a text is read as U+E001; repeated rows
are scanned one by one; other columns are ignored. Positions are in code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkverity.llm.common import stored

MARK, INSTEAD = "\ue000", "\ue001"
#: A lookbehind (or the end of the last match) replaces retries from inside a run, and repeated groups
#: don't give back what they took: same matches, in linear time and without deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = ["email", "ip", "card", "phone", "account", "local_phone", "national_id", "person", "token"]
TITLE = r"(?:Mrs?|Ms|Dr|Prof)"
#: Numbers with a leading 0 in groups of two, of three or four, or as code and number; nine digits of Spain. _ is one separator for all.
_NATIONAL = [r"\(?0[1-9][0-9]{1,2}\)?_[0-9]{3,4}_[0-9]{3,4}", r"0[1-9](?:_[0-9]{2}){4}", r"[679][0-9]{2}(?:_[0-9]{3}_[0-9]{3}|(?:_[0-9]{2}){3})"]
NATIONAL = "|".join([x.replace("_", by) for x in _NATIONAL for by in (" ", r"\.", "-")] + [r"\(?0[1-9][0-9]{1,3}\)?[ /-][0-9]{6,8}"])
CANDIDATE = {
    "token": r"[A-Za-z0-9_-]{20,}",
    "account": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} [A-Z0-9]{4}(?: (?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){2,6}(?: [0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": rf"\(?[0-9]{{3}}\)?[ .-][0-9]{{3}}[.-][0-9]{{4}}|(?<![0-9+.-])(?:{NATIONAL})(?![0-9])",
    "person": rf"{TITLE}\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{Ll}}+(?!\p{{L}}))?|(?<!\p{{L}})\p{{Lu}}\p{{Ll}}+ \p{{Lu}}\p{{Ll}}+(?!\p{{L}})",
}
STRICT = {
    "token": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})$",
    "account": r"^[A-Z]{2}[0-9]{2} ?(?:[A-Z]{4} ?(?:[0-9] ?){7,}|(?:[0-9] ?){11,})[A-Z0-9 ]*$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "local_phone": rf"^(?:\([2-9][0-9]{{2}}\) |[2-9][0-9]{{2}}[ .-])[2-9][0-9]{{2}}[.-][0-9]{{4}}$|^(?=(?:[^0-9]*[0-9]){{9,11}}[^0-9]*$)(?:{NATIONAL})$",
    "person": rf"^{TITLE}\. \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?$",
}
LOOSE_NO = {"token": r"^[A-Za-z_-]+$|^[0-9_-]+$"}
#: Common surnames of several countries.
NAMES = (
    "Adams Allen Anderson Baker Becker Bell Bernard Bertrand Brown Campbell Carter Castro Clark Cohen Collins Cooper Cox Davies Davis Diaz Dubois Durand Edwards "
    "Evans Fernandez Fischer Flores Fournier Garcia Girard Gomez Gonzalez Green Hall Harris Hernandez Hill Hoffmann Hughes Jackson Jimenez Johnson Jones Kelly "
    "Khan King Klein Koch Lambert Laurent Lee Lefebvre Leroy Lewis Lopez Martin Martinez Meyer Miller Mitchell Moore Moreau Moreno Morgan Morris Murphy Navarro "
    "Nelson Nguyen Parker Patel Perez Peters Petit Phillips Ramirez Reed Richard Richter Rivera Roberts Robinson Rodriguez Rogers Romero Rossi Roux Ruiz Sanchez "
    "Schmidt Schneider Schulz Scott Silva Simon Smith Stewart Suarez Taylor Thomas Thompson Torres Turner Vargas Vincent Wagner Walker Ward Watson Weber White "
    "Williams Wilson Wolf Wood Wright Young Zimmermann"
).split()
#: Common given names of several countries.
GIVEN = (
    "Alexander Alice Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Carlos Carmen Caroline Charles Charlotte Christian Christine Claire Claudia Daniel David "
    "Diana Edward Elena Elizabeth Emily Emma Eric Francisco Frank George Hans Helen Henry Isabel Jack Jacques James Jane Javier Jean Jennifer Jessica Joan John Jorge Joseph "
    "Juan Julia Karen Karl Katharina Kevin Klaus Laura Linda Lisa Louis Lucia Luis Manuel Margaret Maria Marie Mark Martha Mary Matthew Michael Michel Miguel Nancy Nicolas "
    "Olivia Patricia Paul Pedro Peter Philippe Pierre Richard Robert Rosa Sandra Sarah Sofia Sophie Stefan Stephen Susan Thomas Ursula William"
).split()
#: First digits of numbers as written within several countries.
CODES = r"0(?:2[03489]|1[1-9]1|11[3-8]|7[0-9]{2}|30|40|69|89|211|221|711|1[5-7][0-9])[ )./-]|0[1-79][ .-][0-9]{2}[ .-]|[679][0-9]{2}[ .-]"
GAZETTEER = {
    "token": r"^(?:AKIA|gh[pousr]_|sk-|xox[abp]-|eyJ)",
    "account": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "local_phone": r"^\(?(?:20[1-9]|21[02-9]|22[0-9]|23[149]|24[08]|25[1-6]|26[0279]|27[0246]|28[13]|30[1-9]|31[0-9]|32[0135]|33[0146]|34[0167]|35[12]|36[014]|38[056]|40[1-9]|41[02-9]"
    r"|42[345]|43[0245]|44[0237]|45[68]|46[3479]|47[0589]|48[04]|50[1-9]|51[0-9]|52[0-9]|53[0149]|54[01]|55[19]|56[1247]|57[0-5]|58[056]|60[1-9]|61[0-9]|62[0-9]|63[016]"
    r"|64[16]|65[0179]|66[0-9]|67[0128]|68[0129]|70[1-9]|71[2-9]|72[0-7]|73[124]|74[037]|75[47]|76[0-9]|77[0-9]|78[0-7]|80[1-8]|81[0-9]|82[058]|83[0-2]|84[3578]|85[0-9]"
    r"|86[0-9]|87[0238]|90[1-9]|91[0-9]|92[058]|93[0-9]|94[0179]|95[0-6]|97[0-9]|98[0459])|^\(?(?:" + CODES + ")",
    "person": rf"(?<!\p{{L}})(?:{'|'.join(NAMES)})$|^(?:{TITLE}\.? )?(?:{'|'.join(GIVEN)}) ",
}
GAZETTEER_NO = {"account": r"^[A-Z]{2}", "person": rf"^(?!{TITLE}\b)"}
CONTEXT = {
    "token": r"(?i)(?:token|key|secret|passw(?:or)?d|bearer|auth)\W{0,6}$",
    "account": r"(?i)(?:iban|account|konto|compte|cuenta)\W{0,6}$",
    "national_id": r"(?i)(?:ssn|social security(?: number)?|national id)\W{0,6}$",
    "local_phone": r"(?i)(?:tel|phone|call|mobile|fax|handy|móvil)\w*\W{0,6}$",
    "person": r"(?i)(?:\bname(?: is)?|signed|contact|dear|regards|attn|heiße|llamo|appelle|\bby)\W{0,6}$",
}
CONTEXT_CHARS = 32
ROUNDS = 100
#: Pieces of a text (matches and what lies between) that are put together at a time; even.
RUN = 128
#: Weight of the pooled reliabilities in those of a kind, in candidates.
LEAN = 5.0


def _text(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return F.when(F.contains(plain, F.lit(MARK)), F.translate(plain, MARK, INSTEAD)).otherwise(plain)


def _found(text: Column, pattern: str, item: Callable[[Column, Column, Column, Column], Column], keep: Callable[[Column], Column], empty: str) -> Column:
    """One item(match, start, end, text before) per match that passes keep, in order of place. The pieces
    between marks are gone through in runs, each with places of its own, which are then moved by what lies before."""
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def run(all_parts: Column, k: Column) -> Column:
        before = F.when(k > 0, F.right(F.element_at(all_parts, F.greatest(k * RUN, F.lit(1))), F.lit(CONTEXT_CHARS))).otherwise(F.lit(""))
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), before.alias("before"), F.array().cast(empty).alias("out"))

        def step(a: Column, x: Column) -> Column:
            end = a["at"] + F.length(x)
            out = F.when(a["hit"] & keep(x), F.concat(a["out"], F.array(item(x, a["at"], end, a["before"])))).otherwise(a["out"])
            return F.struct(end.alias("at"), (~a["hit"]).alias("hit"), F.right(x, F.lit(CONTEXT_CHARS)).alias("before"), out.alias("out"))

        return F.aggregate(F.slice(all_parts, k * RUN + 1, F.lit(RUN)), start, step, lambda a: F.struct(a["at"].alias("long"), a["out"].alias("out")))

    def runs(all_parts: Column) -> Column:
        last = F.floor((F.size(all_parts) - 1) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: run(all_parts, k))

    def placed(all_runs: Column) -> Column:
        longs = F.transform(all_runs, lambda r: r["long"])
        starts = F.aggregate(longs, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        moved = F.zip_with(all_runs, starts, lambda r, by: F.transform(r["out"], lambda x: x.withField("start", x["start"] + by).withField("end", x["end"] + by)))
        return F.flatten(F.filter(moved, lambda x: x.isNotNull()))

    # Each step's array is bound once by a transform over an array that holds only it.
    return F.flatten(F.transform(F.array(parts), lambda p: F.element_at(F.transform(F.array(runs(p)), placed), 1)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = _digits(x)

    def doubled(i: Column) -> Column:
        v = F.substring(d, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + doubled(i))
    return F.when(F.length(d).between(14, 19), total % 10 == 0).otherwise(False)


def _small_parts(x: Column) -> Column:
    def part(p: Column) -> Column:
        short = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(F.length(short) <= 3, short.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(x, r"\."), part)


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda x: F.length(_digits(x)).between(10, 15),
}
_SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"


def base_spans(text: Column) -> list[Column]:
    """Per kind an array of (start, place of the kind, end, kind), in order."""
    found = []
    for place, kind in enumerate(BASE):
        def item(x: Column, at: Column, end: Column, before: Column, place: int = place, kind: str = kind) -> Column:
            return F.struct(at.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(kind).alias("kind"))

        own = _found(text, BASE[kind], item, CHECKS[kind], _SPAN)
        found.append(F.when(text.rlike(NEEDS[kind]), own).otherwise(F.array().cast(_SPAN)).alias(kind))
    return found


_CANDIDATE = "array<struct<start:int,place:int,end:int,kind:string,regex:int,gazetteer:int,context:int>>"


def _vote(kind: Column, x: Column, yes: dict[str, str], no: dict[str, str]) -> Column:
    out = F.lit(0)
    for k in CANDIDATE:
        if k in yes or k in no:
            own = F.when(x.rlike(yes[k]), 1) if k in yes else F.when(F.lit(False), 0)
            own = own.when(x.rlike(no[k]), -1) if k in no else own
            out = F.when(kind == k, own.otherwise(0)).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """Array of candidate spans with the votes of the three labelers."""

    def item(x: Column, at: Column, end: Column, before: Column) -> Column:
        kind, place = F.lit(None).cast("string"), F.lit(None).cast("int")
        for k in ("token", "person", "local_phone", "national_id", "account"):
            own = x.rlike(f"^(?:{CANDIDATE[k]})$")
            kind, place = F.when(own, k).otherwise(kind), F.when(own, KINDS.index(k)).otherwise(place)
        context = _vote(kind, before, CONTEXT, {"token": "$"})
        return F.struct(
            at.alias("start"), place.alias("place"), end.alias("end"), kind.alias("kind"),
            _vote(kind, x, STRICT, LOOSE_NO).alias("regex"), _vote(kind, x, GAZETTEER, GAZETTEER_NO).alias("gazetteer"), context.alias("context"),
        )

    pattern = "|".join(CANDIDATE[k] for k in ("account", "token", "national_id", "local_phone", "person"))
    return F.when(text.rlike(pattern), _found(text, pattern, item, lambda x: F.lit(True), _CANDIDATE)).otherwise(F.array().cast(_CANDIDATE))


def _overlaps(spans: str) -> str:
    """Whether the candidate c overlaps one of spans (of one kind, so in order and apart): the last that starts before its end."""
    half = "(s.low + s.high) div 2"
    step = f"CASE WHEN s.low >= s.high THEN s WHEN {spans}[cast({half} AS int)].start < c.end THEN named_struct('low', {half} + 1L, 'high', s.high) ELSE named_struct('low', s.low, 'high', {half}) END"
    before = f"aggregate(sequence(1, 32), named_struct('low', 0L, 'high', cast(size({spans}) AS bigint)), (s, k) -> {step}, s -> s.low)"
    return f"size({spans}) > 0 AND exists(array({before}), n -> n > 0 AND {spans}[cast(greatest(n, 1L) - 1 AS int)].end > c.start)"


def _free(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, and candidates that overlap none of them."""
    text = docs.select("doc_id", _text(F.col("text")).alias("_t"))
    spans = text.select("doc_id", *base_spans(F.col("_t")), candidates(F.col("_t")).alias("more"))
    free = F.expr(f"CASE WHEN size(more) > 0 THEN filter(more, c -> NOT ({' OR '.join(f'({_overlaps(k)})' for k in BASE)})) ELSE more END")
    return spans.select("doc_id", F.array_sort(F.concat(*BASE)).alias("base"), free.alias("more"))


Votes = tuple[int, ...]
Table = list[list[list[float]]]


def _better_than_chance(rows: list[list[float]]) -> list[list[float]]:
    """P(vote | false) and P(vote | true) where yes isn't rarer and no isn't commoner among true spans: both their mean, else."""
    (no0, _, yes0), (no1, _, yes1) = rows
    if no1 > no0:
        no0 = no1 = (no0 + no1) / 2.0
    if yes1 < yes0:
        yes0 = yes1 = (yes0 + yes1) / 2.0
    return [[no0, 1.0 - no0 - yes0, yes0], [no1, 1.0 - no1 - yes1, yes1]]


def reliabilities(patterns: list[tuple[Votes, float]], lean: Table | None = None) -> tuple[float, Table, list[float]]:
    """EM over (votes, count): share of true spans, P(vote | truth) per labeler, P(true | pattern).
    lean: a table that counts like LEAN candidates. No labeler may be worse than chance, so that the two
    classes can't change places."""
    n = len(patterns[0][0])
    true = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in patterns]
    prior, table = 0.5, []
    for _ in range(ROUNDS):
        total = sum(c for _, c in patterns)
        prior = (sum(t * c for t, (_, c) in zip(true, patterns, strict=True)) + 1.0) / (total + 2.0)
        table = []
        for j in range(n):
            own = [[0.5 + (LEAN * lean[j][truth][k] if lean else 0.0) for k in range(3)] for truth in (0, 1)]  # by truth, then vote -1, 0, 1
            for t, (v, c) in zip(true, patterns, strict=True):
                own[1][v[j] + 1] += t * c
                own[0][v[j] + 1] += (1.0 - t) * c
            table.append(_better_than_chance([[x / sum(row) for x in row] for row in own]))
        for k, (v, _) in enumerate(patterns):
            odds = math.log(prior / (1.0 - prior)) + sum(math.log(table[j][1][v[j] + 1] / table[j][0][v[j] + 1]) for j in range(n))
            true[k] = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, table, true


def likelihoods(patterns: list[tuple[str, Votes, float]]) -> list[float]:
    """P(true) of each (kind, votes, count), with reliabilities of each kind."""
    of = {kind: [(v, c) for k, v, c in patterns if k == kind] for kind in sorted({k for k, _, _ in patterns})}
    tables = [reliabilities(own)[1] for own in of.values()]
    # Pooled: the mean of the kinds' own tables. Counts of all kinds together would be those of the commonest.
    pooled = [[[sum(t[j][truth][k] for t in tables) / len(tables) for k in range(3)] for truth in (0, 1)] for j in range(len(patterns[0][1]))]
    out = {}
    for kind, own in of.items():
        out |= {(kind, v): t for (v, _), t in zip(own, reliabilities(own, pooled)[2], strict=True)}
    return [out[k, v] for k, v, _ in patterns]


def _inputs(kind: str, votes: Votes) -> list[float]:
    return [1.0, *(float(kind == k) for k in KINDS[4:]), *(float(v == want) for v in votes for want in (1, -1))]


def classifier(patterns: list[tuple[str, tuple[int, ...], float]]) -> list[float]:
    """Weights of the span classifier, fitted to what EM says of each (kind, votes)."""
    true = likelihoods(patterns)
    x = [_inputs(k, v) for k, v, _ in patterns]
    total = sum(c for _, _, c in patterns)
    w = [0.0] * len(x[0])
    for _ in range(2000):
        slope = [0.002 * b for b in w]
        for own, t, (_, _, c) in zip(x, true, patterns, strict=True):
            miss = (1.0 / (1.0 + math.exp(-sum(a * b for a, b in zip(own, w, strict=True)))) - t) * (0.5 * c / total + 0.5 / len(x))
            slope = [s + miss * a for s, a in zip(slope, own, strict=True)]
        w = [b - 2.0 * s for b, s in zip(w, slope, strict=True)]
    return w


def train(docs: DataFrame) -> list[float] | None:
    """Count vote patterns over all documents and fit; None without candidates."""
    return _fitted(_free(docs))


def _fitted(spans: DataFrame) -> list[float] | None:
    votes = spans.select(F.inline("more")).groupBy("kind", "regex", "gazetteer", "context").agg(F.count("*").alias("n"))
    patterns = sorted((r.kind, (r.regex, r.gazetteer, r.context), float(r.n)) for r in votes.collect())
    return classifier(patterns) if patterns else None


def find(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """doc_id, counts and digest of the base kinds, and all spans of every document."""
    spans = _free(docs)
    if weights is None:
        spans, _ = stored(spans, "pii-spans")
        weights = _fitted(spans)
    if weights is None:
        all_spans = F.col("base")
    else:
        names = iter(weights)
        c = "c.kind"
        terms = [repr(next(names)) + "D"] + [f"CASE WHEN {c} = '{k}' THEN {next(names)!r}D ELSE 0D END" for k in KINDS[4:]]
        terms += [f"CASE WHEN c.{v} = {want} THEN {next(names)!r}D ELSE 0D END" for v in ("regex", "gazetteer", "context") for want in (1, -1)]
        added = F.expr(f"transform(filter(more, c -> {' + '.join(terms)} >= 0D), c -> struct(c.start AS start, c.place AS place, c.end AS end, c.kind AS kind))")
        all_spans = F.array_sort(F.concat("base", added.cast(_SPAN)))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(all_spans).alias("spans"))
