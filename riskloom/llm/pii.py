"""Personal data by candidate spans and gradient-boosted trees.

1. Generators of high recall propose spans, which may overlap: anything like a
   mail address (also spelt out), dotted numbers, and groups of digits.
2. Each candidate gets features of its format (lengths, digits, separators, groups)
   and of its context (words like "phone" before it, what touches it).
3. Boosted trees score them. They learn from every document; a candidate
   is positive if it is a span of the strict rules (``BASE``, with their
   checks) or if its form or the words right before it confirm it (``_CONFIRMED``):
   spelt-out addresses, usual ways to write a phone number, numbers after "call" or
   "card". Each strict address, phone and card number is learnt once more as a twin
   rewritten into a form that the rules miss (``_twin``). Other candidates are negative.
4. Three candidates in ten, by a hash, are not learnt from; on these, each generator's
   threshold is set to the lowest score at which ``PRECISION`` of what could be added from
   there on are positive (on ``LEAST`` candidates or more; otherwise that generator adds
   nothing). Strict spans are found anyway and do not count there, their twins do.

The spans are those of the strict rules, always, and the candidates at or over
their threshold that overlap none of them.

Built-in functions throughout; trees become CASE expressions over a candidate's
features, so documents are scored within their row. Texts are scanned once: what the
rules and generators find is written, then learnt from and scored. Candidates of equal
features (a form) are one row of the fit, weighted by how many there are, so it
grows with the forms, in partitions of ``SAMPLE_CANDIDATES`` of them.

Null texts are empty; matches never cross documents; repeated rows are scanned one
by one; other columns are ignored. Numbers that nothing confirms count as errors, so
where they are many among those of a form and context, that form is left in the text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_defaults
from ..sources.sinks import materialize
from .spans import add_hits, placed, written

SAMPLE_CANDIDATES = 20_000  # forms in a partition of the fit; no form is left out
TREES, DEPTH = 10, 3
LEAF = 5  # candidates in a leaf, at least
PRECISION, LEAST = 0.98, 50

# The strict rules. Possessive groups and the start of a run (after another match or no such character) find
# the same matches as the plain expressions without trying each place of a long run.
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = {
    "near_email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "near_ip": r"(?:\G|(?<![0-9.]))[0-9]{1,4}+(?:\.[0-9]{1,4}+){2,5}+(?![0-9])",
    "near_number": r"(?:\G|(?<![0-9+]))[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])++",
}
KINDS = [*BASE, *CANDIDATES]
_CONTEXT = {
    "says_phone": r"(?i)\b(?:phone|tel|mobile|call|fax|whatsapp)",
    "says_mail": r"(?i)\b(?:e-?mail|contact|write to|reach)",
    "says_card": r"(?i)\b(?:card|visa|amex|mastercard|payment|account|iban)",
    "says_address": r"(?i)\b(?:ip|address|host|server|login)",
}
# right before a number, and whole hits
_NAMES_PHONE = r"(?i)\b(?:phone|telephone|tel|mobile|call|fax|whatsapp)\b[^0-9!?;]{0,16}$"
_NAMES_CARD = r"(?i)\b(?:card|visa|amex|mastercard)\b[^0-9!?;]{0,16}$"
_PHONE_FORM = (
    r"^(?:(?:1[\x20.-])?(?:\([2-9][0-9]{2}\)[\x20-]?|[2-9][0-9]{2}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}"
    r"|\(0[0-9]{1,4}\)\x20?[0-9][0-9\x20-]{4,9}[0-9])$"
)
_SPELT_OUT = r"[A-Za-z].*[(\[](?:at|dot)[)\]].*[A-Za-z]{2,}$"
_STRICT = {"near_email": ("email",), "near_ip": ("ip",), "near_number": ("card", "phone")}


def _confirmed(kind: str, s: Column) -> Column:
    """Whether a candidate beyond the strict rules is taken as personal data."""
    if kind == "near_email":
        return F.regexp_like(s["hit"], F.lit(_SPELT_OUT))
    if kind == "near_ip":
        return F.lit(False)
    of = {name: c == 1 for name, c in features(kind, s).items() if name in ("names_phone", "names_card", "phone_form", "touches_before", "touches_after")}
    digits = F.length(F.regexp_replace(s["hit"], "[^0-9]", ""))
    named = (of["names_phone"] & digits.between(7, 15)) | (of["names_card"] & digits.between(12, 19))
    return (named | of["phone_form"]) & ~of["touches_before"] & ~of["touches_after"]


def _twin(kind: str, s: Column) -> Column:
    """The hit of a strict span in another form, which the strict rules miss; null if the kind has none."""
    hit = s["hit"]
    which = lambda n: F.pmod(F.xxhash64(hit, s["start"]), F.lit(n))
    if kind == "near_email":
        user, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
        return (
            F.when(which(3) == 0, F.concat(user, F.lit(" (at) "), host))
            .when(which(3) == 1, F.concat(user, F.lit("[at]"), host))
            .otherwise(F.concat(user, F.lit(" [at] "), F.replace(host, F.lit("."), F.lit(" [dot] "))))
        )
    if kind == "near_ip":
        return F.lit(None).cast("string")
    national = F.regexp_replace(hit, r"^\+[0-9]{1,3}[\x20.-]+", "")
    phone = F.when(which(2) == 0, F.substring(hit, 2, 1 << 30)).otherwise(F.regexp_replace(national, r"^\+", ""))
    card = F.regexp_replace(F.regexp_replace(hit, "[^0-9]", ""), "([0-9]{4})(?=[0-9])", "$1.")
    return F.when(hit.startswith("+"), phone).otherwise(card)


def luhn(digits: Column) -> Column:
    """Whether a string of 1 to 19 digits passes the Luhn check."""
    reversed_digits = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(reversed_digits, lambda d, i: F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.regexp_like(hit, F.lit(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def features(kind: str, s: Column) -> dict[str, Column]:
    """Features of a candidate (a struct of ``add_hits``), by name."""
    hit, size = s["hit"], F.length(s["hit"])
    count = lambda keep: F.length(F.regexp_replace(hit, f"[^{keep}]", ""))
    flag = lambda text, pattern: F.regexp_like(text, F.lit(pattern)).cast("int")
    out = {
        **{f"is_{k}": F.lit(int(k == kind)) for k in CANDIDATES},
        "length": size,
        "digits": count("0-9"),
        "letters": count("A-Za-z"),
        "dots": count("."),
        "separators": count("\\x20()-"),
        "groups": F.size(F.split(hit, "[^0-9A-Za-z]+")),
        "has_at": flag(hit, "@"),
        "has_plus": flag(hit, r"^\+"),
        "first_digit": F.coalesce(F.regexp_extract(hit, "^[^0-9]*([0-9])", 1).try_cast("int"), F.lit(-1)),
        "longest_group": F.array_max(F.transform(F.split(hit, "[^0-9A-Za-z]+"), F.length)),
        "touches_before": flag(s["before"], r"[\p{L}0-9._/-]$"),
        "touches_after": flag(s["after"], r"^[\p{L}0-9_/]"),
        **{name: flag(s["before"], pattern) for name, pattern in _CONTEXT.items()},
        "names_phone": flag(s["before"], _NAMES_PHONE),
        "names_card": flag(s["before"], _NAMES_CARD),
        "phone_form": flag(hit, _PHONE_FORM),
    }
    return {name: c.cast("double") for name, c in out.items()}


FEATURES = [*(f"is_{k}" for k in CANDIDATES), "length", "digits", "letters", "dots", "separators", "groups", "has_at", "has_plus",
            "first_digit", "longest_group", "touches_before", "touches_after", *_CONTEXT, "names_phone", "names_card", "phone_form"]


def _scanned(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) and two columns: ``base``, the placed strict spans, and each generator's candidates."""
    for kind, pattern in {**BASE, **CANDIDATES}.items():
        docs = add_hits(docs, "text", kind, pattern)
    valid = lambda kind: F.filter(kind, lambda s: _passes(kind, s["hit"]))
    base = F.concat(*[placed(valid(k), i) for i, k in enumerate(BASE)])
    return docs.withColumn("base", base).drop(*BASE)


@dataclass
class Model:
    """Boosted trees over ``FEATURES`` and the threshold of each generator (None: it adds nothing)."""

    trees: list = field(default_factory=list)  # (weight, tree); a tree is a number or (feature, threshold, left, right)
    thresholds: dict[str, float | None] = field(default_factory=dict)

    def margin(self, of: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * _case(tree, of)
        return total


def _case(tree, of: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, threshold, left, right = tree
    return F.when(of[FEATURES[feature]] <= threshold, _case(left, of)).otherwise(_case(right, of))


def _tree(node):
    if node.subtreeDepth() == 0:
        return node.prediction()
    return node.split().featureIndex(), node.split().threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def _examples(scanned: DataFrame) -> DataFrame:
    """``kind, label, addable, learn, weight`` and the features of all candidates and twins, one row for equal ones."""

    def labelled(kind: str) -> list[Column]:
        own = [KINDS.index(k) for k in _STRICT[kind]]
        same = lambda b, s: (b["start"] == s["start"]) & (b["end"] == s["end"]) & b["kind"].isin(own)
        strict = lambda s: F.exists("base", lambda b: same(b, s))
        free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        row = lambda s, of, label, addable: F.struct(
            F.lit(kind).alias("kind"),
            label.cast("double").alias("label"),
            F.lit(addable).alias("addable"),
            s["start"].alias("start"),
            *[c.alias(name) for name, c in features(kind, of).items()],
        )
        rewritten = lambda s: {"hit": _twin(kind, s), "before": s["before"], "after": s["after"]}
        beyond = F.transform(F.filter(kind, free), lambda s: row(s, s, _confirmed(kind, s), True))
        # addresses of machines have no other form and stand for themselves
        known = F.transform(F.filter(kind, strict), lambda s: row(s, s, F.lit(True), kind == "near_ip"))
        if kind == "near_ip":
            return [beyond, known]
        return [beyond, known, F.transform(F.filter(kind, strict), lambda s: row(s, rewritten(s), F.lit(True), True))]

    each = [part for k in CANDIDATES for part in labelled(k)]
    rows = scanned.select("doc_id", F.explode(F.concat(*each)).alias("c")).select("doc_id", "c.*")
    learn = F.pmod(F.xxhash64("doc_id", "kind", "start"), F.lit(10)) < 7
    return rows.groupBy("kind", "label", "addable", learn.alias("learn"), *FEATURES).agg(F.count("*").cast("double").alias("weight"))


def train(docs: DataFrame) -> Model:
    """Fit and calibrate on all of ``docs`` (``doc_id, text``)."""
    return _train(_scanned(docs))


def _train(scanned: DataFrame) -> Model:
    examples = materialize(_examples(scanned))
    of_label = {r.label: r for r in examples.where("learn").groupBy("label").agg(F.count("*").alias("forms"), F.sum("weight").alias("n")).collect()}
    model = Model()
    if set(of_label) == {0.0, 1.0}:  # otherwise all score the same
        parts = math.ceil(sum(r.forms for r in of_label.values()) / SAMPLE_CANDIDATES)
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(examples.where("learn"))
        columns = ["label", "weight", *FEATURES]  # sums of the fit are taken in one order
        vectors = vectors.repartition(parts, *columns).sortWithinPartitions(*columns).select("features", "label", "weight")
        # a row stands for many candidates, so a leaf's least size is one of weight
        least = min(0.49, (LEAF - 0.5) / sum(r.n for r in of_label.values()))
        gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, minWeightFractionPerNode=least, weightCol="weight").fit(vectors)
        model = Model([(w, _tree(t._call_java("rootNode"))) for w, t in zip(gbt.treeWeights, gbt.trees, strict=True)])
    # at most 100 scores for each generator come to the driver
    score = F.round(1 / (1 + F.exp(-2 * model.margin({f: F.col(f) for f in FEATURES}))), 2)
    seen = examples.where("addable AND NOT learn").groupBy("kind", score.alias("score")).agg(
        F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("hits")
    )
    by_kind: dict[str, list] = {}
    for r in seen.orderBy("kind", F.desc("score")).collect():
        by_kind.setdefault(r.kind, []).append(r)
    for kind, rows in by_kind.items():
        n = hits = 0
        model.thresholds[kind] = None
        for r in rows:
            n, hits = n + r.n, hits + r.hits
            if n >= LEAST and hits >= PRECISION * n:
                model.thresholds[kind] = r.score - 0.005
    return model


def with_spans(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``base`` and ``added``, arrays of ``start, kind, end`` (kinds are numbers into ``KINDS``)."""
    return _with_added(_scanned(docs), model)


def _with_added(scanned: DataFrame, model: Model) -> DataFrame:

    def chosen(kind: str, threshold: float) -> Column:
        free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        score = lambda s: 1 / (1 + F.exp(-2 * model.margin(features(kind, s))))
        return F.filter(kind, lambda s: free(s) & (score(s) >= threshold))

    thresholds = {k: t for k, t in model.thresholds.items() if t is not None}
    parts = [placed(chosen(k, thresholds[k]), KINDS.index(k)) for k in CANDIDATES if k in thresholds]
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return scanned.withColumn("added", F.concat(*parts) if parts else none).drop(*CANDIDATES)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added`` of each row of ``docs``."""
    ensure_defaults(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = materialize(_scanned(texts).drop("text"))
    return _with_added(scanned, _train(scanned)).select("doc_id", "base", "added")


def digests(found: DataFrame) -> DataFrame:
    """Counts and written spans of what ``find`` found."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "added"), KINDS).alias("spans"),
    )


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of spans that overlap, one bracket for all (the first's)."""
    names = F.array(*[F.lit(f"[{k.removeprefix('near_').upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"].cast("int") + 1, (s["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.get(names, s["kind"]))).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate(F.array_sort(spans), start, add)
    return F.concat(done["out"], F.substring(text, done["at"].cast("int") + 1, F.length(text)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` redacted, and ``n_chars`` (if there) of the new text. All rows stay; null texts stay null."""
    ensure_defaults(docs.sparkSession)
    names = docs.columns
    # own names, so that none of the documents' columns clashes
    row, text = F.struct(*[F.col(f"`{c}`") for c in names]), F.coalesce("text", F.lit(""))
    held = docs.select(row.alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    held = materialize(_scanned(held).drop("text")).withColumn("text", F.coalesce("_row.text", F.lit("")))
    held = _with_added(held, _train(held)).withColumn("_spans", F.concat("base", "added"))
    new = F.when(F.size("_spans") > 0, _redacted(F.col("text"), F.col("_spans"))).otherwise(F.col("_row.text"))
    out = held.select("_row", new.alias("_new"))
    values = {"text": F.col("_new"), "n_chars": F.length("_new").cast("bigint")}
    return out.select(*[values.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])
