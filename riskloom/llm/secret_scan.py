"""Secret scans that link the parts of a credential.

Strong findings (``BASE``) stand alone: an assignment to a password, token or key, an
access key identifier, a long hexadecimal string. A weak part says little by itself:
a user name or client identifier, a random-looking string, an endpoint. Weak parts
are reported when the parts that complete a credential are near:

* an identifier with a secret in its scope,
* a secret with an identifier or an endpoint in its scope,
* an endpoint with both an identifier and a secret in its scope,

where strong findings count as identifier or secret too. The scope of a part is its
span and ``SCOPE`` code points to either side; parts are in it if they
overlap it. That is an interval join: parts are dealt by text and by cells of
``SCOPE`` code points, so the candidates of a part are those of a few cells and no
long text is one group. Only documents with a weak part and another part take part.

Built-in functions throughout. Null texts are empty; matches never cross
documents; repeated rows (even with the same ``doc_id``, or a null one) are scanned one by
one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import ensure_defaults
from ..sources.sinks import materialize
from .spans import add_hits, placed, written

SCOPE = 200

# fixed patterns: kind, expression; what a match must have besides is in _strong
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

# Random-looking strings: with a digit and a capital, or of two of lower case, capitals and digits. The latter are no part of an
# address, path or host name, and not the value of an identifier.
_THREE_CLASSES = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}"
_TWO_CLASSES = (
    r"""(?<![A-Za-z0-9+/_=.?&#%~@-])(?<!(?i:user|user_?name|login|account|account_?id|client_?id|key_?id|tenant|tenant_?id)["']?\x20?[:=]\x20?["']?)"""
    r"(?=[a-z+_-]*+[A-Z0-9])(?=[A-Z+_-]*+[a-z0-9])(?=[0-9+_-]*+[A-Za-z])[A-Za-z0-9+_-]{20,}+(?![/@]|\.[A-Za-z0-9]|://)={0,2}"
)
# the method's weak parts
WEAK = {
    "link_id": r"""(?i:\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|key_?id|tenant(?:_?id)?))["']?\x20?[:=]\x20?["']?[A-Za-z0-9._@-]{3,}+""",
    "link_secret": rf"{_THREE_CLASSES}|{_TWO_CLASSES}",
    "link_endpoint": r"(?:https?|s3|jdbc:[a-z]{2,16}|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[A-Za-z0-9._~:/?#@%&=+-]{3,}",
}
KINDS = [*BASE, *WEAK]
_IDS, _SECRETS, _ENDPOINTS = ("access", "link_id"), ("assign", "hex", "link_secret"), ("link_endpoint",)


def _strong(kind: str, spans: Column) -> Column:
    if kind != "assign":
        return spans
    return F.filter(spans, lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6)


def _scanned(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, weak``: placed spans of each document."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")
    )
    for kind, pattern in {**BASE, **WEAK}.items():
        rows = add_hits(rows, "text", kind, pattern)
    rows = rows.drop("text")
    base = F.concat(*[placed(_strong(k, F.col(k)), i) for i, k in enumerate(BASE)])
    weak = F.concat(*[placed(F.col(k), len(BASE) + i) for i, k in enumerate(WEAK)])
    return rows.select("row", "doc_id", base.alias("base"), weak.alias("weak"))


def _linked(scanned: DataFrame) -> DataFrame:
    """``row, added``: the weak parts of each document that have what completes them in their scope."""
    number = {k: i for i, k in enumerate(KINDS)}
    some = scanned.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
    parts = some.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.*")
    cell = lambda place: F.floor(F.greatest(place, F.lit(0)) / SCOPE)
    others = parts.select(
        "row", "kind", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell")
    )
    weak = parts.where(F.col("kind") >= len(BASE)).select(
        "row", F.col("kind").alias("w_kind"), "start", "end",
        F.explode(F.sequence(cell(F.col("start") - SCOPE), cell(F.col("end") + SCOPE))).alias("cell"),
    )
    near = weak.join(others, ["row", "cell"]).where(
        (F.col("o_start") <= F.col("end") + SCOPE) & (F.col("o_end") >= F.col("start") - SCOPE)
    )
    # a weak part that overlaps a strong finding is reported by that one
    covered = (F.col("kind") < len(BASE)) & (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end"))
    has = lambda kinds: F.max(F.col("kind").isin([number[k] for k in kinds]))
    found = near.groupBy("row", "w_kind", "start", "end").agg(
        has(_IDS).alias("ids"), has(_SECRETS).alias("secrets"), has(_ENDPOINTS).alias("endpoints"), F.max(covered).alias("covered")
    )
    complete = (
        F.when(F.col("w_kind") == number["link_id"], F.col("secrets"))
        .when(F.col("w_kind") == number["link_secret"], F.col("ids") | F.col("endpoints"))
        .otherwise(F.col("ids") & F.col("secrets"))
    )
    return found.where(complete & ~F.col("covered")).groupBy("row").agg(
        F.collect_list(F.struct("start", F.col("w_kind").alias("kind"), "end")).alias("added")
    )


def secret_scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` (arrays of ``start, kind, end``; kinds are numbers into ``KINDS``), one row for each row."""
    ensure_defaults(docs.sparkSession)
    scanned = materialize(_scanned(docs))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return scanned.join(_linked(scanned), "row", "left").select(
        "doc_id", "base", F.coalesce("added", none).alias("added")
    )


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and written spans of what ``secret_scan`` found."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "added"), KINDS).alias("spans"),
    )
