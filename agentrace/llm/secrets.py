"""Secret scan with multipart linking: parts of a credential are joined by intervals in scopes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentrace.llm.batches import fields, map_slices
from agentrace.llm.keys import KEY, keyed, null_safe
from agentrace.llm.registry import query, table
from agentrace.session import materialize

# The base patterns, and what of their matches must be how long.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Base kinds in the order in which they are listed, then the kinds that need a partner.
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
IDENT = re.compile(r"\b(?:ASIA|AIDA|AROA|AGPA|GOOG)[A-Z0-9]{12,}|\b[A-Z0-9]{20,}\b")
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|\b[a-z0-9.-]{1,200}\.amazonaws\.com\b")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
SCOPE = re.compile(r"\n[^\S\n]*\n")
#: Parts link if fewer than this many code points lie between them.
REACH = 200


def parts(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, scope) of base spans and weak candidates; the kind indexes KINDS.

    A scope is a paragraph. Weak candidates are looked for only in texts that hold some part that
    could complete them, and where no base span lies.
    """
    found = []
    if ":" in text or "=" in text:
        found += [
            (0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST
        ]
    if "AKIA" in text:
        found += [
            (1, m.start(), m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= ACCESS_LEAST
        ]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    covered = sorted((start, end) for _, start, end in found)
    idents = outside(IDENT, text, covered)
    ends = outside(ENDPOINT, text, covered) if "://" in text or "amazonaws" in text else []
    opaque = []
    if idents or ends or any(kind == 1 for kind, *_ in found):
        taken = sorted(covered + idents + ends)
        opaque = [
            (a, b)
            for a, b in outside(OPAQUE, text, taken)
            if DIGIT.search(text, a, b) and LETTER.search(text, a, b)
        ]
    for kind, spans in ((3, idents), (4, opaque), (5, ends)):
        found += [(kind, *span) for span in spans]
    if not found:
        return []
    breaks = [m.end() for m in SCOPE.finditer(text)]
    found.sort(key=lambda p: (p[1], p[0]))
    out, scope = [], 0
    for kind, start, end in found:
        while scope < len(breaks) and breaks[scope] <= start:
            scope += 1
        out.append((kind, start, end, scope))
    return out


def outside(pattern, text, covered):
    """Matches that overlap none of the sorted spans."""
    spans, at, reached = [], 0, -1
    for m in pattern.finditer(text):
        while at < len(covered) and covered[at][0] < m.end():
            reached = max(reached, covered[at][1])
            at += 1
        if reached <= m.start():
            spans.append((m.start(), m.end()))
    return spans


def secret_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with its parts: ``doc_id, text_hash, parts``."""
    source = keyed(docs, id_col, text_col)
    schema = fields(
        source, *KEY, parts="array<struct<kind:int,start:int,stop:int,scope:int>>"
    )

    def scan(batch):
        rows = (parts(t) for t in batch.column("text").to_pylist())
        names = ("kind", "start", "stop", "scope")
        return {
            "doc_id": batch.column("doc_id"),
            "text_hash": batch.column("text_hash"),
            "parts": [[dict(zip(names, p)) for p in row] for row in rows],
        }

    return map_slices(source, scan, schema, "text")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak candidates that have a partner: ``doc_id, text_hash, kind, start, stop``.

    An interval join: parts widened by the reach are put in cells of that width, and parts of one
    scope that share a cell are compared. A cell holds few parts, as parts of a kind don't overlap
    and have a least length, so neither a hot document nor a hot scope makes many pairs.
    """
    part = (
        found.where(F.exists("parts", lambda p: p["kind"] >= 3))
        .dropDuplicates([*KEY])
        .select(*KEY, F.explode("parts").alias("part"))
        .select(*KEY, "part.*")
    )
    cell = lambda c: F.floor(c / F.lit(reach))
    weak = part.where("kind >= 3").withColumn(
        "cell",
        F.explode(F.sequence(cell(F.col("start") - reach), cell(F.col("stop") + reach))),
    )
    other = part.select(
        *KEY,
        "scope",
        F.col("kind").alias("kind2"),
        F.col("start").alias("start2"),
        F.col("stop").alias("stop2"),
        F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop")))).alias("cell"),
    )
    ident, secret = F.col("kind2").isin(1, 3), F.col("kind2").isin(0, 2, 4)
    completes = (
        F.when(F.col("kind") == 3, secret)
        .when(F.col("kind") == 4, ident)
        .otherwise(F.col("kind2").isin(0, 1, 2))
    )
    near = (F.col("start2") - F.col("stop") < reach) & (F.col("start") - F.col("stop2") < reach)
    return (
        null_safe(weak, other, [*KEY, "scope", "cell"])
        .where(completes & near)
        .select(*KEY, "kind", "start", "stop")
        .distinct()
    )


def secret_scan(
    docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, base, spans``, arrays of (start, kind, stop).

    Positions count code points and kinds index KINDS. ``base`` holds every base span; ``spans``
    adds weak candidates (bare identifiers, opaque tokens, endpoints) that have a complementary
    part within the reach in the same paragraph. Null and empty texts have no spans; repeated rows
    give equal rows; an empty table gives none. Whole texts are scanned, in slices.
    """
    found = materialize(secret_parts(docs, id_col, text_col), "secret-parts")
    span = F.struct("start", "kind", "stop")
    more = linked(found, reach).groupBy(*KEY).agg(F.collect_list(span).alias("more"))
    base = F.transform(
        F.filter("parts", lambda p: p["kind"] < 3),
        lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["stop"].alias("stop")),
    )
    return (
        null_safe(found, more, [*KEY], "left")
        .withColumn("base", F.array_sort(base))
        .withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.array()))))
        .select("doc_id", "base", "spans")
    )


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])
    return F.array_join(F.transform(spans, one), ",")


@query("op5_secret_scan")
def op5_secret_scan(spark, sf_dir):
    scan = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
