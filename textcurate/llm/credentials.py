"""Secret scan with multipart linking (native).

Strong patterns are reported wherever they occur. A credential also comes in
parts: an identifier, a secret and an endpoint. Each part alone is weak evidence
(any long mixed token could be a secret), so weak parts are reported only when
complementary parts lie close by within one scope. Scopes are the sections of a
text between blank lines; closeness is an interval join of the spans, widened by
``reach`` code points, on buckets of that width, so no pair of distant spans is
ever formed.

Spans are half-open code point intervals. Everything is Column expressions: the
gaps between matches (``split``) and the matches (``regexp_extract_all``) give
the offsets by a running sum per document and kind.

Defined cases: a null or empty text has no spans; rows with equal doc_id and
text are repeats and get equal results; an empty table gives an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import same_row, text_key, whole_text, written


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    role: str  # identifier, secret or endpoint
    weak: bool
    gate: str  # a cheaper regex that every match implies
    group: int = 0  # the group whose length counts
    least: int = 1  # shortest such group that is reported


# Patterns in reporting order.
PATTERNS = [
    Pattern("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            "secret", False, r"(?i:password|passwd|secret|token|api_?key)", 2, 6),
    Pattern("access", r"AKIA[A-Z0-9]+", "identifier", False, r"AKIA", 0, 20),
    Pattern("hex", r"[0-9a-f]{24,}", "secret", False, r"[0-9a-f]{24}"),
    Pattern("link_id", r"""(?i:client_?id|access_?key_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
            r"""|(?<![A-Z0-9])(?:ASIA|AROA|AIDA)[A-Z0-9]{16,}""",
            "identifier", True, r"(?i:client_?id|access_?key_?id|account_?id|user|login)|ASIA|AROA|AIDA"),
    Pattern("link_secret", r"""(?<![A-Za-z0-9+/=_-])(?=[a-zA-Z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])""",
            "secret", True, r"[A-Za-z0-9+/_-]{20}"),
    Pattern("link_endpoint", r"""(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?i:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}(?::[0-9]{2,5})?""",
            "endpoint", True, r"(?i:://|host|endpoint|server)"),
]
ORDER = {p.kind: i for i, p in enumerate(PATTERNS)}


def _matches(text, p: Pattern, i: int):
    """Per match: kind, index, characters and blank lines in the gap before it,
    its length, whether it is long enough. One empty array for most texts."""
    gaps = F.split(text, p.regex, -1)
    found = F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.group)) if p.group else found
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"), checked.alias("c"))
    rows = F.transform(zipped, lambda z, k: F.struct(
        F.lit(i).alias("kind"), k.alias("idx"), F.char_length(z["g"]).cast("long").alias("gap"),
        (F.size(F.split(z["g"], "\n[\\x20\\t]*\n")) - 1).cast("long").alias("breaks"),
        F.char_length(z["m"]).cast("long").alias("len"), (F.char_length(z["c"]) >= p.least).alias("ok")))
    return F.when(text.rlike(p.gate), rows)


def find_spans(docs: DataFrame) -> DataFrame:
    """All pattern matches: doc_id, text_key, kind (index), start, end, section."""
    rows = docs.select(F.col("doc_id"), whole_text().alias("text"))
    hits = rows.select("doc_id", text_key(F.col("text")).alias("text_key"),
                       F.explode(F.flatten(F.array_compact(F.array(
                           *[_matches(F.col("text"), p, i) for i, p in enumerate(PATTERNS)])))).alias("s"))
    hits = hits.select("doc_id", "text_key", "s.*").dropDuplicates(["doc_id", "text_key", "kind", "idx"])
    # a running sum inside one document and kind: bounded by the document
    run = Window.partitionBy("doc_id", "text_key", "kind").orderBy("idx")
    return (hits.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run))
            .withColumn("section", F.sum("breaks").over(run))
            .filter("ok")
            .select("doc_id", "text_key", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "section"))


def _role(column):
    mapping = F.create_map(*[x for p in PATTERNS for x in (F.lit(ORDER[p.kind]), F.lit(p.role))])
    return mapping[column]


def link_parts(spans: DataFrame, reach: int = 200) -> DataFrame:
    """The weak spans whose complementary parts co-occur in their section within
    ``reach`` code points: a weak identifier needs a secret, a weak secret needs
    an identifier or an endpoint, an endpoint needs an identifier and a secret."""
    weak_kinds = [ORDER[p.kind] for p in PATTERNS if p.weak]
    width = F.lit(reach)
    parts = spans.withColumn("role", _role(F.col("kind")))
    probe = parts.filter(F.col("kind").isin(weak_kinds)).withColumn("bucket", F.explode(F.sequence(
        F.floor((F.col("start") - width) / width), F.floor((F.col("end") + width) / width))))
    other = parts.select(
        F.col("doc_id").alias("o_doc"), F.col("text_key").alias("o_key"), F.col("section").alias("o_section"),
        F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("o_bucket"))
    near = probe.join(other, probe["doc_id"].eqNullSafe(other["o_doc"]) & (F.col("text_key") == F.col("o_key"))
                      & (F.col("section") == F.col("o_section")) & (F.col("bucket") == F.col("o_bucket"))
                      & (F.col("role") != F.col("o_role"))
                      & (F.col("o_start") <= F.col("end") + width) & (F.col("o_end") >= F.col("start") - width))
    seen = near.groupBy("doc_id", "text_key", "kind", "role", "start", "end").agg(
        *[F.max((F.col("o_role") == r).cast("int")).alias(r) for r in ("identifier", "secret", "endpoint")])
    linked = (F.when(F.col("role") == "identifier", F.col("secret") == 1)
              .when(F.col("role") == "secret", (F.col("identifier") == 1) | (F.col("endpoint") == 1))
              .otherwise((F.col("identifier") == 1) & (F.col("secret") == 1)))
    return seen.filter(linked).select("doc_id", "text_key", "kind", "start", "end")


def scan_credentials(docs: DataFrame, reach: int = 200) -> DataFrame:
    """One row per document: doc_id, and ``found``, an array of
    (start, kind index, end) in reporting order; empty when nothing is found."""
    # the strong spans and both sides of the interval join read them: texts are scanned once
    spans = written(find_spans(docs), "spans")
    strong = [ORDER[p.kind] for p in PATTERNS if not p.weak]
    reported = spans.filter(F.col("kind").isin(strong)).select("doc_id", "text_key", "kind", "start", "end").unionByName(
        link_parts(spans, reach))
    per_doc = reported.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    rows = docs.select(F.col("doc_id"), text_key(whole_text()).alias("text_key"))
    return rows.join(per_doc, same_row(rows, per_doc), "left").select(
        rows["doc_id"], F.coalesce(per_doc["found"], F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("found"))


def credential_digest(docs: DataFrame, reach: int = 200) -> DataFrame:
    """The contract's columns: counts of the strong kinds and the span strings."""
    found = F.col("found")
    names = F.array(*[F.lit(p.kind) for p in PATTERNS])
    n_strong = sum(not p.weak for p in PATTERNS)

    def joined(arr):
        return F.array_join(F.transform(arr, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(found, lambda s: s["kind"] == ORDER[kind])).cast("long")

    strong_only = F.filter(found, lambda s: s["kind"] < n_strong)
    return scan_credentials(docs, reach).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(strong_only), 256).alias("base_sha256"), joined(found).alias("spans"),
        (F.size(found) - F.size(strong_only)).cast("long").alias("n_linked"))
