"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates come from three patterns. The hash of each candidate value is
counted by distinct repositories and distinct owners over the whole corpus;
equal texts are one repository. A value is a copied example if more than
``most_owners`` owners hold it in more than ``most_owners`` repositories, or
if more than ``most_repositories`` repositories hold it, whatever their
owners. A value of few owners and few repositories with enough different
characters and a digit looks live, and its place is added as a ``live`` span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needscope.sources.scratch import settle

# Kind, pattern, group that holds the value, least length. A run
# of at least 16 hex digits, or 4 + 14 capitals, is the same as a longest run
# that passes the length test; only "assign" can resume inside a failed match.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
SALTS = 16
STEP = 64


def scan_secrets(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    most_owners: int = 2,
    least_characters: int = 8,
    most_repositories: int = 10,
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied), one row per row.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by
    start and then kind (assign, access, hex, live). Null text is empty text.
    Null owners count as one owner, null repositories as one repository.
    Repeated rows keep their rows and count once for ownership; rows of equal
    text count as the least of their repositories. Extra columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id).alias("doc_id"), F.col(repository).alias("repository"), F.col(owner).alias("owner"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    for number, (kind, pattern, group, least) in enumerate(KINDS):
        rows = _find(rows, number, kind, pattern, group, least)
    spans = F.array_sort(F.concat(*[kind for kind, *_ in KINDS]))
    # the written number tells repeated rows apart
    base = settle(
        rows.select("doc_id", "repository", "owner", F.xxhash64("text").alias("digest"), spans.alias("spans")).withColumn("row", F.monotonically_increasing_id()), "spans"
    )
    values = base.where(F.size("spans") > 0).select(
        "row", "repository", "owner", "digest", F.explode(F.array_distinct("spans.value")).alias("value")
    )
    values = values.withColumn("hash", F.sha2("value", 256))
    by_owner = values.groupBy("hash", "owner").agg(F.first("value").alias("value"))
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.first("value").alias("value"))
    by_text = values.groupBy("hash", "digest").agg(F.min("repository").alias("repository"))
    repositories = by_text.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    varied = F.size(F.array_distinct(F.split("value", ""))) >= least_characters
    many = F.col("repositories") > most_repositories
    known = owners.join(repositories, "hash").select(
        "hash",
        ((F.col("owners") <= most_owners) & ~many & varied & F.col("value").rlike("[0-9]")).alias("live"),
        (many | (F.col("owners") > most_owners) & (F.col("repositories") > most_owners)).alias("copied"),
    )
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = values.select("row", "hash", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")).join(spread, ["hash", "salt"])
    told = told.groupBy("row").agg(
        F.collect_set(F.when(F.col("live"), F.col("hash"))).alias("live"), F.count_if("copied").alias("n_copied")
    )
    full = base.join(told, "row", "left")
    live = F.filter("spans", lambda span: F.array_contains("live", F.sha2(span["value"], 256)))
    extra = F.array_distinct(
        F.transform(live, lambda s: F.struct(s["value_start"].alias("start"), F.lit(len(KINDS)).alias("order"), F.lit("live").alias("kind"), s["end"].alias("end")))
    )
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end")))
    everything = F.array_sort(F.concat(plain, F.coalesce(extra, F.array())))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return full.select(
        "doc_id", *[count(kind) for kind, *_ in KINDS],
        F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"),
        _joined(everything).alias("spans"),
        F.coalesce(F.size(extra), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _find(rows: DataFrame, order: int, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """Add the array ``kind`` of (start, order, kind, end, value, value_start).

    Starts are running sums over the texts between matches and the matches
    themselves, summed in steps so that many matches stay cheap.
    """
    some = F.col("text").rlike(pattern)
    none = F.array().cast("array<string>")
    pick = lambda value: F.when(some, value).otherwise(none)
    columns = [name for name in rows.columns]
    found = rows.select(
        *columns,
        pick(F.split("text", pattern, -1)).alias("__between"),
        pick(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("__whole"),
        pick(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("__value"),
    )
    gap = lambda match, i: F.length(F.get("__between", i)) + F.when(i == 0, 0).otherwise(F.length(F.get("__whole", i - 1)))
    add = lambda total, x: total + x
    zero = F.lit(0)
    found = found.withColumn("__gaps", F.transform("__whole", gap))
    steps = F.sequence(zero, F.floor((F.size("__gaps") - 1) / STEP).cast("int"))
    sums = F.transform(steps, lambda b: F.aggregate(F.slice("__gaps", b * STEP + 1, STEP), zero, add))
    found = found.withColumn("__sums", F.when(F.size("__gaps") > 0, sums).otherwise(F.array().cast("array<int>")))
    found = found.withColumn("__before", F.transform("__sums", lambda s, b: F.aggregate(F.slice("__sums", F.lit(1), b), zero, add)))

    def start(gap_: Column, i: Column) -> Column:
        block = F.floor(i / STEP).cast("int")
        inside = F.aggregate(F.slice("__gaps", block * STEP + 1, i - block * STEP + 1), zero, add)
        return F.get("__before", block) + inside

    found = found.withColumn("__starts", F.transform("__gaps", start))

    def span(match: Column, i: Column) -> Column:
        begin, value = F.get("__starts", i), F.get("__value", i)
        end = begin + F.length(match)
        return F.struct(
            begin.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end"),
            value.alias("value"), (end - F.length(value)).alias("value_start"),
        )

    kept = F.filter(F.transform("__whole", span), lambda s: F.length(s["value"]) >= least)
    return found.withColumn(kind, kept).select(*columns, kind)
