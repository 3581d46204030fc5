"""Secret scans with multipart credential linking (DataFrame functions only).

Strong spans stand alone: assignments with a long value, access ids, long hexadecimal strings. Weak
candidates (shorter ones, and endpoints) are reported only where complementary parts co-occur: an
identifier with a secret, a secret with an identifier or an endpoint, an endpoint with a secret. Parts
co-occur within a scope of ``SCOPE`` code points in one document. The interval join is a sweep: over the
parts in order of start, the running maximum of ends and the following minimum of starts per role say
whether a part of that role reaches into the scope, so no pairs are formed.

Positions come from splitting the text at the matches: the lengths of the pieces and the matches add up.

Defined cases: null and empty texts have no spans; rows that share a doc_id are scanned each on their own;
ties in start are ordered by kind as listed in KINDS; a text of any length is scanned whole, only its parts leave the row;
only doc_id and text are read, so other columns don't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfabric.llm.shared import documents

#: The patterns of the base spans and of the weak candidates, and least lengths.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{8,}"
HEX = r"[0-9a-f]{12,}"
ENDPOINT = r"https?://[^\x20\x09-\x0D\"'<>]+"
KINDS = ("assign", "access", "hex", "weak_assign", "weak_access", "weak_hex", "endpoint")
STRONG = {"assign": 12, "access": 18, "hex": 16}
WEAK = {"assign": 6, "access": 12, "hex": 12}
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "endpoint": "endpoint"}
PARTNERS = {"secret": ("id", "endpoint"), "id": ("secret",), "endpoint": ("secret",)}
SCOPE = 256


def _hits(text: Column, family: str, pattern: str, gate: Column, group: int = 0) -> Column:
    """An array of (family, i, gap, length, value) of all leftmost matches, in order."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.arrays_zip(hits.alias("hit"), pieces.alias("piece"), values.alias("value"))
    rows = F.filter(rows, lambda x: x["hit"].isNotNull())
    rows = F.transform(
        rows,
        lambda x, i: F.struct(
            F.lit(family).alias("family"),
            i.alias("i"),
            F.length(x["piece"]).alias("gap"),
            F.length(x["hit"]).alias("length"),
            F.length(x["value"]).alias("value"),
            x["hit"].rlike("[0-9]").alias("digit"),
        ),
    )
    return F.when(gate, rows).otherwise(F.array().cast("array<struct<family:string,i:int,gap:int,length:int,value:int,digit:boolean>>"))


def parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, role, strong): one row per part, one with nulls for a text without."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(
        _hits(text, "assign", ASSIGN, text.rlike(ASSIGN), 2),
        _hits(text, "access", ACCESS, text.contains("AKIA")),
        _hits(text, "hex", HEX, text.rlike(HEX)),
        _hits(text, "endpoint", ENDPOINT, text.contains("://")),
    )
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", F.explode_outer(found).alias("p"))
    rows = rows.select("row", "doc_id", "p.*").repartition("row")
    upto = Window.partitionBy("row", "family").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    kind = F.when(F.col("family") == "endpoint", F.lit("endpoint"))
    for family, least in STRONG.items():
        kind = kind.when((F.col("family") == family) & (F.col("value") >= least), F.lit(family))
    for family, least in WEAK.items():
        weak = (F.col("family") == family) & (F.col("value") >= least)
        kind = kind.when(weak & F.col("digit") if family == "hex" else weak, F.lit(f"weak_{family}"))
    role = F.lit(None).cast("string")
    for family, r in ROLE.items():
        role = F.when(F.col("family") == family, F.lit(r)).otherwise(role)
    rows = rows.withColumn("kind", kind)
    role = F.when(F.col("kind").isNotNull(), role)
    return rows.select("row", "doc_id", "kind", "start", "end", role.alias("role"), F.col("kind").isin(*STRONG).alias("strong"))


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``rows`` with ``near``: whether a complementary part lies within the scope."""
    order = Window.partitionBy("row").orderBy("start")
    back = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = F.lit(False)
    for role, partners in PARTNERS.items():
        for partner in partners:
            ends = F.max(F.when(F.col("role") == partner, F.col("end"))).over(back)
            starts = F.min(F.when(F.col("role") == partner, F.col("start"))).over(ahead)
            hit = F.coalesce(ends >= F.col("start") - scope, F.lit(False)) | F.coalesce(starts <= F.col("end") + scope, F.lit(False))
            near = near | ((F.col("role") == role) & hit)
    return rows.withColumn("near", F.coalesce(near, F.lit(False)))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, found (array of kind, start, end), base spans first class.

    Starts and ends are code points, end exclusive. Strong spans and linked weak ones are in ``found``.
    """
    rows = linked(parts(docs))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    kept = F.when(F.col("strong") | (F.col("near") & F.col("kind").isNotNull()), F.struct("start", rank.alias("rank"), "kind", "end", "strong"))
    out = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(kept)).alias("found"))
    return out.select("doc_id", "found")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    number = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = said(F.filter("found", lambda x: x["strong"]))
    return found.select("doc_id", *map(number, STRONG), F.sha2(base, 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
