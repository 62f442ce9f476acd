"""Secret scan with multipart credential linking, in DataFrame operations alone.

Base detection finds assignments of secrets, access identifiers and long hexadecimal strings. Regular
expressions give no offsets in SQL, but the pieces between matches do: a match starts after all pieces and
matches before it.

Weak candidates - a random-looking token that could be a secret, a named identifier, an endpoint - mean
little alone. Those and the strong parts of texts that have any weak candidate are exploded, and interval
joins on (document, cells of SCOPE characters that a part touches) with a distance condition link them: a weak secret
needs an identifier with at most SCOPE characters between them, a weak identifier a secret, an endpoint both. Parts
may be of any length. Semi-joins answer that
without making pairs. Only spans move, never texts.

Defined results: a null text counts as empty; no spans give the hash of the empty string and an empty list;
repeated rows repeat; null doc_ids are matched null-safely; extra columns are ignored. Offsets count code
points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import text_of, written

SCOPE = 400
#: kind: pattern, and the group that must be long enough with that length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "weak_secret": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}+(?![A-Za-z0-9+/_-])", 0, 32),
    "weak_ident": (r"(?i)(?<![A-Za-z0-9])(?:client|account|user|app|access)[_-]?(?:id|key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._-]{4,}", 0, 8),
    "endpoint": (r"(?i)(?<![A-Za-z0-9])(?:https?|postgres|mysql|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!&*+,;=%-]{4,}+", 0, 8),
}
ORDER = (*BASE, *WEAK)
SECRET, IDENTIFIER = ("assign", "hex", "weak_secret"), ("access", "weak_ident")


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, rank, end, kind) of the pattern's matches whose group has at least `least` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)
    item = F.arrays_zip(pieces.alias("piece"), found.alias("match"), tested.alias("tested"))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    start = lambda acc, x: acc["at"] + F.length(x["piece"])
    span = lambda acc, x: F.struct(
        start(acc, x).alias("start"), F.lit(ORDER.index(kind)).alias("rank"), (start(acc, x) + F.length(x["match"])).alias("end"), F.lit(kind).alias("kind")
    )
    step = lambda acc, x: F.struct(
        (start(acc, x) + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"),
        F.when(F.length(x["tested"]) >= least, F.concat(acc["out"], F.array(span(acc, x)))).otherwise(acc["out"]).alias("out"),
    )
    walked = F.aggregate(item, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(nothing)


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, base spans and weak spans (those that meet no base span) of every row."""
    text = F.col("text")
    base = F.array_sort(F.concat(*(spans(text, kind, *how) for kind, how in BASE.items())))
    weak = F.concat(*(spans(text, kind, *how) for kind, how in WEAK.items()))
    apart = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return (
        text_of(documents).select("doc_id", F.xxhash64("text").alias("text_hash"), base.alias("base"), weak.alias("weak"))
        .withColumn("weak", apart)
    )


def linked(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, span of each weak candidate whose complementary parts are in its scope."""
    key = ["doc_id", "text_hash"]
    parts = (
        found.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).select(*key, F.explode(F.concat("base", "weak")).alias("s"))
        .select(*key, "s", F.explode(F.sequence(F.floor(F.col("s.start") / SCOPE), F.floor(F.col("s.end") / SCOPE))).alias("cell")).distinct()
    )
    parts = written(parts, "parts")
    weak = parts.where(F.col("s.kind").isin(*WEAK))

    def near(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        """The rows with a part of one of the kinds within SCOPE characters: interval semi-join."""
        other = parts.where(F.col("s.kind").isin(*kinds)).select(F.col("doc_id").alias("i"), F.col("text_hash").alias("t"), F.col("s").alias("p"), F.col("cell").alias("c"))
        seen = rows.withColumn("around", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
        meets = (
            F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")) & (F.col("around") == F.col("c"))
            & (F.greatest(F.col("p.start") - F.col("s.end"), F.col("s.start") - F.col("p.end")).between(0, SCOPE))
        )
        return seen.join(other, meets, "left_semi").select(*key, "s", "cell").distinct()

    secrets = near(weak.where(F.col("s.kind") == "weak_secret"), IDENTIFIER)
    idents = near(weak.where(F.col("s.kind") == "weak_ident"), SECRET)
    endpoints = near(near(weak.where(F.col("s.kind") == "endpoint"), IDENTIFIER), SECRET)
    return secrets.unionByName(idents).unionByName(endpoints).select(*key, "s").distinct()


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, base (array of spans) and spans (base and linked ones) of every row."""
    found = written(candidates(documents), "secrets")
    added = linked(found).groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")).agg(F.collect_list("s").alias("added"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t"))
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return found.join(added, same, "left").select("doc_id", "base", every.alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans, of `scan`'s rows."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
