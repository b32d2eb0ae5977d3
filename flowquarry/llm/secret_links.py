"""Secret scans with linking of multipart credentials. DataFrame functions only.

Strong findings (assigned values, access identifiers, long hexadecimal runs) are reported wherever they stand. Weak
candidates are reported only where parts complement each other: a weak secret near an identifier or an endpoint, a weak
identifier near a secret. Parts meet in an interval join within a document: scopes of SCOPE code points are numbered,
each candidate is entered for every scope it covers, each part for every scope that it covers when widened by SCOPE on both
sides, and candidates are kept by a semi-join on document and scope under a limit on the gap from the end of one to the
start of the other, so no pairs are made.

Cases: null and empty texts have no findings; equal rows are scanned alike and each is returned; rows that share a doc_id
with different texts are kept apart by a hash of the text; a null doc_id is a document like any other; an empty table
gives an empty table; only doc_id and text are read, so other columns do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowquarry.llm.text import spans
from flowquarry.session import scratch_path

SCOPE = 240
KINDS = ("assign", "access", "hex")
NAMES = "(?i:password|passwd|secret|token|api_?key)"
GAP = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = NAMES + GAP + "([A-Za-z0-9+/_.=-]++)"
ACCESS = "AKIA[A-Z0-9]{14,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{16,}+"
#: Names that identify an account, without being secret themselves.
IDENTIFIER = r"(?i:access_?key_?id|client_?id|user_?name|account_?id|login)" + GAP + "([A-Za-z0-9+/_.@=-]{3,}+)"
#: Long runs that mix upper case, lower case and digits.
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"
ENDPOINT = r"https?://[A-Za-z0-9./_:-]++"


def _plain(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))


def _free(found: Column, *taken: Column) -> Column:
    """Spans that do not overlap any of the others."""
    every = F.concat(*taken)
    return F.filter(found, lambda x: ~F.exists(every, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])))


def scan(text: Column) -> Column:
    """Struct of span arrays: assign, access, hex, weak_secret, weak_id, endpoint."""
    named = text.rlike("(?i:passw|secret|token|api_?key)")
    assigned = spans(text, ASSIGN, 1, only=named)
    return F.struct(
        assigned.alias("assigned"),
        spans(text, ACCESS, only=F.contains(text, F.lit("AKIA"))).alias("access"),
        spans(text, HEX, only=text.rlike("[0-9a-f]{16}")).alias("hex"),
        spans(text, IDENTIFIER, only=text.rlike(r"(?i:_?id|name|login)" + GAP)).alias("named"),
        spans(text, OPAQUE, only=text.rlike("[A-Za-z0-9+/_-]{20}")).alias("opaque"),
        spans(text, ENDPOINT, only=F.contains(text, F.lit("://"))).alias("endpoint"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id and arrays of (kind, start, stop): ``base`` and ``linked``. Text is read once and not shuffled."""
    spark = docs.sparkSession
    path = scratch_path(spark, "secret-parts")
    long_ = F.filter("f.assigned", lambda x: F.length(x["hit"]) >= 12)
    short = F.filter("f.assigned", lambda x: F.length(x["hit"]).between(6, 11))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), scan(F.col("text")).alias("f"))
    strong = found.select("doc_id", "text_key", _plain(long_).alias("assign"), _plain(F.col("f.access")).alias("access"), _plain(F.col("f.hex")).alias("hex"),
                          _plain(short).alias("short"), _plain(F.col("f.opaque")).alias("opaque"), _plain(F.col("f.named")).alias("named"), _plain(F.col("f.endpoint")).alias("endpoint"))
    taken = [F.col(c) for c in KINDS]
    (strong.withColumn("weak_secret", F.concat("short", _free(F.col("opaque"), F.col("short"), F.col("endpoint"), F.col("named"), *taken)))
     .withColumn("weak_id", _free(F.col("named"), F.col("short"), *taken))
     .drop("short", "opaque", "named").write.parquet(path))
    parts = spark.read.parquet(path)
    role = lambda name, column: F.transform(column, lambda x: F.struct(F.lit(name).alias("role"), x["start"].alias("start"), x["stop"].alias("stop")))
    some = parts.where("size(weak_secret) + size(weak_id) > 0 and size(assign) + size(access) + size(hex) + size(weak_secret) + size(weak_id) + size(endpoint) > 1")
    each = some.select("doc_id", "text_key", F.explode(F.concat(
        role("secret", F.col("assign")), role("secret", F.col("hex")), role("id", F.col("access")), role("endpoint", F.col("endpoint")),
        role("weak_secret", F.col("weak_secret")), role("weak_id", F.col("weak_id")))).alias("part")).select("doc_id", "text_key", "part.*").distinct()
    cells = lambda widened: F.explode(F.sequence(F.floor((F.col("start") - widened) / scope), F.floor((F.col("stop") + widened) / scope)))
    weak = each.where(F.col("role").startswith("weak")).select("*", cells(0).alias("cell"))
    near = each.select(F.col("doc_id").alias("n_doc"), F.col("text_key").alias("n_key"), F.col("role").alias("n_role"), F.col("start").alias("n_start"), F.col("stop").alias("n_stop"),
                       cells(scope).alias("n_cell"))
    joins = (weak["doc_id"].eqNullSafe(near["n_doc"]) & (weak["text_key"] == near["n_key"]) & (weak["cell"] == near["n_cell"])
             & (near["n_start"] - weak["stop"] <= scope) & (weak["start"] - near["n_stop"] <= scope)
             & F.when(weak["role"] == "weak_secret", near["n_role"].isin("id", "weak_id", "endpoint")).otherwise(near["n_role"].isin("secret", "weak_secret")))
    linked = (weak.join(near, joins, "left_semi").withColumn("kind", F.when(F.col("role") == "weak_secret", "secret").otherwise("identifier"))
              .groupBy(F.col("doc_id").alias("l_doc"), F.col("text_key").alias("l_key")).agg(F.collect_set(F.struct("start", "stop", "kind")).alias("linked")))
    out = parts.join(linked, parts["doc_id"].eqNullSafe(linked["l_doc"]) & (parts["text_key"] == linked["l_key"]), "left")
    kind = lambda name: F.transform(F.col(name), lambda x: F.struct(F.lit(name).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    more = F.transform(F.coalesce("linked", F.array().cast("array<struct<start:bigint,stop:bigint,kind:string>>")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return out.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.concat(*map(kind, KINDS)).alias("base"), more.alias("linked"))


def listed(found: Column, order: tuple[str, ...] = (*KINDS, "identifier", "secret")) -> Column:
    """kind:start:stop texts by start, then kind, joined by commas."""
    ranked = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, order)), x["kind"]).alias("rank"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


