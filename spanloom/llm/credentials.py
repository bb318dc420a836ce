"""Secret scans with multipart credential linking, in built-in functions only.

Base spans are strong patterns and always reported. Weak parts (logins, short passwords, key-shaped strings, endpoints)
are candidates only: an interval join within the text's scopes, stretches of SCOPE characters around a part, reports
them when complementary parts co-occur: a login beside a secret, a weak secret beside an identifier, an endpoint beside
both. Parts of a text are arrays in its row, so the join needs no shuffle and a text of many parts stays one row's work.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.staging import compute_once

#: Fixed patterns of the base spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED = 12

LOGIN = r"""(?i)(user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
SHORT = 6
KEY = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"""[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+"""
SCOPE = 240
KINDS = ["assign", "access", "hex", "login", "short", "key", "endpoint"]

_NONE = "array<struct<start:bigint,end:bigint,part:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that don't overlap as (start, end, part): code points, end exclusive; part is the group's text.

    The gaps between matches and the matches themselves are laid end to end, which gives their places.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), part.alias("part")), lambda z: z["hit"].isNotNull())
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_NONE).alias("out"))

    def step(acc, z):
        start = (acc["at"] + F.length(z["gap"])).cast("long")
        end = (start + F.length(z["hit"])).cast("long")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), z["part"].alias("part")))).alias("out"))

    found = F.aggregate(zipped, zero, step, lambda acc: acc["out"])
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), found).otherwise(F.array().cast(_NONE))


def _near(parts: Column, span: Column) -> Column:
    """Whether some part is in the span's scope."""
    return F.exists(parts, lambda p: (p["start"] <= span["end"] + SCOPE) & (span["start"] <= p["end"] + SCOPE))


def _overlaps(parts: Column, span: Column) -> Column:
    return F.exists(parts, lambda p: (p["start"] < span["end"]) & (span["start"] < p["end"]))


def _none() -> Column:
    return F.array().cast(_NONE)


def find_secrets(docs: DataFrame) -> DataFrame:
    """All columns of docs beside `_found`: a struct of one array of (start, end, part) for each of KINDS.

    A null text counts as empty. Columns of docs may have any names but those that begin with an underscore. Rows are
    independent of each other.
    """
    text = F.col("_text")
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    df = compute_once(df, F.struct(matches(text, ASSIGN, 2).alias("_assigned"), matches(text, ACCESS).alias("_access"), matches(text, HEX).alias("_hex"), matches(text, LOGIN).alias("_logins")))
    assign = F.filter("_assigned", lambda s: F.length(s["part"]) >= ASSIGNED)
    short = F.filter("_assigned", lambda s: F.length(s["part"]).between(SHORT, ASSIGNED - 1))
    known = F.size("_access") + F.size("_logins") > 0
    df = compute_once(df, F.struct(assign.alias("_assign"), short.alias("_shorts"), F.when(known, matches(text, KEY)).otherwise(_none()).alias("_keys")))
    secrets = F.concat("_assign", "_shorts", "_hex", "_keys")
    parts = known & (F.size("_assign") + F.size("_shorts") + F.size("_hex") + F.size("_keys") > 0)
    df = compute_once(df, F.struct(
        F.concat("_access", "_logins").alias("_who"), secrets.alias("_secrets"), F.concat("_assign", "_access", "_hex").alias("_base"),
        F.when(parts, matches(text, ENDPOINT)).otherwise(_none()).alias("_ends"),
    ))
    who, hidden = F.col("_who"), F.col("_secrets")
    return compute_once(df, F.struct(F.struct(
        F.col("_assign").alias("assign"), F.col("_access").alias("access"), F.col("_hex").alias("hex"),
        F.filter("_logins", lambda s: _near(hidden, s)).alias("login"),
        F.filter("_shorts", lambda s: _near(who, s)).alias("short"),
        F.filter("_keys", lambda s: _near(who, s) & ~_overlaps(F.col("_base"), s)).alias("key"),
        F.filter("_ends", lambda s: _near(who, s) & _near(hidden, s)).alias("endpoint"),
    ).alias("_found"))).select(*[f"`{c}`" for c in docs.columns], "_found")


def _all_spans(kinds: list[str]) -> Column:
    """(start, order of kind, kind, end) of the spans found, sorted."""

    def of(kind: str) -> Column:
        order = F.lit(KINDS.index(kind))
        return F.transform(
            F.col(f"_found.{kind}"),
            lambda s: F.struct(s["start"].alias("start"), order.alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")),
        )

    one = [of(kind) for kind in kinds]
    return F.sort_array(F.concat(*one))


def _listed(kinds: list[str]) -> Column:
    return F.array_join(F.transform(_all_spans(kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row (doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of docs.

    spans lists all spans reported as kind:start:end by start, then by KINDS, joined by commas; base_sha256 is the digest
    of the same list of base spans alone, that of the empty string where there are none.
    """
    found = find_secrets(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(f"_found.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every reported span of a text replaced by a mark, overlapping spans by one; n_chars follows the text."""
    found = compute_once(find_secrets(docs), F.struct(_all_spans(KINDS).alias("_spans")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate("_spans", zero, step, lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    hit = F.size("_spans") > 0
    out = found.withColumn("_clean", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("_clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("_clean")).select(*[f"`{c}`" for c in docs.columns])
