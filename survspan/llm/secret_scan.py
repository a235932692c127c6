"""Secret scan with corpus-wide ownership frequency.

Every text is searched for candidate credentials. The hash of each candidate's
value is counted over the whole corpus by distinct owners and repositories:
values that several owners hold, or two owners in several repositories, are copied
examples; all others are live where they look random, else unclear. The base kinds are always
reported. The further kinds (private keys, web tokens, prefixed tokens, opaque
random runs) are reported unless they are examples. A private key is its
whole block: to its END line, or without one as far as its base64 lines go, or else
the header alone. Its value is the key's body without line breaks and
indentation, so that each key counts its own owners.

The documents' `source` is the owner and (`source`, `lang`) the repository;
both are parameters.

Defined cases: a null text is empty; a null owner or repository counts as one
owner of that name; overlapping spans of different base kinds, and of base kinds and private keys, are all reported;
repeated rows get equal results; a document without candidates has empty spans;
an empty table gives an empty result. Only doc_id, text, owner and repository
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let, text_or_empty

# The base kinds.
ASSIGN_RE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_RE = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 and more characters
HEX_RE = r"[0-9a-f]{16,}"
# Further kinds, as one pattern; the kind is read off the match.
KEY_BEGIN, KEY_END = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-{5,}+END [A-Z ]*PRIVATE KEY-----"
GAP = r"(?:\s|\\[nrt])*+"  # also as written in string literals
KEY_RE = (KEY_BEGIN + r"(?:[^-]*+(?:-{1,4}+[^-]++)*+" + KEY_END  # possessive: a text is passed once
          + "|(?:" + GAP + r"(?:Proc-Type|DEK-Info): [^\n\\]*+)*+(?:" + GAP + "[A-Za-z0-9+/=]{32,}+)++)?")
MORE_RE = (KEY_RE + r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
           r"|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[A-Za-z0-9+/_-]{24,}")
KINDS = ("assign", "access", "hex", "pem", "jwt", "github", "slack", "opaque")
BASE = 3
EXAMPLE_OWNERS = 3  # held by so many owners: an example
COPIED_OWNERS, COPIED_REPOS = 2, 4  # or by so many owners in so many repositories
MASK = "[SECRET]"


def _found(text: Column, pattern: str) -> Column:
    """Array of (start, match): leftmost matches that do not overlap, in code points from 0."""
    def placed(matches):
        pairs = F.zip_with(matches, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)),
                           lambda m, gap: F.struct(m.alias("m"), F.char_length(gap).alias("gap")))
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,match:string>>)").alias("out"))
        return F.aggregate(pairs, begin, lambda a, p: F.struct(
            (a["at"] + p["gap"] + F.char_length(p["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), p["m"].alias("match")))).alias("out")),
            lambda a: a["out"])

    nothing = F.expr("cast(array() as array<struct<start:int,match:string>>)")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda m: F.when(F.size(m) == 0, nothing).otherwise(placed(m)))


def _candidates(text: Column) -> Column:
    def spans(found, rank, value=lambda m: m, wanted=None):
        out = F.transform(found, lambda x: F.struct(
            x["start"].alias("start"), (rank(x["match"]) if callable(rank) else F.lit(rank)).alias("rank"),
            (x["start"] + F.char_length(x["match"])).alias("end"), value(x["match"]).alias("value")))
        return F.filter(out, wanted) if wanted else out

    def kind(m):
        return (F.when(m.startswith("-----BEGIN"), 3).when(m.rlike(r"^eyJ[^.]*\."), 4).when(m.rlike("^gh[pousr]_"), 5)
                .when(m.rlike("^xox[abprs]-"), 6).otherwise(7))

    base = F.concat(
        spans(_found(text, ASSIGN_RE), 0, lambda m: F.regexp_extract(m, ASSIGN_RE, 1), lambda s: F.char_length(s["value"]) >= 12),
        spans(_found(text, ACCESS_RE), 1), spans(_found(text, HEX_RE), 2))
    more = spans(_found(text, MORE_RE), kind, _value, wanted=lambda s: (s["rank"] < 7) | _random(s["value"]))
    return let(base, lambda b: F.array_sort(F.concat(b, F.filter(more, lambda s: (s["rank"] == 3) | ~F.exists(
        b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))))))


def _value(match: Column) -> Column:
    """What is counted by owner: of a private key its body, the header where it has none."""
    body = F.regexp_replace(F.regexp_replace(match, f"^{KEY_BEGIN}|{KEY_END}$", ""), r"\\[nrt]|[^A-Za-z0-9+/=]", "")
    key = let(body, lambda b: F.when(b == "", F.regexp_extract(match, KEY_BEGIN, 0)).otherwise(b))
    return F.when(match.startswith("-----BEGIN"), key).otherwise(match)


def _random(value: Column) -> Column:
    """Digits, both cases, and at least ten different characters."""
    return (value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= 10))


def _looks_live(rank: Column, value: Column) -> Column:
    """At least eight different characters and a digit; private keys always."""
    return (rank == 3) | (value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owner, repo) -> distinct owners and repositories per hash, in partial sums: no hash gathers its rows."""
    held = found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"),
                                      F.sum("n").alias("n_copies"))


def _row(docs: DataFrame) -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).cast("string"))


def scan(docs: DataFrame, owner: str = "source", repo: tuple = ("source", "lang")) -> DataFrame:
    """One row per document: _row (its key), doc_id and `found`, the sorted reported spans with their verdicts."""
    named = F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner")
    where = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo]).alias("repo")
    seen = durable(docs.select(_row(docs).alias("_row"), "doc_id", named, where, _candidates(text_or_empty()).alias("c")))
    each = (seen.where(F.size("c") > 0).groupBy("_row", "owner", "repo").agg(F.first("c").alias("c"))
            .select("_row", "owner", "repo", F.explode("c").alias("s"))
            .withColumn("hash", F.sha2("s.value", 256)))
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | (
        (F.col("n_owners") >= COPIED_OWNERS) & (F.col("n_repos") >= COPIED_REPOS))
    verdict = (F.when(copied, "example").when(_looks_live(F.col("s.rank"), F.col("s.value")), "live").otherwise("unclear"))
    judged = (each.join(ownership(each), "hash").withColumn("verdict", verdict)
              .where((F.col("s.rank") < BASE) | (F.col("verdict") != "example"))
              .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
                  F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.end").alias("end"),
                  F.col("verdict").alias("verdict")))).alias("found")))
    nothing = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,verdict:string>>)")
    return (seen.select("_row", "doc_id").join(judged, "_row", "left")
            .withColumn("found", F.coalesce("found", nothing)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(docs: DataFrame) -> DataFrame:
    def count(name, test):
        return F.size(F.filter("found", test)).cast("long").alias(name)

    return scan(docs).select(
        "doc_id", count("n_assign", lambda s: s["rank"] == 0), count("n_access", lambda s: s["rank"] == 1),
        count("n_hex", lambda s: s["rank"] == 2),
        F.sha2(_joined(F.filter("found", lambda s: s["rank"] < BASE)), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"), count("n_live", lambda s: s["verdict"] == "live"),
        count("n_example", lambda s: s["verdict"] == "example"), count("n_unclear", lambda s: s["verdict"] == "unclear"))


def mask_live(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document stays; spans judged live are replaced by a mask.

    Overlapping spans share one mask; a null text stays null. Columns of any name pass through, n_chars is counted again.
    """
    live = (scan(docs).select("_row", F.filter("found", lambda s: s["verdict"] == "live").alias("live"))
            .where(F.size("live") > 0).groupBy("_row").agg(F.first("live").alias("live")))
    every = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.select(_row(docs).alias("_row"), F.struct(*every).alias("doc")).join(live, "_row", "left")
    text = F.col("doc.text")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("live", begin, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] < a["at"], a["out"]).otherwise(
            F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit(MASK))).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    clean = joined.select("doc", F.when(F.col("live").isNull(), text).otherwise(masked).alias("clean"))
    made = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("long")}
    return clean.select(*[made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
