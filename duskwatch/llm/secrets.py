"""Secrets in texts, judged by who else holds the same value (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import scratch, settled

#: Kind, expression, group of the secret value, least length of that group.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Long mixed runs without a name before them: reported only where the corpus shows one owner.
OWNED = ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
KINDS = (*BASE, OWNED)
PLACEHOLDER = r"(?i)example|sample|changeme|your|dummy|placeholder|xxxx|test"


def _found(text: Column, kind: tuple) -> Column:
    """Matches as (kind, number, characters before it since the last one, length, hash, whether it looks live).

    The hash is of the value and null where the match counts for nothing; the value itself goes no farther than this.
    """
    name, regex, group, least = kind
    gaps = F.split(text, regex, -1)
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"),
            F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("v"),
            F.slice(F.transform(gaps, F.length), 1, F.size(gaps) - 1).alias("g"),
        ),
        lambda z, i: F.struct(
            F.lit(name).alias("kind"), i.alias("n"), z["g"].alias("gap"), F.length(z["m"]).alias("len"),
            F.when(_counts(z["v"], name, least), F.sha2(z["v"], 256)).alias("hash"), _looks_live(z["v"]).alias("live_looking"),
        ),
    )


def _counts(value: Column, kind: str, least: int) -> Column:
    long_enough = F.length(value) >= least
    return long_enough & value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]") if kind == OWNED[0] else long_enough


def _looks_live(value: Column) -> Column:
    return (_distinct_characters(value) >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)


def _matches(text: Column) -> Column:
    none = F.array().cast("array<struct<kind:string,n:int,gap:int,len:int,hash:string,live_looking:boolean>>")
    return F.concat(*[F.when(text.rlike(kind[1]), _found(text, kind)).otherwise(none) for kind in KINDS])


def _distinct_characters(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def secret_candidates(docs: DataFrame, key: str, text: str, repo: Column, owner: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): one row per input row, and every candidate with its place and the hash of its value.

    The value itself is written nowhere. Places come from a running sum over a row's matches of one kind,
    so a text with very many matches costs no more per match than others.
    """
    rows = settled(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), repo.alias("repo"), owner.alias("owner"),
            _matches(F.coalesce(F.col(text), F.lit(""))).alias("found"),
        ),
        "secret-matches",
    )
    so_far = Window.partitionBy("rid", "kind").orderBy("n")
    order = F.create_map(*[F.lit(x) for i, (name, *_) in enumerate(KINDS) for x in (name, i)])
    spans = (
        rows.select("rid", "repo", "owner", F.explode("found").alias("f")).select("rid", "repo", "owner", "f.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far))
        .filter("hash is not null")
        .select(
            "rid", "repo", "owner", "kind", order[F.col("kind")].alias("kind_ord"),
            (F.col("end") - F.col("len")).alias("start"), "end", "hash", "live_looking",
        )
    )
    return rows.select("rid", "doc_id"), spans


def ownership(spans: DataFrame) -> DataFrame:
    """Per value: occurrences, distinct repositories and distinct owners, counted in three shrinking steps."""
    return (
        spans.groupBy("hash", "owner", "repo").count()
        .groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("count").alias("n"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("occurrences"))
    )


def scan_secrets(
    docs: DataFrame, repo: Column, owner: Column, key: str = "doc_id", text: str = "text", max_owners: int = 2
) -> DataFrame:
    """Per row: the secrets in its whole text, and which of them look live.

    A value is *live* if it looks like a credential and at most ``max_owners`` owners hold it, else
    *copied* (an example, a fixture, a hash of a public file). Named and well-known forms are always
    reported; long mixed runs without a name (kind ``owned``) only where they are live, hold a capital, a small
    letter and a digit, and overlap no other span. A null or empty text has no spans; a null owner or
    repository counts as one of its own; every input row, repeated ones too, gets one row; an empty
    table gives none. The join by value may be skewed by a widely copied one; both its sides come straight
    from a shuffle that Spark can split.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_judged(*secret_candidates(docs, key, text, repo, owner), max_owners), "secrets")


def _judged(rows: DataFrame, spans: DataFrame, max_owners: int) -> DataFrame:
    judged = spans.join(settled(ownership(spans), "secret-owners"), "hash").withColumn("live", F.col("live_looking") & (F.col("owners") <= max_owners))
    span = F.struct("start", "kind_ord", "end", "kind", "live", "owners", "repos")
    per_row = judged.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("all"))
    base = F.filter("all", lambda s: s["kind"] != "owned")
    extra = F.filter(
        "all",
        lambda s: (s["kind"] == "owned") & s["live"]
        & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda a, test: F.size(F.filter(a, test)).cast("long")
    of_kind = lambda name: lambda s: s["kind"] == name
    none = F.array().cast("array<struct<start:bigint,kind_ord:int,end:bigint,kind:string,live:boolean,owners:bigint,repos:bigint>>")
    return (
        rows.join(per_row, "rid", "left")
        .withColumn("all", F.coalesce("all", none))
        .withColumn("base", base)
        .withColumn("kept", F.array_sort(F.concat("base", extra)))
        .select(
            "doc_id",
            *[count("base", of_kind(name)).alias(f"n_{name}") for name, *_ in BASE],
            F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
            joined(F.col("kept")).alias("spans"),
            count("kept", lambda s: s["live"]).alias("n_live"),
            count("kept", lambda s: ~s["live"]).alias("n_copied"),
            F.coalesce(F.array_max(F.transform("kept", lambda s: s["owners"])), F.lit(0)).alias("most_owners"),
            F.coalesce(F.array_max(F.transform("kept", lambda s: s["repos"])), F.lit(0)).alias("most_repos"),
        )
    )
