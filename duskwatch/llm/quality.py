"""Quality rules: counts per text, and lines that too many documents of one host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import SPACES, arrow_map, scratch, settled

SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: list[bytes]) -> int:
    """Words inside a window of three that the text holds twice or more."""
    import numpy as np

    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    if len(words) < 4 or len(ids) == len(words):
        return 0
    pairs = np.unique(codes[:-1] * len(ids) + codes[1:], return_inverse=True)[1]
    triples = pairs[:-1] * len(ids) + codes[2:]
    _, inverse, counts = np.unique(triples, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words), dtype=bool)
    for i in range(3):
        covered[twice + i] = True
    return int(covered.sum())


def _profile(texts: list[str | None]) -> list:
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    features: list[list[int]] = [[] for _ in FEATURES]
    hashes, sizes = [], []
    for text in texts:
        text = text or ""
        lines = text.encode().split(b"\n")
        split = [line.split() for line in lines]
        words = [w for line in split for w in line]
        full = [line for line, found in zip(lines, split, strict=True) if found]
        values = (
            len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(full) - len(set(full)), _repeated(words),
        )
        for column, value in zip(features, values, strict=True):
            column.append(value)
        hashes.append([xxh64_intdigest(b" ".join(s).lower()) - (1 << 63) if s else None for s in split])
        sizes.append([len(s) for s in split])
    return [
        *[pa.array(c, pa.int64()) for c in features], pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())),
    ]


def row_key(key: str, host: str, text: str) -> Column:
    """Rows that agree in all three columns are judged alike and may share a key."""
    return F.xxhash64(F.col(key), F.lit("|"), F.col(host), F.lit("|"), F.col(text))


def judge_quality(
    docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text",
    min_docs: int = 20, least_left: float = 0.3,
) -> DataFrame:
    """Per row: the base counts, the lines to remove (``gone``, from 0) and the verdict ``kept``.

    A line, in small ASCII letters and single blanks, is a template line of its host if more than
    ``min_docs`` distinct documents hold it; the limit is the same at every size of a host.
    Documents with the same text count once, so copies do not turn their lines into templates.
    The document with the smallest key keeps the line. A document of which less than
    ``least_left`` of the words would be left is rejected, as is one that fails the base rules.

    Null and empty texts have no words and fail; a null host is the host ""; repeated rows are judged
    alike, each has its row; an empty table gives none.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_judged(docs, key, host, text, min_docs, least_left), "quality")


def _judged(docs: DataFrame, key: str, host: str, text: str, min_docs: int, least_left: float) -> DataFrame:
    rows = settled(
        arrow_map(
            docs.select(
                F.col(key).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                row_key(key, host, text).alias("row_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
                F.col(text).alias("text"),
            ),
            "text", ["doc_id", "host", "row_key", "text_hash"],
            f"doc_id {docs.schema[key].dataType.simpleString()}, host string, row_key bigint, text_hash bigint, "
            + ", ".join(f"{f} bigint" for f in FEATURES) + ", line_hashes array<bigint>, line_words array<int>",
            _profile,
        ),
        "quality",
    )
    lines = rows.select("doc_id", "host", "text_hash", F.explode(F.array_distinct("line_hashes")).alias("line")).filter("line is not null")
    templates = settled(
        lines.groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("first"))
        .groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("first").alias("first"))
        .filter(F.col("docs") > min_docs).select("host", "line", "first"),
        "template-lines",
    )
    placed = rows.select(
        "doc_id", "host", "row_key", F.posexplode("line_hashes").alias("pos", "line"), "line_words"
    ).select("doc_id", "host", "row_key", "pos", "line", F.get("line_words", F.col("pos")).alias("words"))
    gone = (
        placed.join(templates, ["host", "line"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("row_key").agg(F.collect_set(F.struct("pos", "words")).alias("hit"))
        .select("row_key", F.array_sort("hit.pos").alias("gone"), F.aggregate("hit.words", F.lit(0), lambda a, w: a + w).alias("gone_words"))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_template_words")
    return (
        rows.drop("line_hashes", "line_words").join(gone, "row_key", "left")
        .withColumn("n_template_words", F.coalesce("gone_words", F.lit(0)).cast("long"))
        .withColumn("n_template_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= least_left * F.col("n_words")))
        .select("doc_id", "row_key", *FEATURES, "base_failed", "kept", "n_template_lines", "n_template_words", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    )


def keep_quality(docs: DataFrame, **rules) -> DataFrame:
    """The documents that pass, without their template lines; all columns of ``docs`` stay."""
    key, host, text = (rules.get(k, d) for k, d in (("key", "doc_id"), ("host", "source"), ("text", "text")))
    verdicts = judge_quality(docs, **rules).filter("kept").select("row_key", "gone").dropDuplicates(["row_key"])
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains("gone", i)), "\n")
    return (
        docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), row_key(key, host, text).alias("row_key"))
        .join(verdicts, "row_key")
        .select(F.col("row").withField(text, F.when(F.size("gone") > 0, rest).otherwise(F.col("text"))).alias("row"))
        .select("row.*")
    )
