"""URL filtering: suffix rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES = 20
DEPTH = 4
SEED = 7
SMOOTHING = 10.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case, and the path; both empty without one."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host and path in one) that fits the host or a subdomain, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    """The last label of a host, without its port."""
    return F.element_at(F.split(F.regexp_replace(host, r":\d*$", ""), r"\.", -1), -1)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers that describe the characters of a URL; 0 for a null URL."""
    text = F.coalesce(url, F.lit(""))
    length = F.length(text)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)

    def share(pattern: str) -> Column:
        return (length - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(length, F.lit(1))

    def bits(character: Column) -> Column:
        p = (length - F.length(F.replace(text, character, F.lit("")))) / length
        return -p * F.log2(p)

    characters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return {
        "url_length": length,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_depth": F.size(F.split(host, r"\.", -1)),
        "path_depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digit_share": share("[0-9]"),
        "mark_share": share("[A-Za-z0-9]"),
        "entropy": F.aggregate(characters, F.lit(0.0), lambda total, c: total + bits(c)),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]", -1))),
        "secure": F.coalesce(url.startswith("https://"), F.lit(False)).cast("int"),
    }


FEATURES = (
    "url_length",
    "host_length",
    "path_length",
    "host_depth",
    "path_depth",
    "digit_share",
    "mark_share",
    "entropy",
    "parameters",
    "secure",
    "suffix_rate",
    "suffix_rows",
)


@dataclass
class UrlModel:
    """Trees, and of each suffix in the sample its rows and smoothed share of blocked ones.

    Without both labels among the samples there are no trees.
    """

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    rate: float


def _described(urls: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    """``urls`` with host, path and all features as one vector.

    The suffix table has a row per suffix of the bounded sample, at most
    ``SAMPLE``, so it may be broadcast.
    """
    host, path = host_and_path(F.col("url"))
    columns = lexical(F.col("url"), F.col("host"), F.col("path"))
    table = urls.withColumn("host", host).withColumn("path", path)
    table = table.withColumn("suffix", suffix_of(F.col("host"))).withColumns(
        {name: column.cast("double") for name, column in columns.items()}
    )
    joined = (
        table.join(F.broadcast(suffixes), "suffix", "left")
        .withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(rate)))
        .withColumn("suffix_rows", F.coalesce("suffix_rows", F.lit(0.0)))
    )
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(joined)


def train(urls: DataFrame, url: str = "url", blocked: str = "blocked", sample: int = SAMPLE) -> UrlModel:
    """Learns from at most ``sample`` labelled URLs, chosen by their hash.

    ``blocked`` is 0 or 1; rows with another value or a null URL are passed over.
    """
    labelled = urls.where(F.col(blocked).isin(0, 1) & F.col(url).isNotNull()).select(
        F.col(url).alias("url"), F.col(blocked).cast("double").alias("label")
    )
    rows = labelled.orderBy(F.xxhash64("url"), "url", "label").limit(sample).persist()
    total, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, total):
        rows.unpersist()
        return UrlModel(None, None, float(positive > 0))
    rate = positive / total
    host, _ = host_and_path(F.col("url"))
    suffixes = (
        rows.groupBy(suffix_of(host).alias("suffix"))
        .agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
        .select(
            "suffix",
            ((F.col("blocked") + SMOOTHING * rate) / (F.col("n") + SMOOTHING)).alias("suffix_rate"),
            F.col("n").cast("double").alias("suffix_rows"),
        )
    )
    known = suffixes.sparkSession.createDataFrame(suffixes.collect(), suffixes.schema)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(
        _described(rows, known, rate)
    )
    rows.unpersist()
    return UrlModel(trees, known, rate)


def judge(
    urls: DataFrame,
    rules: dict[str, str],
    model: UrlModel,
    threshold: float = 0.5,
    id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Verdict on each URL: (page_id, host, path, rule, verdict, score).

    The longest rule that fits decides; without one, the trees do: ``block``
    where their probability ``score`` reaches ``threshold``. The score is given
    for all rows.

    A null URL, or one without ``://``, has an empty host and path and so no
    rule. Null ids and repeated rows are kept; an empty table gives no rows; other
    columns are ignored. Without trees, the only label seen decides.
    """
    rows = urls.select(F.col(id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    if model.trees is None:
        scored = rows.select(
            "page_id", host.alias("host"), path.alias("path"), F.lit(model.rate).alias("score")
        )
    else:
        scored = model.trees.transform(_described(rows, model.suffixes, model.rate)).select(
            "page_id", "host", "path", vector_to_array("probability")[1].alias("score")
        )
    decided = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        decided = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(decided)
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", "rule", F.coalesce(decided, learned).alias("verdict"), "score"
    )
