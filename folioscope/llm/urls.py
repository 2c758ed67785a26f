"""URL filter: host and path rules, and boosted trees over lexical features for what no rule decides.

Everything is column expressions and MLlib; no Python runs on the executors.

* A null url, or one without `://`, has an empty host and path; no rule fits it and the trees judge it by its other
  features. Repeated rows are judged alike. An empty table gives an empty result.
* Columns of the input are kept unless their names are those the operator adds, which win.
* With no labelled url, or labels of one class only, the undecided urls get that class (`allow` when there is none).

The trees are fitted on distinct labelled urls, so the copies of one url count once. What a suffix says about a
labelled url leaves out the labels of the url's own fold, so no row is described by its own label, and no feature names
a path segment, which would only restate a path rule. A quarter of the labelled urls is held out of the fit: it gives
the area under the curve (`held_out`) and the cutoff, the lowest probability of a half or more from which the precision
asked for was reached. Trees that reach it nowhere block nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import ascii_lower, stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        inside = (host == self.host) | host.endswith(f".{self.host}")
        return inside & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    before = F.substring_index(url, "://", 1)
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(before) + 4)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls. Rules are configuration: one branch each."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = rule.fits(host, path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def entropy(text: Column) -> Column:
    """Bits per character over the letters, digits and marks a url is made of."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    total = F.lit(0.0)
    for symbol in LETTERS:
        share = (F.length(text) - F.length(F.replace(text, F.lit(symbol), F.lit("")))) / size
        total = total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return total


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789-._/?&=%"
FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_labels", "f_depth", "f_digits", "f_host_digits", "f_hyphens",
    "f_parameters", "f_query_length", "f_fragment", "f_secure", "f_entropy", "f_host_entropy", "f_suffix_share",
    "f_suffix_blocked",
]


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.lower(F.coalesce(url, F.lit("")))
    size = F.greatest(F.length(text), F.lit(1))
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "f_length": F.length(text),
        "f_host_length": F.length(host),
        "f_path_length": F.length(path),
        "f_labels": F.size(F.split(host, r"\.")),
        "f_depth": F.size(F.split(path, "/")) - 1,
        "f_digits": digits / size,
        "f_host_digits": F.length(F.regexp_replace(host, "[^0-9]", "")) / F.greatest(F.length(host), F.lit(1)),
        "f_hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
        "f_parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "f_query_length": F.length(query),
        "f_fragment": F.contains(text, F.lit("#")).cast("int"),
        "f_secure": text.startswith("https://").cast("int"),
        "f_entropy": entropy(text),
        "f_host_entropy": entropy(host),
    }


#: Parts whose labels are left out in turn, parts one of which is held out, and held-out urls a cutoff must block.
FOLDS, PARTS, SUPPORT = 5, 4, 10
#: Labelled urls that a task of the fit has, and steps of probability whose held-out urls are counted apart.
TOGETHER, STEPS = 20_000, 1_000


def _fold(url: Column, parts: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(salt)), F.lit(parts)).cast("int")


def _statistics(rows: DataFrame) -> DataFrame:
    """Urls per suffix and its labels, in total and per fold: over all rows."""
    fold = _fold(F.col("url"), FOLDS, 1)
    known = [F.count_if((fold == k) & F.col("_label").isNotNull()) for k in range(FOLDS)]
    bad = [F.coalesce(F.sum(F.when(fold == k, F.col("_label"))), F.lit(0.0)) for k in range(FOLDS)]
    return rows.groupBy("_suffix").agg(
        F.log2(F.count(F.lit(1)) + 1.0).alias("f_suffix_share"), F.array(*known).alias("_known"), F.array(*bad).alias("_bad")
    )


def _described(rows: DataFrame, by_suffix: DataFrame, labelled: bool) -> DataFrame:
    """Rows with their features; the suffix share of a labelled row leaves out the labels of its own fold."""
    def total(name: str) -> Column:
        every = F.aggregate(name, F.lit(0.0), lambda sofar, one: sofar + one)
        return every - F.get(name, _fold(F.col("url"), FOLDS, 1)) if labelled else every

    rows = rows.join(by_suffix, "_suffix", "left")
    blocked = (total("_bad") + 1) / (total("_known") + 2)
    return rows.withColumns({"f_suffix_blocked": blocked, **lexical(F.col("url"), F.col("host"), F.col("path"))})


@dataclass(frozen=True)
class Fitted:
    """What was learnt: the trees (none for labels of one class), and how they did on the urls held out."""

    model: GBTClassificationModel | None
    constant: float
    labelled: int
    held_out: int
    auc: float | None
    cutoff: float | None
    precision: float | None
    recall: float | None


ASSEMBLER = {"inputCols": FEATURES, "outputCol": "_features"}


def _scored(model: GBTClassificationModel, described: DataFrame) -> DataFrame:
    scored = model.transform(VectorAssembler(**ASSEMBLER).transform(described))
    return scored.withColumn("block_probability", F.round(vector_to_array("_p")[1], 9))


def _cutoff(held: DataFrame, least_precision: float) -> tuple[float, float, float] | tuple[None, None, None]:
    """Lowest probability of 0.5 or more from which `label` is right often enough, with precision and recall there."""
    step = F.floor(F.col("block_probability") * STEPS).alias("_step")
    counted = [F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")]
    per = stored(held.groupBy(step, "block_probability").agg(*counted))
    # Running sums in two levels: over one row a step, and within a step, which has no more probabilities than nine digits allow.
    above = Window.orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = per.groupBy("_step").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    steps = steps.select("_step", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in ("n", "bad")])
    within = Window.partitionBy("_step").orderBy(F.col("block_probability").desc())
    running = per.join(F.broadcast(steps), "_step").select(
        "block_probability", *[(F.col(f"_{c}") + F.sum(c).over(within)).alias(c) for c in ("n", "bad")]
    )
    total = per.agg(F.sum("bad").alias("total"))
    good = running.where((F.col("block_probability") >= 0.5) & (F.col("n") >= SUPPORT) & (F.col("bad") >= least_precision * F.col("n")))
    best = good.join(F.broadcast(total)).select("block_probability", F.col("bad") / F.col("n"), F.col("bad") / F.col("total"))
    found = best.orderBy("block_probability").limit(1).collect()
    return tuple(found[0]) if found else (None, None, None)


def _fit(narrow: DataFrame, by_suffix: DataFrame, least_precision: float, trees: int, depth: int, seed: int) -> Fitted:
    distinct = narrow.where("_label is not null").groupBy("url", "host", "path", "_suffix").agg(F.max("_label").alias("_label"))
    distinct = distinct.where(F.col("_label").isin(0.0, 1.0))
    held = (_fold(F.col("url"), PARTS, 2) == 0).alias("held")
    per_class = distinct.select(F.col("_label").alias("label"), held).groupBy("label", "held").count().collect()
    counts = {(r["label"], r["held"]): r["count"] for r in per_class}
    size, out = sum(counts.values()), sum(n for (_, held), n in counts.items() if held)
    described = _described(distinct, by_suffix, labelled=True)
    columns = [*[F.col(c).cast("double") for c in FEATURES], F.col("_label").alias("label")]
    # Dealt by url and in one order, so that sums don't depend on how the table came.
    dealt = described.repartition(max(1, -(-size // TOGETHER)), "url").sortWithinPartitions("_label", F.xxhash64("url"), "url")
    training = dealt.select(*columns, held).persist()
    try:
        classes = {label for label, held in counts if not held} or {label for label, _ in counts}
        if len(classes) < 2:
            return Fitted(None, max(classes, default=0.0), size, out, None, None, None, None)
        booster = GBTClassifier(
            featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, seed=seed, stepSize=0.3
        )
        model = booster.fit(VectorAssembler(**ASSEMBLER).transform(training.where("not held")).select("_features", "label"))
        model.setPredictionCol("_guess").setProbabilityCol("_p").setRawPredictionCol("_raw")
        tested = _scored(model, training.where("held"))
        both = {label for label, held in counts if held} == {0.0, 1.0}
        auc = BinaryClassificationEvaluator(rawPredictionCol="_raw", labelCol="label").evaluate(tested) if both else None
        return Fitted(model, 0.0, size, out, auc, *_cutoff(tested, least_precision))
    finally:
        training.unpersist()


ADDED = ["host", "path", "rule", "verdict", "block_probability"]


def _aside(name: str, place: int) -> str:
    """The name an input column bears meanwhile: columns of the operator start with one underscore or with `f_`."""
    return f"__{place}" if name.lower().startswith(("_", "f_")) else name


def _prepared(pages: DataFrame, rules: list[Rule], labelled: Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    host, path = host_and_path(F.col("url"))
    given = F.lit(None) if labelled is None else labelled
    named = [F.col(f"`{c}`").alias(_aside(c, i)) for i, c in enumerate(pages.columns) if c.lower() not in ADDED]
    rows = pages.select(*named, given.cast("double").alias("_label")).withColumns({"host": host, "path": path})
    name, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": name, "_ruled": verdict})
    if labelled is None:
        rows = rows.withColumn("_label", F.when(F.col("_ruled") == "block", 1.0).when(F.col("_ruled") == "allow", 0.0))
    rows = rows.withColumn("_suffix", suffix(F.col("host")))
    narrow = rows.select("url", "host", "path", "_suffix", "_label")
    return rows, narrow, _statistics(narrow)


def judge(
    pages: DataFrame,
    rules: list[Rule],
    labelled: Column | None = None,
    least_precision: float = 0.9,
    trees: int = 10,
    depth: int = 4,
    seed: int = 17,
) -> DataFrame:
    """Adds host, path, rule, verdict and block_probability to rows with a `url`.

    `labelled` is a column that is 1.0 for urls known as bad, 0.0 for good ones, null otherwise; by default the rules'
    own decisions are the labels. The trees are fitted on all distinct labelled urls but those held out; the suffix
    statistics count every row.
    """
    rows, narrow, by_suffix = _prepared(pages, rules, labelled)
    fitted = _fit(narrow, by_suffix, least_precision, trees, depth, seed)
    if fitted.model is None:
        scored, cutoff = rows.withColumn("block_probability", F.lit(fitted.constant)), 0.5
    else:
        scored, cutoff = _scored(fitted.model, _described(rows, by_suffix, labelled=False)), fitted.cutoff
    blocked = F.col("block_probability") >= cutoff if cutoff is not None else F.lit(False)
    by_trees = F.when(blocked, "block").otherwise("allow")
    kept = [F.col(f"`{_aside(c, i)}`").alias(c) for i, c in enumerate(pages.columns) if c.lower() not in ADDED]
    scored = scored.withColumn("verdict", F.coalesce("_ruled", by_trees))
    return scored.select(*kept, *ADDED)


def held_out(pages: DataFrame, rules: list[Rule], labelled: Column | None = None, least_precision: float = 0.9) -> DataFrame:
    """One row on how the trees do on labelled urls they have not seen: counts, area under the curve, cutoff, precision, recall."""
    _, narrow, by_suffix = _prepared(pages, rules, labelled)
    fitted = _fit(narrow, by_suffix, least_precision, 10, 4, 17)
    row = (fitted.labelled, fitted.held_out, fitted.auc, fitted.cutoff, fitted.precision, fitted.recall)
    names = "labelled long, held_out long, auc double, cutoff double, precision double, recall double"
    return pages.sparkSession.createDataFrame([row], names)
