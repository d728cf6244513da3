"""Quality scores by a sparse ensemble of rules.

1. Every text is reduced to statistics of its form (llm/statistics.py).
2. Shallow trees are fitted to the labelled rows. Each path from a root to a node is a
   conjunctive rule, a list of conditions ``statistic <= t`` or ``statistic > t``.
3. Rules become 0/1 columns, and a logistic regression with an L1 penalty gives most of
   them no weight.
4. The rules that keep a weight are compiled to one Spark column expression, a sum of
   CASE terms under a sigmoid; scoring is that expression.

Trees and regression are Spark ML's, over all labelled rows outside the held-out fold;
labels are joined to the narrow statistics, never to texts.

Defined cases: a null text has the statistics of an empty one and gets a score like every
other; every input row gives a row, rows with equal or null doc_id too; labels that are
null or whose doc_id is unknown are not learnt from; a doc_id labelled twice counts with
each of its labels; with labels of one class only, or none, the score is their mean (0.5
without any); other columns are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytide.llm.common import held_out
from daytide.llm.statistics import NAMES, text_statistics
from daytide.session import stage

TREES = 24
DEPTH = 3
PENALTY = 0.001

#: A rule is a tuple of (statistic, "<=" or ">", threshold).
Rule = tuple[tuple[str, str, float], ...]


@dataclass
class RuleModel:
    bias: float
    weights: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The compiled score, 0 to 1."""
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(holds(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, threshold in rule:
        out = out & (F.col(name) <= threshold if sign == "<=" else F.col(name) > threshold)
    return out


def _paths(node, names: list[str], path: Rule = ()) -> list[Rule]:
    """The rules of a fitted tree, one for each node below the root."""
    out = [path] if path else []
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, threshold = names[split.featureIndex()], float(split.threshold())
        out += _paths(node.leftChild(), names, (*path, (name, "<=", threshold)))
        out += _paths(node.rightChild(), names, (*path, (name, ">", threshold)))
    return out


def _shortened(rule: Rule) -> Rule:
    """At most one bound of each kind on a statistic, in a fixed order."""
    bounds: dict[tuple[str, str], float] = {}
    for name, sign, threshold in rule:
        pick = min if sign == "<=" else max
        key = (name, sign)
        bounds[key] = pick(bounds.get(key, threshold), threshold)
    return tuple((*key, threshold) for key, threshold in sorted(bounds.items()))


def extract_rules(labelled: DataFrame, names: list[str], seed: int = 11) -> list[Rule]:
    """Distinct rules of a small forest; a rule and its only complement count once."""
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(labelled)
    forest = RandomForestClassifier(
        labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5", seed=seed, maxBins=64
    ).fit(vectors.select("label", "features"))
    rules = {_shortened(r) for tree in forest.trees for r in _paths(tree._call_java("rootNode"), names)}
    return sorted(r for r in rules if len(r) > 1 or r[0][1] == ">")


def fit(labelled: DataFrame, names: list[str] = NAMES) -> RuleModel:
    """The rule model of a frame with the statistics and a 0/1 ``label``."""
    counts = labelled.groupBy("label").count().collect()
    total = sum(r["count"] for r in counts)
    if len(counts) < 2:
        share = sum(r["count"] for r in counts if r["label"] == 1) / total if total else 0.5
        # a logit of 30 is a score of 0 or 1 to thirteen places
        return RuleModel({0.0: -30.0, 0.5: 0.0, 1.0: 30.0}[share], [])
    rules = extract_rules(labelled, names)
    if not rules:
        import math

        ones = next(r["count"] for r in counts if r["label"] == 1)
        return RuleModel(math.log(ones / (total - ones)), [])
    flags = [f"r{i}" for i in range(len(rules))]
    held = labelled.select("label", *[holds(r).cast("double").alias(f) for r, f in zip(rules, flags)])
    vectors = VectorAssembler(inputCols=flags, outputCol="features").transform(held).select("label", "features")
    lasso = LogisticRegression(
        labelCol="label", regParam=PENALTY, elasticNetParam=1.0, maxIter=60, standardization=False, tol=1e-5
    ).fit(vectors)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return RuleModel(float(lasso.intercept), weights)


def score(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    cut: float = 0.7,
) -> DataFrame:
    """doc_id, held_out, score and predicted (score of at least ``cut``) of every row."""
    found = stage(text_statistics(docs, doc_id, text), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    known = known.where(F.col("label").isin(0.0, 1.0) & ~held_out(F.col("doc_id")))
    labelled = stage(found.join(known, "doc_id"), "labelled")
    model = fit(labelled)
    scored = found.withColumn("score", model.column())
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
