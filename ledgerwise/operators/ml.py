"""Labels, training sets, MLlib models and parameter tuning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions.common import assemble, clamp, lookup, ratio, rnd
from ledgerwise.functions.storage import cut_lineage
from ledgerwise.operators.analysis import FEATURE_NAMES
from ledgerwise.operators.propagation import reach_sums
from ledgerwise.operators.reasons import feature_join

# fixed values: labels that mean scam
SCAM_LABELS = ["scam", "rug_pull_deployer", "rug-pull", "rugpull", "phishing_drain", "phishing", "malicious", "blacklist"]
# fixed values: expected score of the low, medium and high class
CLASS_SCORES = (16.5, 50.0, 83.5)


def merge_labels(auto: DataFrame, manual: DataFrame, scam: DataFrame) -> DataFrame:
    """One label per wallet: a scam label wins, the first source that gave it; everything else is good."""
    rows = None
    for rank, df in enumerate((auto, manual, scam)):
        part = df.select("wallet", F.trim("label").alias("label"), F.lit(rank).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    low = F.lower("label")
    is_scam = F.coalesce(low.isin(*SCAM_LABELS), F.lit(False))
    label = F.when(is_scam, F.when(low == "scam", "scam").otherwise(F.col("label"))).otherwise("good")
    best = F.min_by("_l", F.struct((~F.col("_s")).alias("a"), "rank", F.col("_l").alias("c")))
    return rows.withColumns({"_s": is_scam, "_l": label}).groupBy("wallet").agg(best.alias("label"))


def training_set(labels: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature columns with label good = 1 / scam = 0, counts of valid and skipped wallets)."""
    rows = labels.select("wallet", F.when(F.col("label") == "good", 1).otherwise(0).alias("label")).join(
        features.withColumn("_ok", F.lit(1)), "wallet", "left")
    counts = rows.agg(F.count("_ok").alias("valid"), F.count_if(F.col("_ok").isNull()).alias("skipped"))
    return rows.filter("_ok = 1").drop("_ok"), counts


def feature_merge(base: DataFrame, flow: DataFrame, drainer: DataFrame) -> DataFrame:
    return feature_join(base, flow, drainer, "left")


def dataset_profile(df: DataFrame, label_col: str, missing_limit: float = 10.0, imbalance: float = 2.0) -> DataFrame:
    """Statistics and warnings per numeric column in one pass, plus one row per class."""
    cols = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c != label_col]
    n = F.count(F.lit(1))
    x = lambda c: F.col(c).cast("double")
    stats = df.agg(*[F.struct(
        F.lit(c).alias("column"), n.alias("n"), F.avg(x(c)).alias("mean"), F.stddev_pop(x(c)).alias("std"),
        F.min(x(c)).alias("min"), F.max(x(c)).alias("max"), (n - F.count(c)).alias("missing")).alias(c) for c in cols])
    per = stats.select(F.explode(F.array(*cols)).alias("s")).select("s.*")
    pct = 100.0 * ratio(F.col("missing"), F.col("n"))
    warn = F.array_compact(F.array(
        F.when(F.col("std").isNull() | (F.col("std") < 1e-9), "zero variance"), F.when(pct > missing_limit, "missing values")))
    per = per.withColumns({"missing_pct": pct, "warnings": warn})
    classes = df.groupBy(F.col(label_col).cast("string").alias("k")).agg(n.alias("n"))
    spread = classes.agg((F.max("n") / F.min("n")).alias("r")).scalar()
    rows = classes.select(
        F.concat(F.lit("class:"), F.col("k")).alias("column"), "n", *[F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "max")],
        F.lit(0).cast("bigint").alias("missing"), F.lit(0.0).alias("missing_pct"),
        F.array_compact(F.array(F.when(spread > imbalance, "class imbalance"))).alias("warnings"))
    return per.unionByName(rows)


@dataclass
class Trained:
    model: PipelineModel
    metrics: DataFrame
    importances: DataFrame


def stratified_split(df: DataFrame, key: str, label: str, fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Hash split within each class: the same rows fall on the same side on every run and cluster size."""
    point = F.pmod(F.xxhash64(key, label, F.lit(seed)), F.lit(10_000)) < int(fraction * 10_000)
    return df.filter(point), df.filter(~point)


def class_metrics(scored: DataFrame, positive: float = 1.0) -> list[tuple[str, float]]:
    """Precision and recall of the positive class, and the confusion matrix as ``true_pred`` counts, from predictions."""
    cells = {(r.label, r.prediction): r.n for r in scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted({c for pair in cells for c in pair} | {0.0, 1.0})
    hit = cells.get((positive, positive), 0)
    said, there = (sum(n for pair, n in cells.items() if pair[i] == positive) for i in (1, 0))
    out = [("precision", hit / said if said else 0.0), ("recall", hit / there if there else 0.0)]
    return out + [(f"confusion_{int(t)}_{int(p)}", float(cells.get((t, p), 0))) for t in classes for p in classes]


#: Training rows of one task; a forest keeps a count per tree beside each.
TASK_ROWS = 50_000


def in_parts(df: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """(rows, are they kept): what is more than one task's rows is spread by ``key`` and computed once for all passes."""
    whole = df.persist()
    n = whole.count()
    if n <= TASK_ROWS:
        whole.unpersist()
        return df, False
    parts = whole.repartition(-(-n // TASK_ROWS), key).persist()
    parts.count()
    whole.unpersist()
    return parts, True


def train_forest(df: DataFrame, features: Sequence[str], label: str = "label", key: str = "wallet", trees: int = 100,
                 depth: int = 10, min_leaf: int = 2, train_fraction: float = 0.8, scale: bool = True, seed: int = 42,
                 top: int | None = None) -> Trained:
    data = df.select(key, F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features]).fillna(0.0)
    data, kept = in_parts(data, key)
    train, test = stratified_split(data, key, "label", train_fraction, seed)
    steps = [VectorAssembler(inputCols=list(features), outputCol="raw_features" if scale else "features")]
    if scale:
        steps.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    steps.append(RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed))
    model = Pipeline(stages=steps).fit(train)
    scored = cut_lineage(model.transform(test).select("label", "prediction", vector_to_array("rawPrediction").alias("_raw"))).select(
        "label", "prediction", array_to_vector("_raw").alias("rawPrediction"))
    if kept:
        data.unpersist()
    spark = df.sparkSession
    metrics = [(m, MulticlassClassificationEvaluator(metricName=m).evaluate(scored)) for m in (
        "accuracy", "f1", "weightedPrecision", "weightedRecall")]
    metrics.append(("areaUnderROC", BinaryClassificationEvaluator().evaluate(scored)))
    metrics += class_metrics(scored)
    weights = model.stages[-1].featureImportances.toArray()
    listed = sorted(((name, float(w)) for name, w in zip(features, weights)), key=lambda p: (-p[1], p[0]))
    return Trained(model, spark.createDataFrame(metrics, "metric string, value double"),
                   spark.createDataFrame(listed[:top], "feature string, importance double"))


def train_trust_model(df: DataFrame, flow: DataFrame | None = None, drainer: DataFrame | None = None, seed: int = 42) -> Trained:
    """Label 1 is good.  Flow and drainer features are merged by wallet where given; what a wallet lacks counts as 0."""
    features = list(FEATURE_NAMES)
    for more in (flow, drainer):
        if more is not None:
            named = [c for c in more.columns if c != "wallet" and c not in features]
            df, features = df.join(more.select("wallet", *named), "wallet", "left"), features + named
    return train_forest(df, features, seed=seed)


def train_scam_model(df: DataFrame, features: Sequence[str], seed: int = 42) -> Trained:
    """Label is scam_probability >= 0.5; the twenty most important features are reported."""
    labelled = df.withColumn("label", (F.col("scam_probability") >= 0.5).cast("int"))
    return train_forest(labelled, features, trees=200, seed=seed, top=20)


TOKEN_FEATURES = ["mint_authority_exists", "freeze_authority_exists", "metadata_missing", "decimals", "supply"]


def token_training_rows(tokens: DataFrame, scam: DataFrame) -> DataFrame:
    """Token features with label 1 when flagged or when a creator is a known scam wallet."""
    bad = scam.select(F.col("wallet").alias("creator")).distinct()
    hit = tokens.select("mint", F.explode("creator_wallets").alias("creator")).join(bad, "creator", "left_semi").select(
        "mint").distinct().withColumn("_hit", F.lit(True))
    flag = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False)).cast("int")
    return tokens.join(hit, "mint", "left").select(
        "mint", flag("mint_authority").alias("mint_authority_exists"), flag("freeze_authority").alias("freeze_authority_exists"),
        F.col("metadata_missing").cast("int").alias("metadata_missing"), F.coalesce("decimals", F.lit(0)).alias("decimals"),
        F.coalesce("supply", F.lit(0)).alias("supply"), (F.col("scam_flag") | F.coalesce("_hit", F.lit(False))).cast("int").alias("label"))


def train_token_model(tokens: DataFrame, scam: DataFrame, seed: int = 42) -> Trained:
    return train_forest(token_training_rows(tokens, scam), TOKEN_FEATURES, key="mint", trees=200, scale=False, seed=seed)


def train_label_classifier(features: DataFrame, labels: DataFrame, seed: int = 42) -> Trained:
    rows = features.join(labels.select("wallet", (F.col("label") != "good").cast("int").alias("label")), "wallet")
    return train_forest(rows, ["total_tx", "account_age_days", "unique_counterparties"], train_fraction=0.7, scale=False, seed=seed)


def _probabilities(model: PipelineModel, features: DataFrame, key: str = "wallet") -> DataFrame:
    numeric = [c for c, t in features.dtypes if t in ("double", "float", "int", "bigint")]
    return model.transform(features.fillna(0, numeric)).select(key, vector_to_array("probability").alias("p"))


def expected_score(probs: Column) -> Column:
    """Expected score of a (low, medium, high) probability array; missing classes count as 0."""
    p = [F.coalesce(F.get(probs, F.lit(i)), F.lit(0.0)) for i in range(3)]
    total = p[0] + p[1] + p[2]
    return sum((p[i] * CLASS_SCORES[i] for i in range(1, 3)), p[0] * CLASS_SCORES[0]) / F.when(total > 0, total).otherwise(1.0)


def predict_scores(model: PipelineModel, features: DataFrame, rule_scores: DataFrame, blend: float = 0.5) -> DataFrame:
    """Class probabilities, the expected score and its blend with the rule score."""
    p = _probabilities(model, features).withColumn("_ml", expected_score(F.col("p")))
    blended = clamp(F.round((1 - blend) * F.col("score") + blend * F.col("_ml")), 0, 100)
    return rule_scores.select("wallet", "score").join(p, "wallet", "left").select(
        "wallet", F.col("p").alias("probs"), F.round("_ml").cast("int").alias("ml_score"),
        F.coalesce(blended, F.col("score")).cast("int").alias("score"))


def predict_trust(model: PipelineModel, features: DataFrame, wallets: DataFrame) -> DataFrame:
    """(1 - P(scam)) * 100 for the requested wallets; wallets without features are scored on zeros."""
    cols = [c for c in features.columns if c != "wallet"]
    rows = wallets.select("wallet").distinct().join(features, "wallet", "left").fillna(0.0, cols)
    p = _probabilities(model, rows)
    scam = F.coalesce(F.get("p", F.lit(1)), F.lit(0.0))
    return p.select("wallet", rnd((1 - scam) * 100, 2).alias("trust_score"), scam.alias("scam_prob"))


def _quality(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, false positive rate and F1 per parameter set; rows have label and pred (0 / 1)."""
    hit = lambda l, p: F.count_if((F.col("label") == l) & (F.col("pred") == p))
    g = rows.groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return g.select(*keys, zero(ratio(tp, tp + fp)).alias("precision"), zero(ratio(tp, tp + fn)).alias("recall"),
                    zero(ratio(fp, fp + tn)).alias("fpr"), zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def _mark_best(quality: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    best = quality.agg(F.max_by(F.struct(*keys), order).alias("b")).scalar()
    return quality.withColumn("is_best", F.struct(*keys) == best)


def tune_reason_weights(reasons: DataFrame, labels: DataFrame, grid: dict[str, Sequence[int]], base: int = 50,
                        scam_below: int = 20, weights: dict[str, int] = P.REASON_WEIGHTS) -> DataFrame:
    """Quality of every combination of the tunable code weights.

    Each labelled wallet is reduced to its fixed weight sums and the number of rows of
    each tunable code before the grid is unfolded, so reasons are read once.
    """
    names = list(grid)
    w = F.coalesce(lookup(weights, F.col("reason_code")), F.lit(0))
    tunable = F.col("reason_code").isin(*names)
    sums = reasons.join(labels.select("wallet"), "wallet", "left_semi").groupBy("wallet").agg(
        F.coalesce(F.sum(F.when(~tunable & (w > 0), w)), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(~tunable & (w < 0), w)), F.lit(0)).alias("neg"),
        *[F.count_if(F.col("reason_code") == c).alias(f"n{i}") for i, c in enumerate(names)])
    rows = labels.select("wallet", "label").join(sums, "wallet", "left").fillna(0)
    for i, c in enumerate(names):
        rows = rows.withColumn(f"w{i}", F.explode(F.array(*[F.lit(x) for x in grid[c]])))
    pos, neg = F.col("pos"), F.col("neg")
    for i in range(len(names)):
        part = F.col(f"n{i}") * F.col(f"w{i}")
        pos, neg = pos + F.greatest(part, F.lit(0)), neg + F.least(part, F.lit(0))
    score = clamp(base + F.least(F.lit(40), pos) + neg, 0, 100)
    keys = [f"w{i}" for i in range(len(names))]
    quality = _quality(rows.withColumn("pred", (score < scam_below).cast("int")), keys)
    marked = _mark_best(quality, keys, F.struct("f1", *[-F.col(k) for k in keys]))
    return marked.withColumnsRenamed({f"w{i}": c for i, c in enumerate(names)})


def tune_propagation(edges: DataFrame, scam: DataFrame, labels: DataFrame, grid: dict[str, Sequence[float]], as_of: int,
                     base: float = 50.0, scam_below: float = 20.0) -> DataFrame:
    """Quality of every propagation setting over one breadth-first walk from the scam wallets.

    grid: d1, d2, d3, volume_scale, time_decay_days, max_depth.  The penalty is linear in the depth
    penalties and the scale, so the walk keeps one sum per (wallet, depth, decay) (``reach_sums``) and only
    these sums of labelled wallets meet the grid.
    """
    values = lambda k: F.array(*[F.lit(x) for x in grid[k]])
    size = F.least(F.lit(1.0), F.log10(F.col("amount") + 1) / 3)
    age = (F.lit(as_of) - F.col("last_ts")) / 86_400.0
    decays = grid["time_decay_days"]
    reach = reach_sums(edges, scam, {f"x{i}": size * F.exp(-age / max(k, 1)) for i, k in enumerate(decays)}, max_depth=3)
    near = reach.join(labels.select("wallet"), "wallet", "left_semi").select("wallet", "depth", F.explode(F.array(*[
        F.struct(F.lit(k).alias("time_decay_days"), F.col(f"x{i}").alias("x")) for i, k in enumerate(decays)])).alias("e")).select(
        "wallet", "depth", "e.*")
    sums = near.groupBy("wallet", "time_decay_days").agg(
        *[F.coalesce(F.sum(F.when(F.col("depth") == d, F.col("x"))), F.lit(0)).cast("double").alias(f"s{d}") for d in (1, 2, 3)])
    rows = labels.select("wallet", "label", F.explode(values("time_decay_days")).alias("time_decay_days")).join(
        sums, ["wallet", "time_decay_days"], "left").fillna(0.0, ["s1", "s2", "s3"])
    keys = ["d1", "d2", "d3", "volume_scale", "time_decay_days", "max_depth"]
    for k in keys:
        if k != "time_decay_days":
            rows = rows.withColumn(k, F.explode(values(k)))
    within = lambda d: F.when(F.col("max_depth") >= d, F.col(f"d{d}") * F.col(f"s{d}")).otherwise(0.0)
    score = F.greatest(F.lit(0.0), base + F.col("volume_scale") * (within(1) + within(2) + within(3)))
    quality = _quality(rows.withColumn("pred", (score < scam_below).cast("int")), keys)
    good = (F.col("precision") >= 0.95) & (F.col("recall") >= 0.7)
    order = F.struct(good, F.when(good, F.col("precision")).otherwise(F.col("f1")), F.when(good, F.col("recall")).otherwise(0.0),
                     *[-F.col(k) for k in keys])
    return _mark_best(quality, keys, order)


def save_model(model: PipelineModel, name: str, metrics: DataFrame, directory: str, version: int) -> str:
    """Write the model and its metrics under ``directory/name/v=<version>``."""
    path = f"{directory}/{name}/v={version}"
    model.write().overwrite().save(f"{path}/model")
    metrics.withColumns({"name": F.lit(name), "version": F.lit(version)}).write.mode("overwrite").json(f"{path}/metadata")
    return path


def load_model(spark: SparkSession, name: str, directory: str, version: int | None = None) -> PipelineModel:
    """The given version, else the newest one that has metadata."""
    if version is None:
        version = spark.read.json(f"{directory}/{name}/*/metadata").agg(F.max("version")).first()[0]
    return PipelineModel.load(f"{directory}/{name}/v={version}/model")
