"""Attack-type and threat-level classifiers on MLlib.

Preparation (split, imputation, ordinal encoding, weights, folds) is DataFrame
work; the forests are MLlib's distributed level-wise trees.  Metrics are
aggregations over the prediction table.  MLlib and scikit-learn forests differ
(binning of continuous features, bootstrap RNG), so quality is compared in bands,
never tree by tree.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tessera.functions import rules as R
from tessera.functions.expr import nonneg
from tessera.functions.position import ordered_position
from tessera.operators import grow
from tessera.session import materialize, release, scratch_path

CAT_COLS = ["country_txt", "region_txt", "weaptype1_txt", "targtype1_txt", "gname"]
NUM_COLS = ["iyear", "success", "suicide", "nkill", "nwound"]
TARGET = "attacktype1_txt"
THREAT_CATS = ["country_txt", "region_txt", "attacktype1_txt", "weaptype1_txt", "targtype1_txt"]
DAY = ["iyear", "imonth", "iday"]


EVEN_FROM = 100_000             # rows of a table that is dealt out evenly
BINNED_FROM = 100_000           # train rows from which trees are grown on binned rows (grow.py), not by MLlib
COUNTS_A_FIT = 1_000_000_000    # bootstrap counts (rows x trees) that one fit keeps
FITS_AT_ONCE = 5                # folds whose forests grow side by side, so that small jobs of one fill the waits of another


def write_even(df: DataFrame, rows: int, name: str) -> DataFrame:
    """``df`` as a written table of even files, two for each core; of few rows the files stay as they come.

    Sorted or coalesced tables have few files, or all test rows in the last ones; trees are grown and walked
    row by row, so cores without a file would stay idle.
    """
    return materialize(df if rows < EVEN_FROM else df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism), name)


# ---- M1 / M2 / M3 / M4 / M5 / M6 ------------------------------------------------------

def training_frame(incidents: DataFrame) -> DataFrame:
    """Rows with a known target (NULL, '', 'Unknown', 'unknown' dropped), barricade merged."""
    t = F.trim(F.col(TARGET))
    df = incidents.filter(t.isNotNull() & ~t.isin("", "Unknown", "unknown"))
    return df.withColumn(TARGET, F.when(F.col(TARGET) == R.BARRICADE, R.KIDNAPPING).otherwise(F.col(TARGET)))


def chronological_split(df: DataFrame, train_fraction: float = 0.8) -> DataFrame:
    """M1: first floor(0.8 n) rows in (iyear, imonth, iday, incident_id) order are train.

    The rows are written once, in their order; what follows reads that table."""
    return _split_at(ordered_position(df, DAY, "incident_id"), train_fraction)


def _split_at(placed: DataFrame, train_fraction: float, even: bool = False) -> DataFrame:
    n = placed.count()
    if even and n >= EVEN_FROM:
        placed = write_even(placed, n, "split-even")
    return placed.withColumn("is_train", F.col("pos") < F.floor(F.lit(n) * F.lit(train_fraction)))


def overlap_rows(split: DataFrame, cols=CAT_COLS + NUM_COLS) -> DataFrame:
    """M2: number of distinct feature rows present in both train and test."""
    tr = split.filter("is_train").select(*cols)
    te = split.filter("not is_train").select(*cols)
    return tr.intersect(te).agg(F.count(F.lit(1)).alias("overlap"))


def train_medians(split: DataFrame, cols=NUM_COLS) -> DataFrame:
    """M3: numeric medians of the train rows (interpolated, NULLs ignored), one row."""
    return split.filter("is_train").agg(*[F.median(F.col(c).cast("double")).alias(c) for c in cols])


def impute(split: DataFrame, medians: DataFrame, cat_cols=CAT_COLS, num_cols=NUM_COLS) -> DataFrame:
    """M3: categorical NULL -> 'Unknown'; numeric NULL -> train median (one row, read once)."""
    row = medians.first()
    fills = {c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in cat_cols}
    fills |= {c: F.coalesce(F.col(c).cast("double"), F.lit(row[c]).cast("double")) for c in num_cols}
    return split.withColumns(fills)


MAX_BROADCAST = 1_000_000  # dictionary entries


def ordinal_dictionaries(train: DataFrame, cols=CAT_COLS) -> DataFrame:
    """M4 fit: (col, value, code): per column, sorted distinct train values -> code 0..k-1.

    All columns are collected in one pass; the rank window runs over the distinct values
    (bounded by a column's cardinality), not over rows.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in cols])
    vals = train.select(F.explode(pairs).alias("x")).select("x.col", "x.value").distinct()
    rank = F.row_number().over(Window.partitionBy("col").orderBy("value"))
    return materialize(vals.withColumn("code", (rank - 1).cast("double")), "dictionaries")


def ordinal_encode(df: DataFrame, dicts: DataFrame, cols=CAT_COLS, suffix: str = "_code") -> DataFrame:
    """M4 transform: look each column up; unseen values -> -1.

    The dictionaries' size is checked: up to ``MAX_BROADCAST`` entries go to every task, so a value
    that most rows share moves no rows; larger ones are joined.
    """
    small = dicts.count() <= MAX_BROADCAST
    out = df
    for c in cols:
        d = dicts.filter(F.col("col") == c).select(F.col("value").alias(c), F.col("code").alias(c + suffix))
        out = (out.join(F.broadcast(d) if small else d, c, "left")
               .withColumn(c + suffix, F.coalesce(F.col(c + suffix), F.lit(-1.0))))
    return out


def label_dictionary(df: DataFrame, target: str = TARGET) -> DataFrame:
    """M5: sorted classes -> label index (as ``StringIndexer(stringOrderType='alphabetAsc')``)."""
    vals = df.select(F.col(target).alias("value")).distinct()
    return vals.withColumn("label", (F.row_number().over(Window.orderBy("value")) - 1).cast("double"))


def majority_baseline(split: DataFrame, target: str = TARGET) -> DataFrame:
    """M6: the train majority class (ties -> smallest) and its accuracy on the test rows."""
    maj = split.filter("is_train").select(F.mode(target, True)).scalar()
    te = split.filter("not is_train").withColumn("_maj", maj)
    return te.agg(F.first("_maj").alias("majority_class"),
                  (F.sum(F.when(F.col(target) == F.col("_maj"), 1).otherwise(0)) / F.count(F.lit(1)))
                  .alias("baseline_accuracy"))


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_class), one row per class."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = train.select(F.count(F.lit(1))).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return counts.select(label, (n / (k * F.col("n_c"))).alias("weight"))


def weighted_rows(train: DataFrame) -> DataFrame:
    """``train`` with its class's balanced weight; the weights are written, the rows are read where they lie."""
    return train.join(F.broadcast(materialize(class_weights(train), "class-weights")), "label")     # one row for each class


# ---- M7 / M8 / M9 / M11 ---------------------------------------------------------------

def prepared_attack_data(incidents: DataFrame):
    """Split, impute, encode and label the attack-type data; returns (data, dicts, labels).

    Only the columns that are kept are sorted and written."""
    return prepared_split(chronological_split(training_frame(incidents.select("incident_id", *DAY, TARGET, *CAT_COLS, *[c for c in NUM_COLS if c not in DAY]))))


def prepared_split(split: DataFrame):
    """``prepared_attack_data`` of rows that are split already."""
    split = impute(split, train_medians(split))
    dicts = ordinal_dictionaries(split.filter("is_train"))
    labels = materialize(label_dictionary(split), "attack-labels")
    data = ordinal_encode(split, dicts).join(
        F.broadcast(labels.withColumnRenamed("value", TARGET)), TARGET)  # one row for each class
    # written once: the forest makes several passes over its input
    keep = ["incident_id", TARGET, "label", "is_train", "pos", *CAT_COLS, *NUM_COLS,
            *[c + "_code" for c in CAT_COLS], *DAY[1:]]
    return write_even(data.select(*keep), split.count(), "attack-prepared"), dicts, labels


def bins_for(data: DataFrame, features: list[str]) -> int:
    """Bins that keep every code of the encoded columns apart."""
    codes = [c for c in features if c.endswith("_code")]
    top = data.agg(*[F.max(c).alias(c) for c in codes]).first()
    return max(32, *[int(top[c] or 0) + 3 for c in codes])


def feature_names(cat_cols=CAT_COLS, num_cols=NUM_COLS) -> list[str]:
    return [c + "_code" for c in cat_cols] + list(num_cols)


def forest(num_trees: int = 300, max_depth: int = 8, min_leaf: int = 2, seed: int = 42,
           features: list[str] | None = None, max_bins: int = 32) -> Pipeline:
    """M7: assembler + random forest (balanced weights via ``weight``; sqrt features).

    Each row's node in each tree is kept from level to level and not found from the root again.
    """
    feats = features or feature_names()
    return Pipeline(stages=[
        VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"),
        RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                               numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=min_leaf,
                               featureSubsetStrategy="sqrt", maxBins=max_bins, cacheNodeIds=True, seed=seed)])


def grow_forest(train: DataFrame, num_trees: int, seed: int = 42, features: list[str] | None = None) -> PipelineModel:
    """M7's forest on weighted rows, all trees of it, grown some at a time.

    A fit keeps a count and a node for each row and tree.  Trees do not depend on each other, so where these are more than
    ``COUNTS_A_FIT`` several fits, each with a seed of its own, grow a part of the trees, and one model holds them all.
    """
    feats, rows = features or feature_names(), train.count()
    bins, each = bins_for(train, feats), max(1, COUNTS_A_FIT // max(1, rows))
    if rows >= BINNED_FROM and (model := grow_binned(train, rows, num_trees, seed, feats, bins)):
        return model
    train = materialize(train, "forest-train")      # MLlib reads its rows for each fit
    parts = [forest(min(each, num_trees - lo), seed=seed + lo, features=feats, max_bins=bins).fit(train) for lo in range(0, num_trees, each)]
    return joined_forest(parts)


def grow_binned(train: DataFrame, rows: int, num_trees: int, seed: int, feats: list[str], bins: int) -> PipelineModel | None:
    """M7's forest on many rows, grown on binned rows (``grow``); None where weights differ within a class or the bins are too many."""
    of = train.groupBy("label").agg(F.min("weight").alias("low"), F.max("weight").alias("high")).collect()   # one row for each class
    stage = forest(num_trees, seed=seed, features=feats, max_bins=bins).getStages()[-1]
    depth, min_leaf = stage.getMaxDepth(), stage.getMinInstancesPerNode()
    weight = np.zeros(int(max(r["label"] for r in of)) + 1)
    for r in of:
        weight[int(r["label"])] = r["low"]
    if any(r["low"] != r["high"] for r in of):
        return None
    cuts = grow.thresholds(train, feats, bins)
    if not grow.fits_in_cells(cuts, len(weight), math.ceil(math.sqrt(len(feats))), depth):
        return None
    nodes = grow.grow_trees(train, feats, cuts, weight, rows, num_trees, depth, min_leaf, seed)
    return grow.as_model(train.sparkSession, nodes, feats, weight, {p.name: v for p, v in stage.extractParamMap().items()})


def joined_forest(parts: list[PipelineModel]) -> PipelineModel:
    """One model of all trees of forests that were fitted to the same rows."""
    if len(parts) == 1:
        return parts[0]
    spark, first = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), parts[0].stages[-1]
    trees = [t for p in parts for t in p.stages[-1]._java_obj.trees()]
    package = spark._jvm.org.apache.spark.ml.classification
    array = spark.sparkContext._gateway.new_array(package.DecisionTreeClassificationModel, len(trees))
    for i, t in enumerate(trees):
        array[i] = t
    whole = RandomForestClassificationModel(package.RandomForestClassificationModel(array, first.numFeatures, first.numClasses))
    first._copyValues(whole)
    whole._set(numTrees=len(trees))
    whole._transfer_params_to_java()
    return PipelineModel([*parts[0].stages[:-1], whole])


def fit_attack_model(data: DataFrame, num_trees: int = 300, seed: int = 42) -> PipelineModel:
    return grow_forest(weighted_rows(data.filter("is_train")), num_trees, seed)


def class_report(pred: DataFrame) -> DataFrame:
    """M9: per-class precision / recall / F1 / support (zero division -> 0)."""
    tp = pred.groupBy("label").agg(F.sum(F.when(F.col("prediction") == F.col("label"), 1).otherwise(0)).alias("tp"),
                                   F.count(F.lit(1)).alias("support"))
    predicted = pred.groupBy(F.col("prediction").alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    r = tp.join(predicted, "label", "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    r = r.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return r.withColumn("f1", f1).select("label", "precision", "recall", "f1", "support")


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """M9: (label, prediction, n)."""
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg((F.sum(F.when(F.col("prediction") == F.col("label"), 1).otherwise(0))
                     / F.count(F.lit(1))).alias("accuracy"))


def weighted_f1(pred: DataFrame) -> DataFrame:
    rep = class_report(pred)
    return rep.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def attack_metrics(model: PipelineModel, data: DataFrame) -> DataFrame:
    """M8: train / test accuracy, overfit gap, weighted F1 on test, row counts — one row."""
    return prediction_metrics(forest_predictions(model, data, ["label", "is_train"]))


def prediction_metrics(pred: DataFrame) -> DataFrame:
    """M8 from (label, prediction, is_train) rows."""
    counts = materialize(pred.groupBy("label", "prediction", "is_train").agg(F.count(F.lit(1)).alias("n")), "prediction-counts")
    right = F.when(F.col("prediction") == F.col("label"), F.col("n")).otherwise(0)
    of = lambda c, train: F.sum(F.when(F.col("is_train") == train, c).otherwise(0))
    acc = counts.agg((of(right, True) / of(F.col("n"), True)).alias("train_accuracy"),
                     (of(right, False) / of(F.col("n"), False)).alias("test_accuracy"),
                     of(F.col("n"), True).alias("train_rows"), of(F.col("n"), False).alias("test_rows"))
    test = counts.filter("not is_train")
    seen = test.groupBy("label").agg(F.sum("n").alias("support"), F.sum(right).alias("tp"))
    said = test.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    # 2PR / (P + R) = 2 tp / (support + said)
    f1 = (seen.join(said, "label", "left")
          .agg((F.sum(2 * F.col("tp") * F.col("support") / (F.col("support") + F.coalesce("said", F.lit(0)))) / F.sum("support")).alias("f")))
    return (acc.withColumn("overfit_gap", F.col("train_accuracy") - F.col("test_accuracy"))
            .withColumn("weighted_f1", f1.select("f").scalar()))


def feature_importance(spark: SparkSession, model: PipelineModel, names: list[str] | None = None) -> DataFrame:
    """The forest's importances ranked (a vector of #features values)."""
    names = names or feature_names()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda x: -x[1])
    return spark.createDataFrame([(i + 1, f, float(v)) for i, (f, v) in enumerate(rows)],
                                 "rank int, feature string, importance double")


# ---- M10 ------------------------------------------------------------------------------

def stratified_folds(df: DataFrame, k: int = 5, label: str = TARGET) -> DataFrame:
    """Per class, time order split into k contiguous folds (sizes differ by <= 1)."""
    pos = ordered_position(df, DAY, "incident_id", [label], out="cpos")
    n_c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    return pos.join(n_c, label).withColumn("fold", F.floor(k * F.col("cpos") / F.col("n_c")).cast("int"))


def cross_validate(data: DataFrame, k: int = 5, num_trees: int = 300, seed: int = 42) -> DataFrame:
    """Accuracy per fold (train on the other folds), plus mean and std rows (k + 2 rows)."""
    folded = write_even(stratified_folds(data, k), data.count(), "cv-folds")

    def fitted(f: int) -> PipelineModel:
        tr = folded.filter(F.col("fold") != f)
        weighted = materialize(tr.join(F.broadcast(class_weights(tr)), "label"), "cv-train")
        model = grow_forest(weighted, num_trees, seed)
        release(weighted)
        return model

    with ThreadPool(min(k, FITS_AT_ONCE)) as pool:      # as MLlib's CrossValidator does with ``parallelism``
        models = pool.map(inheritable_thread_target(data.sparkSession)(fitted), range(k), chunksize=1)
    scores = [accuracy(forest_predictions(m, folded.filter(F.col("fold") == f), ["label"])).withColumn("fold", F.lit(f)) for f, m in enumerate(models)]
    each = materialize(functools.reduce(DataFrame.unionByName, scores), "cv-scores")
    return fold_summary(each)


def fold_summary(scores: DataFrame) -> DataFrame:
    """(fold, accuracy) with rows 'mean' and 'std' (population) added."""
    both = scores.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))
    rows = both.select(F.explode(F.array(F.struct(F.lit("mean").alias("fold"), F.col("mean").alias("accuracy")),
                                         F.struct(F.lit("std").alias("fold"), F.col("std").alias("accuracy")))).alias("r"))
    return scores.select(F.col("fold").cast("string"), "accuracy").unionByName(rows.select("r.fold", "r.accuracy"))


# ---- M12 / M13 ------------------------------------------------------------------------

def threat_band(df: DataFrame) -> DataFrame:
    """impact = kill + wound; <= 2 LOW, <= 10 MEDIUM, else HIGH.

    Note: the label is a function of two model inputs (kill, wound), so a threat
    model's near-perfect accuracy is leakage, as in the reference.
    """
    impact = nonneg("nkill") + nonneg("nwound")
    return df.withColumn("impact", impact).withColumn(
        "threat_level", F.when(F.col("impact") <= 2, "LOW").when(F.col("impact") <= 10, "MEDIUM").otherwise("HIGH"))


def threat_data(incidents: DataFrame) -> DataFrame:
    """M13 data: rows without NULL among the 5 categoricals; encoders fit on all rows;
    split 80/20 by stored row order (incident_id)."""
    df = incidents.dropna(subset=THREAT_CATS)
    df = threat_band(df).withColumns({"nkill": nonneg("nkill"), "nwound": nonneg("nwound")})
    df = materialize(df, "threat-rows")
    enc = ordinal_encode(df, ordinal_dictionaries(df, THREAT_CATS), THREAT_CATS)
    labels = label_dictionary(df, "threat_level")
    enc = enc.join(F.broadcast(labels.withColumnRenamed("value", "threat_level")), "threat_level")  # three rows
    return _split_at(ordered_position(enc, [], "incident_id"), 0.8, even=True)


def fit_threat_model(data: DataFrame, num_trees: int = 200, seed: int = 42) -> PipelineModel:
    train = data.filter("is_train")
    feats = [c + "_code" for c in THREAT_CATS] + ["nkill", "nwound"]
    return grow_forest(weighted_rows(train), num_trees, seed, feats)


# ---- M14 / M15 ------------------------------------------------------------------------

def save_model(model: PipelineModel, dicts: DataFrame, labels: DataFrame, medians: DataFrame,
               path: str) -> None:
    """The pipeline plus encoder dictionaries, label map and medians as tables."""
    model.write().overwrite().save(f"{path}/pipeline")
    dicts.write.mode("overwrite").parquet(f"{path}/dictionaries")
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    medians.write.mode("overwrite").parquet(f"{path}/medians")


def load_and_score(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Batch scoring of new rows with the stored artifacts (unseen -> -1)."""
    model = PipelineModel.load(f"{path}/pipeline")
    dicts = spark.read.parquet(f"{path}/dictionaries")
    labels = spark.read.parquet(f"{path}/labels")
    medians = spark.read.parquet(f"{path}/medians")
    prepared = ordinal_encode(impute(rows, medians), dicts)
    pred = forest_predictions(model, prepared, prepared.columns, probability=True)
    return pred.join(F.broadcast(labels.withColumnRenamed("label", "prediction")
                                 .withColumnRenamed("value", "predicted_attack")), "prediction", "left")


def occlusion_contributions(model: PipelineModel, rows: DataFrame, fills: dict[str, float],
                            id_col: str = "incident_id", top: int = 3) -> DataFrame:
    """M15 (re-aimed TreeSHAP): each feature replaced by its train median/mode; the drop in
    the predicted class's probability is its contribution; top 3 by |contribution|.

    A task scores all variants of its rows, tree by tree, and keeps a row's top ones; rows of one id are ranked together.
    """
    feats = list(fills)
    names = model.stages[0].getInputCols()
    shared = rows.sparkSession.sparkContext.broadcast(Forest(forest_nodes(model).toPandas()))
    tried = sorted(feats)                # equal contributions rank by name

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in chunks(batches, names):
            share = lambda: (v := shared.value.votes(x)) / v.sum(axis=0)  # noqa: E731, B023
            base, n = share(), np.arange(len(part))
            best = base.argmax(axis=0)
            change = np.empty((len(part), len(tried)))
            for j, f in enumerate(tried):
                kept = x[names.index(f)].copy()
                x[names.index(f)] = float(fills[f])
                change[:, j] = base[best, n] - share()[best, n]
                x[names.index(f)] = kept
            first = np.argsort(-np.abs(change), axis=1, kind="stable")[:, :top]
            yield pd.DataFrame({id_col: part[id_col].repeat(first.shape[1]).to_numpy(), "feature": np.array(tried, dtype=object)[first.ravel()],
                                "base_prediction": best.repeat(first.shape[1]).astype(float), "contribution": np.take_along_axis(change, first, axis=1).ravel()})

    contrib = rows.select(id_col, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(
        score, f"{id_col} {dict(rows.dtypes)[id_col]}, feature string, base_prediction double, contribution double")
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("contribution")), "feature")
    return contrib.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


# ---- M15: contributions along tree paths ------------------------------------------------

def forest_nodes(model: PipelineModel) -> DataFrame:
    """The forest as a table: tree, node, class shares, and (inner nodes) feature, threshold or left categories, children."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()     # none is active in a thread of its own
    path = getattr(model.stages[-1], "saved_at", None)      # a grown forest was loaded from its table of nodes
    if path is None:
        path = scratch_path(spark, "forest")
        model.stages[-1].write().overwrite().save(path)
    n = F.col("nodeData")
    total = F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.transform(n["impurityStats"], lambda x: x / total).alias("shares"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        n["split"]["leftCategoriesOrThreshold"].alias("cut"), n["split"]["numCategories"].alias("categories"))


class Forest:
    """The node table as arrays; all trees' nodes laid end to end."""

    def __init__(self, nodes: pd.DataFrame) -> None:
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        size = nodes.groupby("tree").size().to_numpy()
        self.root = np.cumsum(size) - size
        at = {(t, n): i for i, (t, n) in enumerate(zip(nodes["tree"], nodes["node"], strict=True))}
        child = lambda c: np.array([at.get((t, n), -1) for t, n in zip(nodes["tree"], nodes[c], strict=True)])
        self.share = np.array(nodes["shares"].tolist(), dtype=np.float64)
        self.inner = (nodes["left"] >= 0).to_numpy()
        self.left, self.right = child("left"), child("right")
        self.feature = np.where(self.inner, nodes["feature"], 0).astype(np.int64)
        self.threshold = np.array([c[0] if len(c) else 0.0 for c in nodes["cut"]])
        self.by_class = [np.ascontiguousarray(c) for c in self.share.T]
        itself = np.arange(len(nodes))
        self.child = np.stack([np.where(self.inner, self.right, itself), np.where(self.inner, self.left, itself)], axis=1).ravel()
        self.depth, below = 0, self.root[self.inner[self.root]]
        while len(below):
            below = np.concatenate([self.left[below], self.right[below]])
            below = below[self.inner[below]]
            self.depth += 1
        self.listed = {i: np.array(nodes["cut"][i]) for i in np.flatnonzero(self.inner & (nodes["categories"] >= 0).to_numpy())}
        self.top = min(self.depth, grow.LOOKED)                 # levels that the lookups descend
        self.cuts = [np.unique(self.threshold[self.inner & (self.feature == f)]) for f in range(self.feature.max() + 1)]
        self.groups = grow.joined(self.bins)

    @property
    def bins(self) -> tuple[int, ...]:
        return tuple(len(c) + 1 for c in self.cuts)

    @functools.cached_property
    def lookups(self) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """For each tree: by joint bin of each group of features the nodes of level ``top`` that it leaves, and these nodes; made where rows are scored."""
        shape, made = grow.Shape(len(self.cuts), self.share.shape[1], 0, 0, self.top, 0, self.bins), []
        for root in self.root:
            at = np.full(2 << self.top, root)                   # children of n at 2 n and 2 n + 1; leaves go left down to ``top``
            for lo in [1 << k for k in range(self.top)]:
                here = at[lo: 2 * lo]
                at[2 * lo: 4 * lo: 2], at[2 * lo + 1: 4 * lo: 2] = self.child.take(2 * here + 1), self.child.take(2 * here)
            feature = np.where(self.inner[at], self.feature[at], -1)
            cut = [np.searchsorted(self.cuts[f], t) if f >= 0 else 0 for f, t in zip(feature, self.threshold[at], strict=True)]
            made.append((grow.open_nodes(feature, np.array(cut), self.top, shape, self.groups), at[1 << self.top:]))
        return made

    def joint_bins(self, x: np.ndarray) -> list[np.ndarray]:
        """The joint bin of every row of ``x`` for each group; the bin of a value counts the cuts below it (all, for NaN)."""
        codes = []
        for g in self.groups:
            code = np.zeros(x.shape[1], dtype=np.intp)
            for f in g:
                code = code * self.bins[f] + np.searchsorted(self.cuts[f], x[f])
            codes.append(code)
        return codes

    def step(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The next node of every (row, tree); leaves stay."""
        value = np.take_along_axis(x, self.feature[at], axis=1)
        left = value <= self.threshold[at]
        for node, categories in self.listed.items():
            here = at == node
            left[here] = np.isin(value[here], categories)
        return np.where(self.inner[at], np.where(left, self.left[at], self.right[at]), at)

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Class shares summed over the trees, for each row of ``x`` (features x rows), added up tree by tree as MLlib does."""
        total = np.zeros((self.share.shape[1], x.shape[1]))
        for at in self.leaves(x):
            for c, share in enumerate(self.by_class):
                total[c] += share.take(at)
        return total

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of every row of ``x`` (features x rows), tree by tree; the first levels by lookups."""
        n = x.shape[1]
        if self.listed:
            for root in self.root:
                at = np.full(n, root)
                for _ in range(self.depth):
                    at = self.step(x.T, at[:, None])[:, 0]
                yield at
            return
        flat, rows, base, codes = x.ravel(), np.arange(n), self.feature * n, self.joint_bins(x)
        for tables, nodes in self.lookups:
            bits = tables[0].take(codes[0])
            for t, c in zip(tables[1:], codes[1:], strict=True):
                bits &= t.take(c)
            at = nodes.take(np.bitwise_count(bits - 1))
            for _ in range(self.depth - self.top):
                at = self.child.take(2 * at + (flat.take(base.take(at) + rows) <= self.threshold.take(at)))
            yield at

    def shifts(self, tree: int, width: int) -> np.ndarray:
        """How the class shares of each node of a tree come from the root's: (node, class, feature), changes along the path by split feature."""
        lo, hi = self.root[tree], self.root[tree + 1] if tree + 1 < len(self.root) else len(self.share)
        change = np.zeros((hi - lo, self.share.shape[1], width))
        at = self.root[tree: tree + 1]
        while len(at := at[self.inner[at]]):
            for child in (self.left[at], self.right[at]):
                change[child - lo] = change[at - lo]
                change[child - lo, :, self.feature[at]] += self.share[child] - self.share[at]
            at = np.concatenate([self.left[at], self.right[at]])
        return change

    def explain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, base share, probability, contribution of each feature) of every row's most probable class."""
        trees, (n, width) = len(self.root), x.shape
        total, ends = np.zeros((n, self.share.shape[1])), []
        for at in self.leaves(np.ascontiguousarray(x.T)):
            total += self.share.take(at, axis=0)
            ends.append(at.astype(np.int32))
        best, classes = total.argmax(axis=1), self.share.shape[1]
        contribution = np.zeros((n, width))
        for tree, at in enumerate(ends):
            contribution += self.shifts(tree, width).reshape(-1, width).take((at - self.root[tree]) * classes + best, axis=0)
        return best, self.share[self.root][:, best].mean(axis=0), total[np.arange(n), best] / trees, contribution / trees


def chunks(batches: Iterator[pd.DataFrame], names: list[str], rows: int = 8192) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Some rows at a time, with their values feature by feature."""
    for b in batches:
        for lo in range(0, len(b), rows):
            part = b.iloc[lo: lo + rows]
            yield part, np.ascontiguousarray(part[names].to_numpy(np.float64).T)


def forest_predictions(model: PipelineModel, rows: DataFrame, keep: list[str], probability: bool = False) -> DataFrame:
    """The columns ``keep`` and the forest's prediction of every row, as ``transform`` gives it, with rows scored tree by tree."""
    names = model.stages[0].getInputCols()
    shared = rows.sparkSession.sparkContext.broadcast(Forest(forest_nodes(model).toPandas()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 8192):
                part = b.slice(lo, 8192)
                kept, values = part.columns[:len(keep)], part.columns[len(keep):]
                votes = shared.value.votes(np.stack([v.to_numpy(zero_copy_only=False) for v in values]))
                said = [pa.array((votes / votes.sum(axis=0)).T.tolist(), pa.list_(pa.float64()))] if probability else []
                yield pa.RecordBatch.from_arrays([*kept, *said, pa.array(votes.argmax(axis=0).astype(float))], names=out.names)

    out = StructType([rows.schema[c] for c in keep])
    out = (out.add("probability", ArrayType(DoubleType())) if probability else out).add("prediction", DoubleType())
    wanted = [*keep, *[F.col(c).cast("double").alias("x_" + c) for c in names]]
    scored = rows.select(*wanted).mapInArrow(predict, out)
    return scored.withColumn("probability", array_to_vector("probability")) if probability else scored


def path_contributions(model: PipelineModel, rows: DataFrame, names: list[str] | None = None, id_col: str = "incident_id") -> DataFrame:
    """(id, prediction, base, probability, contributions): how the predicted class's probability comes about.

    A row walks down every tree; at each split the change of the class's share goes to the split's feature.  The mean
    share at the roots plus all contributions is the forest's probability, exactly.  The node table goes to the tasks:
    its size depends on the forest, not on the rows.
    """
    names = names or feature_names()
    shared = rows.sparkSession.sparkContext.broadcast(Forest(forest_nodes(model).toPandas()))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.iloc[lo: lo + 4096]
                best, base, probability, each = shared.value.explain(part[names].to_numpy(np.float64))
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "prediction": best.astype(float), "base": base, "probability": probability,
                                    "contributions": [dict(zip(names, e.tolist(), strict=True)) for e in each]})

    kind = dict(rows.dtypes)[id_col]
    return rows.select(id_col, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(
        explain, f"{id_col} {kind}, prediction double, base double, probability double, contributions map<string, double>")


def load_and_explain(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """New rows scored with a saved model, with the contributions to the predicted class: predicted_attack, probability, base, contributions."""
    model = PipelineModel.load(f"{path}/pipeline")
    prepared = ordinal_encode(impute(rows, spark.read.parquet(f"{path}/medians")), spark.read.parquet(f"{path}/dictionaries"))
    names = spark.read.parquet(f"{path}/labels").select(F.col("label").alias("prediction"), F.col("value").alias("predicted_attack"))
    return path_contributions(model, prepared).join(F.broadcast(names), "prediction", "left").drop("prediction")
