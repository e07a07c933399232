"""Classification queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.functions.expr import round_even
from tessera.operators import ml
from tessera.plans.registry import query
from tessera.session import materialize, scratch_path

BASE_SQL = """base AS (SELECT * REPLACE (CASE WHEN attacktype1_txt = 'Hostage Taking (Barricade Incident)'
    THEN 'Hostage Taking (Kidnapping)' ELSE attacktype1_txt END AS attacktype1_txt) FROM incidents
  WHERE attacktype1_txt IS NOT NULL AND trim(attacktype1_txt) NOT IN ('', 'Unknown', 'unknown')),
split AS (SELECT *, row_number() OVER (ORDER BY iyear, imonth, iday, incident_id) - 1 AS pos,
  (row_number() OVER (ORDER BY iyear, imonth, iday, incident_id) - 1)
    < floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) AS is_train FROM base),
med AS (SELECT median(CAST(iyear AS DOUBLE)) AS iyear, median(CAST(success AS DOUBLE)) AS success,
  median(CAST(suicide AS DOUBLE)) AS suicide, median(CAST(nkill AS DOUBLE)) AS nkill,
  median(CAST(nwound AS DOUBLE)) AS nwound FROM split WHERE is_train),
imp AS (SELECT s.incident_id, s.is_train, s.attacktype1_txt,
  coalesce(s.country_txt, 'Unknown') AS country_txt, coalesce(s.region_txt, 'Unknown') AS region_txt,
  coalesce(s.weaptype1_txt, 'Unknown') AS weaptype1_txt, coalesce(s.targtype1_txt, 'Unknown') AS targtype1_txt,
  coalesce(s.gname, 'Unknown') AS gname,
  coalesce(CAST(s.iyear AS DOUBLE), m.iyear) AS iyear, coalesce(CAST(s.success AS DOUBLE), m.success) AS success,
  coalesce(CAST(s.suicide AS DOUBLE), m.suicide) AS suicide, coalesce(CAST(s.nkill AS DOUBLE), m.nkill) AS nkill,
  coalesce(CAST(s.nwound AS DOUBLE), m.nwound) AS nwound FROM split s CROSS JOIN med m)"""


def _split(spark):
    return ml.chronological_split(ml.training_frame(spark.table("incidents")))


def _imputed(spark):
    s = _split(spark)
    return ml.impute(s, ml.train_medians(s))


@query("m1_chronological_split", oracle=f"WITH {BASE_SQL}\nSELECT incident_id, pos, is_train FROM split")
def m1_chronological_split(spark):
    return _split(spark).select("incident_id", "pos", "is_train")


@query("m2_overlap_check", oracle=f"""WITH {BASE_SQL}
SELECT count(*) AS overlap FROM (
  SELECT country_txt, region_txt, weaptype1_txt, targtype1_txt, gname, iyear, success, suicide, nkill, nwound
  FROM split WHERE is_train INTERSECT
  SELECT country_txt, region_txt, weaptype1_txt, targtype1_txt, gname, iyear, success, suicide, nkill, nwound
  FROM split WHERE NOT is_train) t""")
def m2_overlap_check(spark):
    return ml.overlap_rows(_split(spark))


@query("m3_train_medians", oracle=f"WITH {BASE_SQL}\nSELECT * FROM med")
def m3_train_medians(spark):
    return ml.train_medians(_split(spark))


_CODES = ", ".join(
    f"coalesce(d_{c}.code, -1.0) AS {c}_code" for c in ml.CAT_COLS)
_DICTS = ",\n".join(
    f"d_{c} AS (SELECT {c} AS value, CAST(row_number() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS code "
    f"FROM (SELECT DISTINCT {c} FROM imp WHERE is_train) t)" for c in ml.CAT_COLS)
_JOINS = " ".join(f"LEFT JOIN d_{c} ON d_{c}.value = i.{c}" for c in ml.CAT_COLS)


@query("m4_ordinal_encoding", oracle=f"""WITH {BASE_SQL},
{_DICTS}
SELECT i.incident_id, {_CODES} FROM imp i {_JOINS}""")
def m4_ordinal_encoding(spark):
    imp = _imputed(spark)
    enc = ml.ordinal_encode(imp, ml.ordinal_dictionaries(imp.filter("is_train")))
    return enc.select("incident_id", *[c + "_code" for c in ml.CAT_COLS])


@query("m5_label_encoding", oracle=f"""WITH {BASE_SQL}
SELECT attacktype1_txt AS value, CAST(row_number() OVER (ORDER BY attacktype1_txt) - 1 AS DOUBLE) AS label
FROM (SELECT DISTINCT attacktype1_txt FROM split) t""")
def m5_label_encoding(spark):
    return ml.label_dictionary(_split(spark))


@query("m6_majority_baseline", oracle=f"""WITH {BASE_SQL},
maj AS (SELECT attacktype1_txt AS m FROM split WHERE is_train GROUP BY attacktype1_txt
  ORDER BY count(*) DESC, attacktype1_txt LIMIT 1)
SELECT (SELECT m FROM maj) AS majority_class,
  sum(CASE WHEN attacktype1_txt = (SELECT m FROM maj) THEN 1 ELSE 0 END) / count(*) AS baseline_accuracy
FROM split WHERE NOT is_train""")
def m6_majority_baseline(spark):
    return ml.majority_baseline(_split(spark))


_TRAINED: dict = {}


def _attack(spark, trees: int = 300, split=None):
    """Prepared data and the fitted forest.  The same data, seed and size give the same model:
    M7-M15 share the one that belongs to this data's fingerprint."""
    data, dicts, labels = ml.prepared_attack_data(spark.table("incidents")) if split is None else ml.prepared_split(split)
    if not trees:
        return data, dicts, labels, None
    seen = data.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*data.columns))).first()
    key = (spark.sparkContext.applicationId, trees, *seen)
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = ml.fit_attack_model(data, trees)
    return data, dicts, labels, _TRAINED[key]


@query("m7_attack_forest_predictions")
def m7_attack_forest_predictions(spark):
    data, _, _, model = _attack(spark)
    return ml.forest_predictions(model, data.filter("not is_train"), ["incident_id", "label"])


@query("m8_attack_metrics")
def m8_attack_metrics(spark):
    data, _, _, model = _attack(spark)
    return ml.attack_metrics(model, data)


@query("m9_confusion_matrix")
def m9_confusion_matrix(spark):
    data, _, _, model = _attack(spark)
    return ml.confusion_matrix(ml.forest_predictions(model, data.filter("not is_train"), ["label"]))


_RULE_SQL = """maj AS (SELECT attacktype1_txt AS m FROM split WHERE is_train GROUP BY attacktype1_txt
  ORDER BY count(*) DESC, attacktype1_txt LIMIT 1),
rule AS (SELECT weaptype1_txt, attacktype1_txt AS pred FROM (SELECT weaptype1_txt, attacktype1_txt,
  row_number() OVER (PARTITION BY weaptype1_txt ORDER BY count(*) DESC, attacktype1_txt) AS rn
  FROM split WHERE is_train AND weaptype1_txt IS NOT NULL GROUP BY 1, 2) t WHERE rn = 1),"""


def _rule_predictions(spark):
    """(label, prediction, is_train) of the train-majority attack type per weapon type (the overall
    majority for unseen weapons)."""
    s = _split(spark)
    tr = s.filter("is_train")
    rule = (tr.filter(F.col("weaptype1_txt").isNotNull()).groupBy("weaptype1_txt")
            .agg(F.mode(ml.TARGET, True).alias("pred")))
    maj = tr.select(F.mode(ml.TARGET, True)).scalar()
    return (s.join(F.broadcast(rule), "weaptype1_txt", "left")     # one row for each weapon type
            .select(F.col(ml.TARGET).alias("label"), F.coalesce("pred", maj).alias("prediction"), "is_train"))


@query("m8_rule_predictor_metrics", oracle=f"""WITH {BASE_SQL},
{_RULE_SQL}
p AS (SELECT s.attacktype1_txt AS label, coalesce(r.pred, (SELECT m FROM maj)) AS prediction, s.is_train
  FROM split s LEFT JOIN rule r USING (weaptype1_txt)),
tp AS (SELECT label, sum(CASE WHEN prediction = label THEN 1 ELSE 0 END) AS tp, count(*) AS support FROM p WHERE NOT is_train GROUP BY label),
np AS (SELECT prediction AS label, count(*) AS said FROM p WHERE NOT is_train GROUP BY prediction),
f AS (SELECT sum(2 * tp * support / (support + coalesce(said, 0))) / sum(support) AS f1 FROM tp LEFT JOIN np USING (label)),
a AS (SELECT sum(CASE WHEN is_train AND prediction = label THEN 1 ELSE 0 END) / sum(CASE WHEN is_train THEN 1 ELSE 0 END) AS tr,
  sum(CASE WHEN NOT is_train AND prediction = label THEN 1 ELSE 0 END) / sum(CASE WHEN NOT is_train THEN 1 ELSE 0 END) AS te,
  CAST(sum(CASE WHEN is_train THEN 1 ELSE 0 END) AS BIGINT) AS train_rows, CAST(sum(CASE WHEN NOT is_train THEN 1 ELSE 0 END) AS BIGINT) AS test_rows FROM p)
SELECT round_even(tr, 6) AS train_accuracy, round_even(te, 6) AS test_accuracy, train_rows, test_rows,
  round_even(tr - te, 6) AS overfit_gap, round_even((SELECT f1 FROM f), 6) AS weighted_f1 FROM a""")
def m8_rule_predictor_metrics(spark):
    """M8's figures on a deterministic predictor."""
    m = ml.prediction_metrics(_rule_predictions(spark))
    return m.withColumns({c: round_even(c, 6) for c in ("train_accuracy", "test_accuracy", "overfit_gap", "weighted_f1")})


@query("m9_rule_predictor_report", oracle=f"""WITH {BASE_SQL},
maj AS (SELECT attacktype1_txt AS m FROM split WHERE is_train GROUP BY attacktype1_txt
  ORDER BY count(*) DESC, attacktype1_txt LIMIT 1),
rule AS (SELECT weaptype1_txt, attacktype1_txt AS pred FROM (SELECT weaptype1_txt, attacktype1_txt,
  row_number() OVER (PARTITION BY weaptype1_txt ORDER BY count(*) DESC, attacktype1_txt) AS rn
  FROM split WHERE is_train AND weaptype1_txt IS NOT NULL GROUP BY 1, 2) t WHERE rn = 1),
p AS (SELECT s.attacktype1_txt AS label, coalesce(r.pred, (SELECT m FROM maj)) AS prediction
  FROM split s LEFT JOIN rule r USING (weaptype1_txt) WHERE NOT s.is_train),
tp AS (SELECT label, sum(CASE WHEN prediction = label THEN 1 ELSE 0 END) AS tp, count(*) AS support FROM p GROUP BY label),
np AS (SELECT prediction AS label, count(*) AS n_pred FROM p GROUP BY prediction),
r AS (SELECT tp.label, tp.tp, tp.support, coalesce(np.n_pred, 0) AS n_pred FROM tp LEFT JOIN np USING (label)),
r2 AS (SELECT label, support, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM r)
SELECT label, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall,
  round_even(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1,
  support FROM r2""")
def m9_rule_predictor_report(spark):
    """M9's report formula on a deterministic predictor."""
    p = _rule_predictions(spark).filter("not is_train")
    rep = ml.class_report(p)
    return rep.select("label", *[round_even(c, 6).alias(c) for c in ["precision", "recall", "f1"]], "support")


_FOLD_SQL = f"""WITH {BASE_SQL},
f AS (SELECT attacktype1_txt AS label, coalesce(weaptype1_txt, 'none') AS weapon, CAST(floor(5 * (row_number() OVER (PARTITION BY
  attacktype1_txt ORDER BY iyear, imonth, iday, incident_id) - 1) / count(*) OVER (PARTITION BY attacktype1_txt)) AS INT) AS fold
  FROM base),
rule AS (SELECT k.fold, f.weapon, f.label AS pred, row_number() OVER (PARTITION BY k.fold, f.weapon ORDER BY count(*) DESC, f.label) AS rn
  FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY k.fold, f.weapon, f.label),
acc AS (SELECT f.fold, sum(CASE WHEN r.pred = f.label THEN 1 ELSE 0 END) / count(*) AS accuracy
  FROM f LEFT JOIN rule r ON r.fold = f.fold AND r.weapon = f.weapon AND r.rn = 1 GROUP BY f.fold)
"""


@query("m10_rule_cross_validation", oracle=_FOLD_SQL + """
SELECT CAST(fold AS VARCHAR) AS fold, round_even(accuracy, 9) AS accuracy FROM acc
UNION ALL SELECT 'mean', round_even(avg(accuracy), 9) FROM acc
UNION ALL SELECT 'std', round_even(stddev_pop(accuracy), 9) FROM acc""")
def m10_rule_cross_validation(spark):
    """M10's folds, mean and std on a deterministic predictor: the most frequent attack type per weapon
    in the other folds."""
    f = ml.stratified_folds(ml.training_frame(spark.table("incidents")))
    n = f.groupBy("fold", F.coalesce("weaptype1_txt", F.lit("none")).alias("weapon"), F.col(ml.TARGET).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    n = materialize(n, "rule-counts")                     # folds x weapons x classes
    other = (n.select(F.col("fold").alias("own"), "weapon", "label", "n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
             .filter("fold <> own").groupBy("fold", "weapon", "label").agg(F.sum("n").alias("n")))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("label").alias("pred")))
    rule = other.groupBy("fold", "weapon").agg(best.alias("b")).select("fold", "weapon", "b.pred")
    scored = n.join(rule, ["fold", "weapon"], "left")
    right = F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)
    each = scored.groupBy("fold").agg((F.sum(right) / F.sum("n")).alias("accuracy"))
    return ml.fold_summary(each).withColumn("accuracy", round_even("accuracy", 9))


@query("m10_cv_fold_sizes", oracle=f"""WITH {BASE_SQL},
f AS (SELECT attacktype1_txt, CAST(floor(5 * (row_number() OVER (PARTITION BY attacktype1_txt
  ORDER BY iyear, imonth, iday, incident_id) - 1) / count(*) OVER (PARTITION BY attacktype1_txt)) AS INT) AS fold
  FROM base)
SELECT attacktype1_txt, fold, count(*) AS n FROM f GROUP BY attacktype1_txt, fold""")
def m10_cv_fold_sizes(spark):
    f = ml.stratified_folds(ml.training_frame(spark.table("incidents")))
    return f.groupBy(ml.TARGET, "fold").agg(F.count(F.lit(1)).alias("n"))


@query("m10_cross_validation")
def m10_cross_validation(spark):
    data, _, _, _ = _attack(spark, trees=0)  # prepared data only; CV trains its own forests
    return ml.cross_validate(data, 5, num_trees=300)


@query("m11_feature_importance")
def m11_feature_importance(spark):
    _, _, _, model = _attack(spark)
    return ml.feature_importance(spark, model)


@query("m12_threat_band", oracle="""
SELECT incident_id, greatest(coalesce(TRY_CAST(nkill AS DOUBLE), 0.0), 0.0)
  + greatest(coalesce(TRY_CAST(nwound AS DOUBLE), 0.0), 0.0) AS impact,
  CASE WHEN greatest(coalesce(TRY_CAST(nkill AS DOUBLE), 0.0), 0.0) + greatest(coalesce(TRY_CAST(nwound AS DOUBLE), 0.0), 0.0) <= 2 THEN 'LOW'
    WHEN greatest(coalesce(TRY_CAST(nkill AS DOUBLE), 0.0), 0.0) + greatest(coalesce(TRY_CAST(nwound AS DOUBLE), 0.0), 0.0) <= 10 THEN 'MEDIUM'
    ELSE 'HIGH' END AS threat_level FROM incidents""")
def m12_threat_band(spark):
    return ml.threat_band(spark.table("incidents")).select("incident_id", "impact", "threat_level")


@query("m13_threat_model_metrics")
def m13_threat_model_metrics(spark):
    """Threat-level forest.  The label is built from two of its inputs (leakage, as in
    the reference), so near-perfect accuracy is expected and meaningless."""
    data = ml.threat_data(spark.table("incidents"))
    model = ml.fit_threat_model(data, 200)
    return ml.attack_metrics(model, data)


@query("m14_model_roundtrip")
def m14_model_roundtrip(spark):
    """Save the pipeline and encoders, load them back and score the test rows as new rows."""
    split = _split(spark)
    return _roundtrip(spark, split, *_attack(spark, split=split)[1:])


def _roundtrip(spark, split, dicts, labels, model):
    path = scratch_path(spark, "attack-model")
    ml.save_model(model, dicts, labels, ml.train_medians(split), path)
    rows = split.filter("not is_train").select("incident_id", *ml.CAT_COLS, *ml.NUM_COLS)
    return ml.load_and_score(spark, path, rows).select("incident_id", "predicted_attack")


@query("m15_occlusion_contributions")
def m15_occlusion_contributions(spark):
    data, _, _, model = _attack(spark)
    tr = data.filter("is_train")
    feats = ml.feature_names()
    fills = tr.agg(*[F.median(c).alias(c) for c in ml.NUM_COLS],
                   *[F.mode(c, True).alias(c) for c in feats if c.endswith("_code")]).collect()[0].asDict()
    rows = data.filter("not is_train").select("incident_id", *feats)
    return ml.occlusion_contributions(model, rows, {f: fills[f] for f in feats})


@query("m15_path_contributions", oracle=f"""WITH {BASE_SQL}
SELECT incident_id, TRUE AS additive, TRUE AS same_prediction, 10 AS features FROM split WHERE NOT is_train""")
def m15_path_contributions(spark):
    """Base plus contributions against the probability that the forest itself gives, for every test row."""
    data, _, _, model = _attack(spark)
    rows = data.filter("not is_train").select("incident_id", *ml.feature_names())
    ours = ml.path_contributions(model, rows)
    theirs = model.transform(rows).select("incident_id", F.col("prediction").alias("said"), F.array_max(vector_to_array("probability")).alias("p"))
    total = F.aggregate(F.map_values("contributions"), F.col("base"), lambda a, x: a + x)
    return ours.join(theirs, "incident_id").select("incident_id", (F.abs(total - F.col("p")) < 1e-9).alias("additive"),
                                                   (F.col("prediction") == F.col("said")).alias("same_prediction"), F.size("contributions").alias("features"))


@query("m7_predictions_known", oracle=f"""WITH {BASE_SQL}
SELECT incident_id, TRUE AS known FROM split WHERE NOT is_train""")
def m7_predictions_known(spark):
    """Every test row has a prediction among the train classes."""
    data, _, labels, model = _attack(spark)
    said = ml.forest_predictions(model, data.filter("not is_train"), ["incident_id"])
    known = F.broadcast(labels.select(F.col("label").alias("prediction"), F.lit(True).alias("known")))
    return said.join(known, "prediction", "left").select("incident_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("m9_matrix_support", oracle=f"""WITH {BASE_SQL}
SELECT attacktype1_txt AS value, count(*) AS support FROM split WHERE NOT is_train GROUP BY 1""")
def m9_matrix_support(spark):
    """The confusion matrix's rows sum to the classes' test rows."""
    data, _, labels, model = _attack(spark)
    matrix = ml.confusion_matrix(ml.forest_predictions(model, data.filter("not is_train"), ["label"]))
    return matrix.groupBy("label").agg(F.sum("n").alias("support")).join(F.broadcast(labels), "label").select("value", "support")


@query("m11_importance_sums", oracle="SELECT 10 AS features, CAST(1.0 AS DOUBLE) AS total, TRUE AS none_negative")
def m11_importance_sums(spark):
    _, _, _, model = _attack(spark)
    return ml.feature_importance(spark, model).agg(F.count(F.lit(1)).cast("int").alias("features"), F.round(F.sum("importance"), 9).alias("total"),
                                                   (F.min("importance") >= 0).alias("none_negative"))


@query("m13_threat_support", oracle="""
SELECT count(*) - CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS test_rows, TRUE AS accurate FROM incidents""")
def m13_threat_support(spark):
    """The threat forest is scored on the last fifth; its label derives from two inputs, so it must find it nearly always."""
    data = ml.threat_data(spark.table("incidents"))
    m = ml.attack_metrics(ml.fit_threat_model(data, 20), data)
    return m.select("test_rows", (F.col("test_accuracy") > 0.8).alias("accurate"))


@query("m14_roundtrip_differences", oracle=f"""WITH {BASE_SQL}
SELECT count(*) AS rows, 0 AS different FROM split WHERE NOT is_train""")
def m14_roundtrip_differences(spark):
    """Test rows scored as new rows by the saved and reloaded model, against the model itself."""
    split = _split(spark)
    data, dicts, labels, model = _attack(spark, split=split)
    again = _roundtrip(spark, split, dicts, labels, model)
    first = model.transform(data.filter("not is_train")).select("incident_id", F.col("prediction").alias("label")).join(F.broadcast(labels), "label")
    both = again.join(first, "incident_id")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("predicted_attack").eqNullSafe(F.col("value"))).cast("int").alias("different"))
