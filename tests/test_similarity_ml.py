"""Similar incidents and classifier quality bands."""

from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators import ml, similarity

ROWS = [
    (1, 2020, "Iraq", "Middle East & North Africa", "Bombing/Explosion", "Explosives", "Private Citizens & Property",
     "Unknown Group", 5.0, 10.0, 1),
    (2, 2021, "Afghanistan", "South Asia", "Armed Assault", "Firearms", "Military", "Taliban", 12.0, 25.0, 1),
    (3, 2019, "Iraq", "Middle East & North Africa", "Bombing/Explosion", "Explosives", "Police", "Islamic State",
     3.0, 7.0, 1),
]
SCHEMA = ("incident_id long, iyear int, country_txt string, region_txt string, attacktype1_txt string, "
          "weaptype1_txt string, targtype1_txt string, gname string, nkill double, nwound double, success int")


def test_top2_is_iraq(spark):
    # five copies of each incident so every label passes min_df = 5
    rows = [(r[0] + 3 * c,) + r[1:] for c in range(5) for r in ROWS]
    corpus = spark.createDataFrame(rows, SCHEMA)
    query = spark.createDataFrame([ROWS[0]], SCHEMA)
    out = similarity.similar_incidents(corpus, query, 2).orderBy("rank").collect()
    assert [r["incident_id"] for r in out] == [13, 10]      # exact copies, larger id first
    assert all(r["similarity_pct"] > 90 for r in out)


def test_tiny_corpus_ties(spark):
    """Six rows: only terms shared by all pass min_df, every score ties at 100 %."""
    rows = ROWS + [(r[0] + 3,) + r[1:] for r in ROWS]
    out = similarity.similar_incidents(spark.createDataFrame(rows, SCHEMA),
                                       spark.createDataFrame([ROWS[0]], SCHEMA), 2).collect()
    assert len(out) == 2 and all(r["similarity_pct"] > 90 for r in out)


def test_attack_model_beats_baseline(spark, small):
    data, dicts, labels = ml.prepared_attack_data(spark.table("incidents"))
    model = ml.fit_attack_model(data, num_trees=20)
    m = ml.attack_metrics(model, data).first()
    base = ml.majority_baseline(ml.chronological_split(ml.training_frame(spark.table("incidents")))).first()
    assert 0 <= m["test_accuracy"] <= 1 and m["train_rows"] > m["test_rows"]
    assert m["train_accuracy"] >= base["baseline_accuracy"] - 0.05


def test_folds_are_balanced(spark, small):
    f = ml.stratified_folds(ml.training_frame(spark.table("incidents")))
    sizes = f.groupBy(ml.TARGET, "fold").count().groupBy(ml.TARGET).agg(
        (F.max("count") - F.min("count")).alias("spread"), F.countDistinct("fold").alias("k")).collect()
    assert all(r["spread"] <= 1 and r["k"] == 5 for r in sizes)


def test_saved_model_scores_new_rows(spark, small):
    from tessera.session import scratch_path
    data, dicts, labels = ml.prepared_attack_data(spark.table("incidents"))
    model = ml.fit_attack_model(data, num_trees=10)
    split = ml.chronological_split(ml.training_frame(spark.table("incidents")))
    path = scratch_path(spark, "t-model")
    ml.save_model(model, dicts, labels, ml.train_medians(split), path)
    new = spark.createDataFrame([(1, "Atlantis", "Nowhere", "Laser", "Moon", "New group", 2000.0, 1.0, 0.0, 1.0, 2.0)],
                                "incident_id long, country_txt string, region_txt string, weaptype1_txt string, "
                                "targtype1_txt string, gname string, iyear double, success double, suicide double, "
                                "nkill double, nwound double")
    out = ml.load_and_score(spark, path, new).first()
    assert out["predicted_attack"] in {r["value"] for r in labels.collect()}


def test_threat_band(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (None, 20.0)], "nkill double, nwound double")
    assert [r["threat_level"] for r in ml.threat_band(df).collect()] == ["LOW", "MEDIUM", "HIGH"]


def test_whole_rows_and_any_block_of_queries(spark, monkeypatch):
    rows = [(r[0] + 3 * c,) + r[1:] for c in range(8) for r in ROWS]
    corpus, queries = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(ROWS, SCHEMA)
    want = sorted(map(tuple, similarity.similar_incidents(corpus, queries, 4, columns=["gname", "iyear"]).collect()))
    assert {len(r) for r in want} == {7} and len(want) == 12
    for name in ("CHUNK", "BLOCK", "SUPER", "FIRST"):
        monkeypatch.setattr(similarity, name, 1)
    assert sorted(map(tuple, similarity.similar_incidents(corpus, queries, 4, columns=["gname", "iyear"]).collect())) == want
    assert similarity.vocabulary(similarity.distinct_documents(corpus), similarity.term_counts(similarity.distinct_documents(corpus)),
                                 max_features=None).count() > 10


def test_blocks_are_skipped(spark, small, monkeypatch):
    """Every pair's score against plain numpy; few blocks are opened; a large vocabulary goes by joins."""
    from tessera.plans.q_similarity import _queries
    inc = spark.table("incidents")
    docs = similarity.distinct_documents(inc)
    tc = similarity.term_counts(docs)
    vocab = similarity.vocabulary(docs, tc)
    weights, asked = defaultdict(dict), defaultdict(dict)
    for r in similarity.tfidf(tc, vocab).collect():
        weights[r.doc_id][r.term] = r.w
    q = _queries(spark)
    qvec = similarity.tfidf(similarity.term_counts(q.select(similarity.pseudo_document(q).alias("query_doc")).distinct(), "query_doc", ("query_doc",)),
                            similarity.numbered(vocab), key="query_doc")
    number = {r.no: r.term for r in similarity.numbered(vocab).collect()}
    for r in qvec.collect():
        asked[r.query_doc][number[r.no]] = r.w
    top = {r.doc_id: r.top_id for r in docs.collect()}
    want = set()
    for name, v in asked.items():
        scores = [(round(sum(w * d.get(t, 0) for t, w in v.items()), 9), top[i]) for i, d in weights.items()]
        want |= {(name, t, s) for s, t in sorted((x for x in scores if x[0] > 0), reverse=True)[:10]}
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "FIRST", 2)
    pairs = []
    real = similarity.opened
    monkeypatch.setattr(similarity, "opened", lambda b, p, *rest: pairs.append(p.count()) or real(b, p, *rest))
    for most in (similarity.MAX_BROADCAST, 10):
        monkeypatch.setattr(similarity, "MAX_BROADCAST", most)
        pairs.clear()
        index = similarity.build_index(inc)
        got = similarity.best_documents(index["blocks"], index["bounds"], qvec, 10).collect()
        assert {(r.query_doc, r.top_id, round(r.skey, 9)) for r in got} == want and len(got) == len(want)
        blocks = index["blocks"].count()
        assert blocks > 20 and len(pairs) == 2 and sum(pairs) < blocks * len(asked) / 2


def test_cross_validation_threat_and_contributions(spark, small):
    data, _, _ = ml.prepared_attack_data(spark.table("incidents"))
    rows = {r["fold"]: r["accuracy"] for r in ml.cross_validate(data, 3, num_trees=5).collect()}
    each = [rows[str(i)] for i in range(3)]
    assert set(rows) == {"0", "1", "2", "mean", "std"} and abs(rows["mean"] - sum(each) / 3) < 1e-12
    assert abs(rows["std"] - (sum((x - rows["mean"]) ** 2 for x in each) / 3) ** 0.5) < 1e-12
    model = ml.fit_attack_model(data, num_trees=5)
    ranked = ml.feature_importance(spark, model).orderBy("rank").collect()
    assert len(ranked) == len(ml.feature_names()) and abs(sum(r["importance"] for r in ranked) - 1) < 1e-9
    assert [r["importance"] for r in ranked] == sorted((r["importance"] for r in ranked), reverse=True)
    fills = {f: 0.0 for f in ml.feature_names()}
    few = data.filter("not is_train").select("incident_id", *fills).limit(20)
    top = ml.occlusion_contributions(model, few, fills).groupBy("incident_id").agg(F.count("*").alias("n"), F.max("rank").alias("r")).collect()
    assert len(top) == 20 and all(r["n"] == 3 and r["r"] == 3 for r in top)
    threat = ml.threat_data(spark.table("incidents"))
    pos = [r["pos"] for r in threat.orderBy("incident_id").select("pos").collect()]
    assert pos == list(range(len(pos)))
    assert ml.attack_metrics(ml.fit_threat_model(threat, 20), threat).first()["test_accuracy"] > 0.8


def test_forest_grown_in_parts_is_one_model(spark, small, monkeypatch):
    import numpy as np
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from tessera.session import scratch_path
    data, _, _ = ml.prepared_attack_data(spark.table("incidents"))
    train = data.filter("is_train").withColumn("weight", F.lit(1.0))
    monkeypatch.setattr(ml, "COUNTS_A_FIT", 4 * train.count())
    fitted, grown = [], ml.joined_forest
    monkeypatch.setattr(ml, "joined_forest", lambda parts: fitted.extend(parts) or grown(parts))
    model = ml.grow_forest(train, 10)
    sizes = [p.stages[-1].getNumTrees for p in fitted]
    assert sizes == [4, 4, 2] and model.stages[-1].getNumTrees == 10 and len(model.stages[-1].trees) == 10
    assert len({t.toDebugString.split("\n", 1)[1] for t in model.stages[-1].trees}) > 5      # seeds of their own
    path = scratch_path(spark, "t-parts")
    model.write().save(path)
    share = lambda m: np.array([r[0] for r in m.transform(data).orderBy("incident_id").select(vector_to_array("probability")).collect()])
    want = sum(n * share(p) for n, p in zip(sizes, fitted, strict=True)) / 10
    assert np.allclose(share(model), want) and np.allclose(share(PipelineModel.load(path)), want)
    weight = sum(n * p.stages[-1].featureImportances.toArray() for n, p in zip(sizes, fitted, strict=True))
    assert np.allclose(model.stages[-1].featureImportances.toArray(), weight / weight.sum())
    assert ml.forest_nodes(model).select("tree").distinct().count() == 10


def _by_hand(rows, weight, cuts, subsets, min_leaf, node=1, depth=3):
    """A tree grown plainly: (node, feature, cut, gain, counts by class) of its nodes."""
    total = [sum(t for _, y, t in rows if y == c) for c in range(len(weight))]
    gini = lambda n: 1 - sum((a * w / max(sum(map(float.__mul__, map(float, n), weight)), 1e-300)) ** 2 for a, w in zip(n, weight))  # noqa: E731, B905
    size = lambda n: sum(a * w for a, w in zip(n, weight))  # noqa: E731, B905
    best = (0.0, -1, 0)
    for f in subsets[node] if node < 1 << depth and sum(n > 0 for n in total) > 1 else []:
        for k, c in enumerate(cuts[f]):
            left = [sum(t for x, y, t in rows if y == j and x[f] <= c) for j in range(len(weight))]
            right = [a - b for a, b in zip(total, left)]  # noqa: B905
            gain = gini(total) - (size(left) * gini(left) + size(right) * gini(right)) / size(total)
            if min(sum(left), sum(right)) >= min_leaf and gain > best[0] + 1e-12:
                best = (gain, f, k)
    gain, f, k = best
    out = {node: (f, float(cuts[f][k]) if f >= 0 else 0.0, total)}
    if f >= 0:
        out |= _by_hand([r for r in rows if r[0][f] <= cuts[f][k]], weight, cuts, subsets, min_leaf, 2 * node, depth)
        out |= _by_hand([r for r in rows if r[0][f] > cuts[f][k]], weight, cuts, subsets, min_leaf, 2 * node + 1, depth)
    return out


def test_binned_trees_against_trees_grown_by_hand(spark, monkeypatch):
    """All trees' splits and counts, with blocks of few rows, a value of many rows, a rare class and more values than bins."""
    import numpy as np

    from tessera.operators import grow
    monkeypatch.setattr(grow, "BLOCK_ROWS", 50)
    kept, unmerged = [], []
    monkeypatch.setattr(grow, "release", lambda blocks: kept.extend(blocks.collect()))
    real = grow.merged
    monkeypatch.setattr(grow, "merged", lambda feature, cut, gain, counts, weight, cuts: unmerged.append((feature.copy(), cut.copy(), counts.copy()))
                        or real(feature, cut, gain, counts, weight, cuts))
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(3)), float(rng.normal()), 7.0 if i % 4 else float(i % 9), float(i % 2)) for i in range(600)]
    rows = [(*x, 2.0 if i % 97 == 0 else float(x[0] + x[1] + rng.normal() > 1)) for i, x in enumerate(rows)]
    feats = ["a", "b", "c", "d"]
    train = spark.createDataFrame(rows, "a double, b double, c double, d double, label double")
    cuts = grow.thresholds(train, feats, 16)
    assert [len(c) for c in cuts][::2] == [2, 8] and 10 <= len(cuts[1]) <= 16 and list(cuts[3]) == [0.5]
    weight = np.array([1.0, 0.5, 20.0])
    nodes = grow.grow_trees(train, feats, cuts, weight, 600, 4, 3, 2, 11)
    assert sum(b["n"] for b in kept) == 600 and len({(b["part"], b["block"]) for b in kept}) == len(kept)
    shape, draws = grow.Shape(4, 3, 0, 2, 3, 11), grow.poisson_table()
    feature, cut, counts = unmerged[0]
    for tree in range(4):
        mine = []
        for b in kept:
            cell = np.frombuffer(b["cells"], dtype="<u2").reshape(4, b["n"])
            times = draws[np.random.Generator(np.random.SFC64([11, tree, b["part"], b["block"]])).integers(0, 1 << 16, b["n"], dtype=np.uint16)]
            # bins as values: cut k parts bins up to k from the others
            mine += [([int(v) // 3 for v in cell[:, i]], int(cell[0, i]) % 3, t) for i, t in enumerate(times) if t]
        assert 400 < sum(t for *_, t in mine) < 800
        want = _by_hand(mine, weight.tolist(), [np.arange(len(c)) for c in cuts], shape.subsets(tree).tolist(), 2)
        assert {n for n in want if want[n][0] >= 0} == set(np.flatnonzero(feature[tree] >= 0))
        for n, (f, c, total) in want.items():
            assert counts[tree, n].tolist() == total and (f < 0 or (feature[tree, n], cut[tree, n]) == (f, c))
    assert set(nodes["tree"]) == {0, 1, 2, 3} and abs(draws.mean() - 1) < 1e-3 and abs((draws == 0).mean() - 0.36788) < 1e-4


def test_binned_forest_is_as_good_as_mllibs(spark, small, monkeypatch):
    """Same rules, other draws: the same rows' probabilities lie close; one model that saves, loads and explains itself."""
    import numpy as np
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from tessera.session import scratch_path
    data, _, _ = ml.prepared_attack_data(spark.table("incidents"))
    share = lambda m: np.array([r[0] for r in m.transform(data).orderBy("incident_id").select(vector_to_array("probability")).collect()])
    theirs = ml.fit_attack_model(data, 60)
    other = ml.fit_attack_model(data, 60, seed=77)
    monkeypatch.setattr(ml, "BINNED_FROM", 1)
    model = ml.fit_attack_model(data, 60)
    assert model.stages[-1].getNumTrees == 60 and model.stages[-1].numClasses == theirs.stages[-1].numClasses
    assert 0.9 < model.stages[-1].totalNumNodes / theirs.stages[-1].totalNumNodes < 1.1
    apart = lambda a, b: np.abs(share(a) - share(b)).mean()
    assert apart(model, theirs) < 1.3 * apart(other, theirs)
    path = scratch_path(spark, "t-binned")
    model.write().save(path)
    assert np.allclose(share(PipelineModel.load(path)), share(model))
    assert abs(model.stages[-1].featureImportances.toArray().sum() - 1) < 1e-9
    # a weight that differs within a class leaves the fit to MLlib
    train = data.filter("is_train").withColumn("weight", F.when(F.col("pos") % 2 == 0, 1.0).otherwise(2.0))
    assert ml.grow_binned(train, train.count(), 2, 1, ml.feature_names(), 40) is None


def test_tree_by_tree_scores_are_transforms(spark, small):
    """Predictions and occlusions against ``transform`` of every variant; two rows of one id are ranked together."""
    from pyspark.ml.functions import vector_to_array
    data, _, _ = ml.prepared_attack_data(spark.table("incidents"))
    model = ml.fit_attack_model(data, 12)
    want = sorted(model.transform(data).select("incident_id", "prediction").collect())
    assert sorted(ml.forest_predictions(model, data, ["incident_id"]).collect()) == want
    feats = ml.feature_names()
    fills = dict(zip(feats, [1.0, 2.0, 0.0, 3.0, 5.0, 1995.0, 1.0, 0.0, 4.0, 9.0], strict=True))
    few = data.orderBy("incident_id").limit(30).withColumn("incident_id", F.when(F.col("incident_id") % 7 == 0, 0).otherwise(F.col("incident_id")))
    few = few.select("incident_id", *feats).localCheckpoint()
    said = {}
    for f in [None, *feats]:
        rows = few.withColumn("no", F.concat_ws("/", *few.columns))
        rows = rows.withColumn(f, F.lit(fills[f])) if f else rows
        said[f] = {r.no: (r.incident_id, r.p, r.prediction) for r in model.transform(rows).select("no", "incident_id", "prediction", vector_to_array("probability").alias("p")).collect()}
    every = {}
    for no, (i, p, best) in said[None].items():
        every.setdefault(i, []).extend((-abs(p[int(best)] - said[f][no][1][int(best)]), f, best, p[int(best)] - said[f][no][1][int(best)]) for f in feats)
    want = {(i, k + 1): x for i, xs in every.items() for k, x in enumerate(sorted(xs)[:3])}
    got = {(r.incident_id, r["rank"]): r for r in ml.occlusion_contributions(model, few, fills).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k].contribution - w[3]) < 1e-12 and got[k].feature == w[1] and got[k].base_prediction == w[2] for k, w in want.items())


def test_trees_read_even_files(spark, small, monkeypatch):
    """Train and test rows are in all files, and not the test rows in the last ones."""
    monkeypatch.setattr(ml, "EVEN_FROM", 100)
    data, _, _ = ml.prepared_attack_data(spark.table("incidents"))
    cores = spark.sparkContext.defaultParallelism
    for df in (data, ml.threat_data(spark.table("incidents"))):
        files = df.groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.count_if(~F.col("is_train")).alias("test")).collect()
        assert len(files) == 2 * cores and max(r.n for r in files) <= min(r.n for r in files) + 2 * cores and sum(r.test > 0 for r in files) > cores


def test_path_contributions_add_up(spark, small):
    """Against a walk by hand over every tree; a saved model explains new rows in one call."""
    import numpy as np

    from tessera.session import scratch_path
    data, dicts, labels = ml.prepared_attack_data(spark.table("incidents"))
    model = ml.fit_attack_model(data, num_trees=7)
    names = ml.feature_names()
    rows = data.filter("not is_train").select("incident_id", *names).orderBy("incident_id").limit(25)
    nodes = {(r.tree, r.node): r for r in ml.forest_nodes(model).collect()}
    p = {r.incident_id: list(r.probability) for r in model.transform(rows).collect()}
    got = {r.incident_id: r for r in ml.path_contributions(model, rows).collect()}
    for r in rows.collect():
        want, base, best = dict.fromkeys(names, 0.0), 0.0, int(np.argmax(p[r.incident_id]))
        for t in range(7):
            n = nodes[t, 0]
            base += n.shares[best] / 7
            while n.left >= 0:
                f = names[n.feature]
                after = nodes[t, n.left if (r[f] <= n.cut[0] if n.categories < 0 else r[f] in n.cut) else n.right]
                want[f] += (after.shares[best] - n.shares[best]) / 7
                n = after
        g = got[r.incident_id]
        assert g.prediction == best and abs(g.base - base) < 1e-9 and abs(g.probability - p[r.incident_id][best]) < 1e-9
        assert all(abs(g.contributions[f] - want[f]) < 1e-9 for f in names) and abs(base + sum(want.values()) - g.probability) < 1e-9
    path = scratch_path(spark, "t-explained")
    split = ml.chronological_split(ml.training_frame(spark.table("incidents")))
    ml.save_model(model, dicts, labels, ml.train_medians(split), path)
    new = split.filter("not is_train").select("incident_id", *ml.CAT_COLS, *ml.NUM_COLS).limit(5)
    out = ml.load_and_explain(spark, path, new).collect()
    assert len(out) == 5 and all(abs(r.base + sum(r.contributions.values()) - r.probability) < 1e-9 and r.predicted_attack for r in out)


def test_listed_categories_go_left():
    import numpy as np
    import pandas as pd
    nodes = pd.DataFrame({"tree": [0, 0, 0], "node": [0, 1, 2], "shares": [[0.5, 0.5], [1.0, 0.0], [0.0, 1.0]], "left": [1, -1, -1], "right": [2, -1, -1],
                          "feature": [0, -1, -1], "cut": [[3.0, 1.0], [], []], "categories": [4, -1, -1]})
    best, base, p, each = ml.Forest(nodes).explain(np.array([[1.0], [2.0], [3.0]]))
    assert best.tolist() == [0, 1, 0] and base.tolist() == [0.5] * 3 and p.tolist() == [1.0] * 3 and each.ravel().tolist() == [0.5] * 3


def test_counts_travel_in_few_bytes():
    import numpy as np

    from tessera.operators import grow
    for top, size in ((0, 1), (255, 1), (256, 2), (65_535, 2), (65_536, 4), (2**32 - 1, 4)):
        counts = np.array([0.0, 3.0, top])
        assert grow.unpacked(grow.packed(counts)).tolist() == counts.tolist() and len(grow.packed(counts)) == 1 + 3 * size


def test_looked_up_nodes_are_those_of_a_walk():
    """Random trees with leaves at all levels, features of one bin and of more bins than a group holds."""
    import numpy as np

    from tessera.operators import grow
    rng = np.random.default_rng(8)
    for bins in ((3, 1, 40, 7, 2, 30), (5000, 2, 90), (1, 1)):
        shape = grow.Shape(len(bins), 3, max(bins) * 3, 2, 6, 1, bins)
        groups = grow.joined(bins)
        assert sorted(f for g in groups for f in g) == list(range(len(bins)))
        bin_of = np.stack([rng.integers(0, b, 400) for b in bins])
        cells = (bin_of * 3 + rng.integers(0, 3, 400)).astype("<u2").ravel()
        feature = np.where(rng.random(64) < 0.85, rng.integers(0, len(bins), 64), -1)
        cut = np.array([rng.integers(0, bins[f]) for f in feature])
        codes = grow.joint_codes(cells, shape, groups)
        for level in range(1, grow.LOOKED + 1):
            node = np.ones(400, dtype=np.int64)
            for _ in range(level):
                f = feature[node]
                node = 2 * node + ((f >= 0) & (bin_of[f, np.arange(400)] > cut[node]))
            bits = np.full(400, 2**64 - 1, dtype=np.uint64)
            for table, code in zip(grow.open_nodes(feature, cut, level, shape, groups), codes, strict=True):
                bits &= table[code]
            assert [int(b).bit_length() - 1 for b in bits] == (node - (1 << level)).tolist() and all(b & (b - 1) == 0 for b in map(int, bits))


def test_only_bins_that_are_there_are_sent(spark):
    """A feature of two bins beside one of 40: the counts that travel have two bins of the first."""
    import numpy as np

    from tessera.operators import grow
    rows = [(float(i % 2), float(i % 40), float(i % 3 == 0)) for i in range(400)]
    train = spark.createDataFrame(rows, "a double, b double, label double")
    shape = grow.Shape(2, 2, 80, 2, 3, 4, (2, 40))
    blocks = grow.write_blocks(train, ["a", "b"], [np.array([0.5]), np.arange(39) + 0.5], 2, 400)
    feature = np.array([[-1, -2, -1, -1, -1, -1, -1, -1]])
    sent = [grow.unpacked(r["counts"]) for r in grow.count_level(blocks, shape, feature, feature * 0, 0).collect()]
    assert {len(c) for c in sent} == {2 * 2 + 40 * 2}
    total = sum(sent)
    assert total[:4].sum() == total[4:].sum() > 300


def test_scored_rows_keep_their_columns(spark, small):
    """Large ids beside a missing one stay as they are; probabilities are those of ``transform``."""
    import numpy as np
    data, _, _ = ml.prepared_attack_data(spark.table("incidents"))
    model = ml.fit_attack_model(data, 9)
    few = data.orderBy("incident_id").limit(40).withColumn("key", F.when(F.col("incident_id") % 5 != 0, F.col("incident_id") + 2**60 + 1)).localCheckpoint()
    order = lambda df: sorted(df.collect(), key=lambda r: (r.key or 0, r.incident_id))
    got = order(ml.forest_predictions(model, few, ["incident_id", "key", "gname"], probability=True))
    want = order(model.transform(few).select("incident_id", "key", "gname", "probability", "prediction"))
    assert any(r.key is None for r in got) and [(r.incident_id, r.key, r.gname, r.prediction) for r in got] == [(r.incident_id, r.key, r.gname, r.prediction) for r in want]
    assert all(np.allclose(a.probability.toArray(), b.probability.toArray(), atol=1e-12) for a, b in zip(got, want, strict=True))


def test_folds_grow_side_by_side(spark, small, monkeypatch):
    """More than one forest is being fitted at a time, and the accuracies are those of folds fitted one by one."""
    import threading
    data, _, _ = ml.prepared_attack_data(spark.table("incidents"))
    real, now, most, lock = ml.grow_forest, [0], [0], threading.Lock()

    def counted(*args):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        try:
            return real(*args)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(ml, "grow_forest", counted)
    got = {r.fold: r.accuracy for r in ml.cross_validate(data, 3, 5).collect()}
    assert most[0] > 1
    monkeypatch.setattr(ml, "FITS_AT_ONCE", 1)
    assert got == {r.fold: r.accuracy for r in ml.cross_validate(data, 3, 5).collect()} and set(got) == {"0", "1", "2", "mean", "std"}


def test_binned_forest_without_arrow(spark, small, monkeypatch):
    """A session that does not exchange tables by Arrow grows the same forest, and neither the split nor the train rows are written again."""
    data, _, _ = ml.prepared_attack_data(spark.table("incidents"))
    monkeypatch.setattr(ml, "BINNED_FROM", 1)
    names, real = [], ml.materialize
    monkeypatch.setattr(ml, "materialize", lambda df, name: names.append(name) or real(df, name))
    told = []
    for arrow in ("true", "false"):
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", arrow)
        try:
            told.append(sorted(map(str, ml.forest_nodes(ml.fit_attack_model(data, 5)).collect())))
        finally:
            spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert told[0] == told[1] and len(told[0]) > 5
    ml.prepared_attack_data(spark.table("incidents"))
    assert not {"split", "attack-train"} & set(names) and "class-weights" in names


def test_leaves_by_lookup_are_those_of_a_walk():
    """Ragged trees deeper and shallower than the lookups; values on the cuts, beyond them and missing."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    for depth in (0, 1, 6, 9):
        rows = []
        for tree in range(6):
            todo, new = [(0, 0)], 1
            while todo:
                node, level = todo.pop()
                inner = level < depth and (tree == 0 or rng.random() < 0.8)
                left = new if inner else -1
                rows.append((tree, node, rng.random(3).tolist(), left, left + 1 if inner else -1, int(rng.integers(4)) if inner else -1,
                             [float(rng.integers(9))] if inner else [], -1))
                if inner:
                    todo += [(new, level + 1), (new + 1, level + 1)]
                    new += 2
        f = ml.Forest(pd.DataFrame(rows, columns=["tree", "node", "shares", "left", "right", "feature", "cut", "categories"]))
        x = rng.integers(-2, 20, (4, 500)) / 2.0
        x[rng.random(x.shape) < 0.05] = np.nan
        for root, (tables, nodes), at in zip(f.root, f.lookups, f.leaves(x), strict=True):
            walked = np.full((500, 1), root)
            for _ in range(f.depth):
                walked = f.step(x.T, walked)
            assert at.tolist() == walked[:, 0].tolist() and not f.inner[at].any()
            assert len(nodes) == 1 << min(f.depth, 6) and len(tables) == len(f.groups)
