import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.operators import forests, metrics, models, repeat_features
from arrayloom.plans import models as plans

rng = random.Random(4)
CORES = {"I-A": "GTTTCAATCCACGCGCCCACGGAGG", "I-B": "CTTTAAATAGAAAGTTAATATAATA", "II-A": "GGGCGCGGCCGCCCGGCGCGCGAGC"}


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for i in range(90):
        label = list(CORES)[i % 3]
        s = list(CORES[label])
        s[rng.randrange(25)] = rng.choice("ACGT")
        out.append((i, "train" if i < 60 else "test", "".join(s), label, 5, f"array {i}"))
    return spark.createDataFrame(out, "row_id bigint, split string, repeat_sequence string, cas_subtype string, spacer_count int, array_key string")


@pytest.fixture(scope="module")
def vectors(rows):
    v = models.repeat_vectors(rows, "repeat_sequence", "cas_subtype", "spacer_count", 32).select("row_id", "split", "label", "features").cache()
    return v.filter("split = 'train'").drop("split"), v.filter("split = 'test'").drop("split")


def test_trees_and_rounds_of_the_reference(spark):
    assert plans.TREES == 400
    assert models.classifier("logistic").getMaxIter() == 1000
    assert models.classifier("svm").getClassifier().getMaxIter() == 5000


@pytest.mark.parametrize("method", ["forest", "logistic", "svm", "bayes", "boosting"])
def test_methods_tell_clear_classes(vectors, method):
    got = metrics.overall(models.predict(*vectors, method, 5)).first()
    assert got.rows == 30 and got.accuracy > 0.7  # chance: 0.33


def test_weights_leave_rows_to_all_tasks(spark):
    rows = spark.range(800, numPartitions=8).select((F.col("id") % 10 < 2).cast("string").alias("label"))
    with_few = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = models.balanced_weights(rows).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_few)
    assert {r.part for r in got} == set(range(8))
    assert {(r.label, r.weight) for r in got} == {("true", 800 / 320), ("false", 800 / 1280)} and len(got) == 800


def test_neighbour_features_are_appended(rows, vectors):
    refs = rows.filter("split = 'train'").select(F.col("row_id").alias("ref_id"), F.col("repeat_sequence").alias("text"), F.col("cas_subtype").alias("label"), "array_key")
    asks = rows.select("row_id", F.col("repeat_sequence").alias("text"), "array_key").filter("row_id <> 61")
    both = {r.row_id: r.features.toArray() for v in vectors for r in models.with_neighbours(v, asks, refs).collect()}
    plain = {r.row_id: r.features.toArray() for v in vectors for r in v.collect()}
    texts = {r.row_id: r.repeat_sequence for r in rows.collect()}
    assert both.keys() == plain.keys()
    for k, x in both.items():
        assert list(x[:-6]) == list(plain[k])
        like = sorted((sum(a == b for a, b in zip(texts[k], texts[r])) / 25 for r in range(60) if r != k), reverse=True)
        want = [0, 0, 0, 0] if k == 61 else [like[0], like[1], like[0] - like[1], sum(y >= 0.9 for y in like)]
        assert list(x[-6:-2]) == pytest.approx(want)
    train, test = (models.with_neighbours(v, asks, refs) for v in vectors)
    assert metrics.overall(models.predict(train, test, "forest", 5)).first().accuracy > 0.9


def test_external_rows_of_unknown_labels_are_left_out(vectors):
    train, test = vectors[0].filter("label <> 'II-A'"), vectors[1]
    assert {r.true_label for r in models.predict_external(train, test, trees=5).collect()} == {"I-A", "I-B"}
    assert [tuple(r) for r in models.excluded_labels(train, test).collect()] == [("II-A", 10)]


def test_permutation_deals_every_value_once(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(50)], "row_id bigint, x bigint")
    got = models.permutation_drop(df, lambda d: d.collect(), "x")
    assert sorted(r.row_id for r in got) == list(range(50))
    assert sorted(r.x for r in got) == [i * 10 for i in range(50)]
    assert any(r.x != r.row_id * 10 for r in got)


def test_forest_of_all_trees_takes_few_jobs(spark, vectors):
    spark.sparkContext.setJobGroup("forest", "all trees")
    got = metrics.overall(models.predict(*vectors, "forest", plans.TREES)).first()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("forest")
    spark.sparkContext.setJobGroup("", "")
    assert got.rows == 30 and got.accuracy > 0.9
    assert len(jobs) < 15  # one job for all trees, not one for each few hundred nodes


def test_forest_does_not_depend_on_where_rows_lie(vectors):
    train, test = vectors
    one, other = (sorted(models.predict(t, test, "forest", 7).collect()) for t in (train.coalesce(1), train.repartition(5)))
    assert one == other and len(one) == 30


def test_packed_bins_are_read_back_and_the_best_split_is_found():
    values = np.random.default_rng(3)
    x = np.stack([values.integers(0, n, 400).astype(float) for n in (1, 3, 4, 5, 16, 17, 32, 33, 400, 2, 20)], axis=1)
    ends = [forests.limits(c) for c in x.T]
    bins, where = forests.binned(x, ends), forests.layout(ends)
    assert bins.max() == 31 and [len(e) for e in ends[:7]] == [len(np.unique(c)) - 1 for c in x.T[:7]]
    store, some = forests.packed(bins, where), np.arange(0, 400, 3)
    for f in range(len(bins)):
        assert (bins[f] == [(x[i, f] > ends[f]).sum() for i in range(400)]).all()
        assert (forests.unpacked(store, where, f, some) == bins[f][some]).all()
    y, weight = values.integers(0, 3, 400), values.random(400)

    def impurity(at):
        per = np.bincount(y[at], weight[at], 3)
        return per.sum() - (per**2).sum() / max(per.sum(), 1e-9)

    splits = {(f, b): impurity(bins[f] <= b) + impurity(bins[f] > b) for f in range(len(bins)) for b in range(31) if 0 < (bins[f] <= b).sum() < 400}
    tree = forests.grow(store, where, np.arange(400), y, weight, 3, 1, values, len(bins))
    f, b = int(tree["feature"][0]), int(tree["last"][0])
    assert splits[f, b] == pytest.approx(min(splits.values()))
    leaf = np.where(bins[f] > b, 2, 1)
    for k in (1, 2):
        per = np.bincount(y[leaf == k], weight[leaf == k], 3)
        assert tree["share"][tree["leaf"] == k] == pytest.approx(per / per.sum())
    got = forests.shares([tree], np.ascontiguousarray(bins.T), 3, 1)
    assert got[leaf == 2][0] == pytest.approx(tree["share"][tree["leaf"] == 2])


def test_hierarchy_grows_all_models_in_one_job(spark, vectors):
    from arrayloom.operators import training

    spark.sparkContext.setJobGroup("hierarchy", "all models")
    got = models.predict_hierarchical(*vectors, training.cas_type, "forest", 20).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("hierarchy")
    spark.sparkContext.setJobGroup("", "")
    assert len(got) == 30 and sum(r.correct for r in got) > 27 and len(jobs) < 15
    assert {r.confidence for r in got if r.predicted_label == "II-A"} == {1.0}  # its type has no other


def test_batches_of_features_equal_vectors(spark):
    odd = [(0, "", 0, None), (1, None, 3, 1.5), (2, "ACG", 1, float("nan")), (3, "acgtnACGTTT", 1, 33.3), (4, "NNNN", 1, 2.0), (5, "ACGTACG", None, 2.0), (6, "ACGTNACGT", 2, 2.25)]
    odd += [(7 + i, "".join(rng.choice("ACGTN") for _ in range(23 + i % 25)), i, i / 7) for i in range(60)] + [(67, "A" * 14 + "T" * 14, 1, 30.0)]
    df = spark.createDataFrame(odd, "row_id int, repeat_sequence string, spacer_count int, mean_spacer_length double")
    want = [r.features.toArray() for r in repeat_features.feature_vectors(df).orderBy("row_id").collect()]
    given = df.orderBy("row_id").select(repeat_features.as_given().alias("x")).toArrow().column(0).combine_chunks()
    assert (repeat_features.matrix(given) == np.array(want)).all()
