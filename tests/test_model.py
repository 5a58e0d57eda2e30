"""Scaler, SVD, search space, registry width and model invariants."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from glosa.functions import registry as reg
from glosa.operators import linalg as la
from glosa.operators.model import c_to_reg_param, check_both_classes
from glosa.operators.tuning import C_HIGH, C_LOW, search_space

from conftest import SF01


@pytest.fixture(scope="module")
def emb(spark):
    return spark.read.parquet(f"{SF01}/embeddings.parquet").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")).cache()


def _matrix(df, col):
    rows = sorted(df.select("vec_id", vector_to_array(col).alias("a")).collect())
    return np.array([r["a"] for r in rows])


def test_population_scaler(emb):
    z = _matrix(la.fit_population_scaler(emb, "v", "z").transform(emb), "z")
    x = _matrix(emb, "v")
    assert np.allclose(z, (x - x.mean(0)) / x.std(0))


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id int, a array<double>")
    df = df.select("vec_id", array_to_vector("a").alias("v"))
    z = _matrix(la.fit_population_scaler(df, "v", "z").transform(df), "z")
    assert np.allclose(z[:, 0], 0)


def test_svd_prefix_and_orthonormal(emb):
    z = la.fit_population_scaler(emb, "v", "z").transform(emb)
    p8 = la.fit_svd(z, "z", "p", 8)
    p3 = la.fit_svd(z, "z", "p", 3)
    pc8 = p8.stages[0].pc.toArray()
    pc3 = p3.stages[0].pc.toArray()
    assert np.allclose(pc8.T @ pc8, np.eye(8), atol=1e-8)
    assert np.allclose(np.abs(pc8[:, :3]), np.abs(pc3), atol=1e-6)
    ev = p8.stages[0].explainedVariance.toArray()
    assert all(ev[i] >= ev[i + 1] - 1e-12 for i in range(7))


def test_gram_matches_numpy(emb, spark):
    z = la.fit_population_scaler(emb, "v", "z").transform(emb).select(vector_to_array("z").alias("z"))
    g = {(r.i, r.j): r.value for r in la.gram(z, "z", 64).collect()}
    x = np.array([r[0] for r in z.collect()])
    want = x.T @ x / len(x)
    assert max(abs(g[(i, j)] - want[i, j]) for i in range(64) for j in range(64)) < 1e-9


def test_search_space_seeded_and_in_range():
    a, b = search_space(20, 868, 42), search_space(20, 868, 42)
    assert a == b
    assert all(1 <= t.k <= 867 and C_LOW <= t.c <= C_HIGH for t in a)
    assert search_space(5, 1, 0)[0].k == 1


def test_reg_param_map():
    assert c_to_reg_param(1.0, 100) == pytest.approx(0.01)


def test_single_class_raises(spark):
    df = spark.createDataFrame([(1, 0, 1), (0, 0, 0)], "Sub1_Toxic int, Sub2_Engaging int, Sub3_FactClaiming int")
    with pytest.raises(ValueError, match="single class"):
        check_both_classes(df)


def test_all_features_width_is_898():
    names = ["DocumentEmbeddingsBERT", "WritingStyleEmbeddings", "SentimentBERT", "SpellingMistakes",
             "WordLengthStandardDeviation", "AverageWordLength", "NumWords", "NumCharacters", "StopwordRatio",
             "ExclamationMarkRatio", "NumReferences", "NumMediumAdressed", "NumUserAdressed",
             "AverageEmojiRepetition"]
    lay = reg.layout_of(names, reg.FeatureAssets())
    assert len(lay.names) == 898
    assert lay.kinds.count("numerical") == 30 and lay.kinds.count("embedding") == 868
    assert lay.names[871:888] == reg.iss.SLOT_NAMES  # after 768 + 100 + 3


def test_unknown_feature_raises():
    with pytest.raises(KeyError):
        reg.resolve(["NumWords", "NoSuchFeature"])


def test_feature_hash_changes_with_list():
    a = reg.feature_set_hash(["NumWords"], reg.FeatureAssets())
    assert a != reg.feature_set_hash(["NumWords", "NumCharacters"], reg.FeatureAssets())


def test_trainable_feature_hook(spark):
    """A user feature backed by a Spark ML estimator is fitted on the
    training text only and its model is reused for other rows; fitting a
    non-trainable feature raises."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler

    from glosa.sources.comments import comments

    from conftest import SF001

    def est(assets, text_col, out):
        return Pipeline(stages=[
            SQLTransformer(statement=f"SELECT *, CAST(size(split({text_col}, ' ')) AS DOUBLE) AS _nw FROM __THIS__"),
            VectorAssembler(inputCols=["_nw"], outputCol="_nwv"),
            StandardScaler(withMean=True, withStd=False, inputCol="_nwv", outputCol=out)])

    spec = reg.FeatureSpec("CentredWordCount", reg.NUMERICAL, lambda a: 1, trainable=True, estimator=est)
    reg.register_feature(spec)
    try:
        c = comments(spark, SF001)
        train, other = c.where("comment_id % 2 = 0"), c.where("comment_id % 2 = 1")
        assets = reg.FeatureAssets()
        with pytest.raises(ValueError, match="not fitted"):
            reg.build_features(other, ["CentredWordCount"], assets)
        f_train, layout = reg.build_features(train, ["NumWords", "CentredWordCount"], assets, fit_rows=train)
        assert layout.numerical == ["f_NumWords", "f_CentredWordCount"]
        assert abs(f_train.agg(F.avg("f_CentredWordCount")).first()[0]) < 1e-9  # centred on the fit rows
        f_other, _ = reg.build_features(other, ["CentredWordCount"], assets)  # reuses the fitted model
        assert f_other.count() == other.count()
        with pytest.raises(ValueError, match="not trainable"):
            reg.fit_feature(reg.REGISTRY["NumWords"], train, assets)
    finally:
        reg.REGISTRY.pop("CentredWordCount", None)


def test_fixed_fit_defaults_to_all_components(spark):
    """M4 defaults: k = every embedding component, C = 1.0; predictions are 0/1."""
    from glosa.operators.tuning import fit_model
    from glosa.plans.flagship import flagship_inputs
    from glosa.plans.pipeline import RunConfig

    from conftest import SF001

    train, _, assets = flagship_inputs(spark, SF001)
    feats, layout = reg.build_features(train, ["NumWords", "NumCharacters", "DocumentEmbeddingsBERT"], assets)
    data = reg.assemble(feats, layout)
    m = fit_model(data, layout)
    emb_dim = sum(d for _, d in layout.embeddings)
    assert m.k == emb_dim and m.c == 1.0 and len(m.regressions) == 3
    # Two numbers, the presence column of the vectors, and the vectors.
    assert layout.numerical[2:] == ["f_has_DocumentEmbeddingsBERT"]
    assert all(len(c) == 3 + emb_dim for c in m.coefficients())
    out = m.predict(data.select("comment_id", "num", "emb"))
    assert out.where(" OR ".join(f"pred_{i} NOT IN (0, 1)" for i in range(3))).count() == 0
    with pytest.raises(ValueError):
        RunConfig(name="x", features=["NumWords"], num_trials=0)
