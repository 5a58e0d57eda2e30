"""Document vectors and class scores (G3, G4): attach or batch-score.

(a) Pre-computed vectors join on the id (both sides unique per id — no
skew); (b) a user-supplied model runs through ``predict_batch_udf``: Arrow
batches, the model loaded once per Python worker, never one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosa.columns import COMMENT_ID, TEXT
from glosa.functions.text import clean_text


def attach_vectors(df: DataFrame, vectors: DataFrame, out: str, id_col: str = COMMENT_ID) -> DataFrame:
    """G3(a): left join ``vectors(id, vector)``; rows without a vector get null."""
    v = vectors.select(F.col(id_col), F.col("vector").cast("array<double>").alias(out))
    return df.join(v, id_col, "left")


def batch_scorer(make_predict_fn: Callable, dim: int, batch_size: int = 256,
                 input_shape: list[int] | None = None) -> Callable[..., Column]:
    """G3(b)/G4: wrap ``make_predict_fn() -> (np.ndarray batch -> np.ndarray [batch, dim])``
    as a batched column function returning ``array<double>``."""
    from pyspark.ml.functions import predict_batch_udf
    return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                             input_tensor_shapes=[input_shape] if input_shape else None)


MODEL_INPUT_TOKENS = 512


def model_input_chunks(cleaned: Column, max_tokens: int = MODEL_INPUT_TOKENS) -> Column:
    """The cleaned text cut into the model's input windows of ``max_tokens``
    tokens, all of it; a text without tokens is one empty chunk."""
    toks = F.filter(F.split(F.coalesce(cleaned, F.lit("")), " "), lambda x: x != F.lit(""))
    # Bound to a lambda variable, so that the text is split once and not once a chunk.
    return F.flatten(F.transform(F.array(toks), lambda t: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(t) - 1) / F.lit(max_tokens)), F.lit(0)).cast("int")),
        lambda i: F.array_join(F.slice(t, i * max_tokens + 1, max_tokens), " "))))


def chunk_scores(df: DataFrame, score: Callable[[Column], Column], dim: int, text_col: str = TEXT,
                 id_col: str = COMMENT_ID, max_tokens: int = MODEL_INPUT_TOKENS) -> DataFrame:
    """Class scores of each distinct (id, text): id, text key and ``scores``, the mean of
    the scores of its chunks weighted by their tokens (a text without tokens: its empty chunk's).

    ``score`` maps a text column to ``array<double>`` of ``dim`` (a ``batch_scorer``, or any
    column function); chunks go through it in batches, whatever text they are of."""
    from glosa.operators.lookups import TEXT_KEY, text_key
    keys = [id_col, *TEXT_KEY]
    rows = df.select(id_col, *text_key(F.col(text_col)), F.explode(model_input_chunks(clean_text(F.col(text_col)), max_tokens)).alias("_chunk"))
    words = F.when(F.col("_chunk") == "", 0).otherwise(F.size(F.split("_chunk", " ")))
    rows = rows.select(*keys, F.greatest(words, F.lit(1)).cast("double").alias("_w"), score(F.col("_chunk")).alias("_s"))
    sums = rows.groupBy(*keys).agg(F.sum("_w").alias("_t"), *[F.sum(F.col("_s")[i] * F.col("_w")).alias(f"_s{i}") for i in range(dim)])
    return sums.select(*keys, F.array(*[F.col(f"_s{i}") / F.col("_t") for i in range(dim)]).alias("scores"))


def _projection(w, x):
    return x.astype("float64") @ w


def seeded_projection(dim_in: int, dim_out: int, seed: int = 7):
    """``make_predict_fn`` for a fixed seeded linear map — a stand-in model for
    tests and checks (real deployments pass their own loader)."""
    def make():
        import functools

        import numpy as np
        w = np.random.default_rng(seed).standard_normal((dim_in, dim_out))
        return functools.partial(_projection, w)
    return make


CLASS_SEED = 3


def _text_classes(w, texts):
    import numpy as np
    out = []
    for t in texts:
        t = "" if t is None else t
        x = np.array([len(t), t.count(" "), t.count("e"), t.count("n")], float) / 100.0
        out.append(x @ w)
    return np.stack(out) if out else np.zeros((0, w.shape[1]))


def class_weights(dim: int = 3, seed: int = CLASS_SEED):
    """Seeded weights of the stand-in text classifier on its four measures, to four places."""
    import numpy as np
    return np.random.default_rng(seed).standard_normal((4, dim)).round(4)


def seeded_text_classifier(dim: int = 3, seed: int = CLASS_SEED):
    """``make_predict_fn`` of a stand-in for the sentiment model: scores linear in a chunk's
    characters, blanks, "e"s and "n"s (each a hundredth), with seeded weights."""
    def make():
        import functools
        return functools.partial(_text_classes, class_weights(dim, seed))
    return make
