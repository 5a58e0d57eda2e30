"""Feature registry (U1, U2, S8, P6, P7): name → kind, width, builder.

Names are the feature class names used in run configs. Row-local features
are column expressions and land in one ``select``; table-backed features
(lexicon polarity, pooled word vectors, document vectors) are keyed joins on
the comment id. An unknown name raises instead of being skipped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Any
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.columns import COMMENT_ID, FOLD, LABELS, TEXT
from glosa.functions import text as tx
from glosa.operators import issues as iss

NUMERICAL, EMBEDDING = "numerical", "embedding"


@dataclass
class FeatureAssets:
    """Tables and models the table-backed features need (all optional)."""
    stopwords: Sequence[str] | None = None
    issue_rules: Sequence[iss.IssueRule] = tuple(iss.DEFAULT_RULES)
    word_vectors: DataFrame | None = None  # (token, vector array<double>)
    word_vector_dim: int = 300
    polarity: DataFrame | None = None  # (token, polarity)
    doc_vectors: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)  # name → ((id, vector), dim)
    scorers: dict[str, tuple[Callable[[Column], Column], int]] = field(default_factory=dict)  # name → (fn, dim)
    style: Any = None  # operators.style.StyleModel of WritingStyleEmbeddings
    fitted: dict[str, Any] = field(default_factory=dict)  # U2: name → fitted ML model of a trainable feature


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    kind: str
    dim: Callable[[FeatureAssets], int]
    # Row-local: text column → list of columns. Table-backed: (df, assets) → (df, new column names).
    columns: Callable[[Column, FeatureAssets], list[Column]] | None = None
    attach: Callable[[DataFrame, FeatureAssets, str], tuple[DataFrame, list[str]]] | None = None
    names: Callable[[FeatureAssets], list[str]] | None = None
    # Table-backed by the text alone: (id and text rows, assets, id column) → (results by id and text key, new column names).
    by_text: Callable[[DataFrame, FeatureAssets, str], tuple[DataFrame, list[str]]] | None = None
    trainable: bool = False
    # (assets, input column, output column) → a Spark ML Estimator fitted on
    # the training text; its output column is a double, an ML vector or an array.
    estimator: Callable[[FeatureAssets, str, str], Any] | None = None

    def feature_names(self, assets: FeatureAssets) -> list[str]:
        return self.names(assets) if self.names else [self.name] * self.dim(assets)


def _scalar(name: str, fn: Callable[[Column], Column]) -> FeatureSpec:
    return FeatureSpec(name, NUMERICAL, lambda a: 1, columns=lambda t, a: [fn(t).alias(f"f_{name}")])


def _stop(t: Column, a: FeatureAssets) -> list[Column]:
    return [tx.stopword_ratio(t, a.stopwords).alias("f_StopwordRatio")]


def _issues(t: Column, a: FeatureAssets) -> list[Column]:
    return iss.issue_columns(t, a.issue_rules)


def _polarity(df: DataFrame, a: FeatureAssets, id_col: str) -> tuple[DataFrame, list[str]]:
    from glosa.operators.lookups import token_lookup_results
    if a.polarity is None:
        raise ValueError("SentimentTextBlob needs a polarity table (token, polarity)")
    return token_lookup_results(df, lexicon=a.polarity, id_col=id_col, polarity_out="f_SentimentTextBlob"), ["f_SentimentTextBlob"]


def _pooled(df: DataFrame, a: FeatureAssets, id_col: str) -> tuple[DataFrame, list[str]]:
    from glosa.operators.lookups import token_lookup_results
    if a.word_vectors is None:
        raise ValueError("DocumentEmbeddingsFastTextPool needs a word-vector table (token, vector)")
    out = "e_DocumentEmbeddingsFastTextPool"
    return token_lookup_results(df, word_vectors=a.word_vectors, dim=a.word_vector_dim, id_col=id_col, pooled_out=out), [out]


def _doc_vector(name: str):
    def attach(df: DataFrame, a: FeatureAssets, id_col: str) -> tuple[DataFrame, list[str]]:
        out = f"e_{name}"
        if name in a.doc_vectors:
            # A comment without a vector keeps its row: zeros, and 0 in the presence column.
            vecs, dim = a.doc_vectors[name]
            v = vecs.select(F.col(id_col), F.col("vector").cast("array<double>").alias(out))
            joined = df.join(v, id_col, "left").withColumn(
                f"f_has_{name}", F.when(F.col(out).isNotNull(), 1.0).otherwise(0.0))
            return joined.withColumn(out, F.coalesce(out, F.array_repeat(F.lit(0.0), dim))), [out]
        if name in a.scorers:
            fn, _ = a.scorers[name]
            return df.withColumn(out, fn(F.col(TEXT))), [out]
        raise ValueError(f"{name} needs a document-vector table or a scorer")
    return attach


def _doc_dim(name: str, default: int):
    def dim(a: FeatureAssets) -> int:
        if name in a.doc_vectors:
            return a.doc_vectors[name][1]
        if name in a.scorers:
            return a.scorers[name][1]
        return default
    return dim


def _sentiment_bert(df: DataFrame, a: FeatureAssets, id_col: str) -> tuple[DataFrame, list[str]]:
    """Class scores of the whole cleaned text: those of its model-sized chunks, weighted by their tokens."""
    from glosa.operators.scoring import chunk_scores
    if "SentimentBERT" not in a.scorers:
        raise ValueError("SentimentBERT needs a scorer (cleaned-text model)")
    fn, dim = a.scorers["SentimentBERT"]
    cols = [f"f_SentimentBERT_{i}" for i in range(dim)]
    scores = chunk_scores(df, fn, dim, id_col=id_col)
    return scores.select(*[c for c in scores.columns if c != "scores"], *[F.col("scores")[i].alias(c) for i, c in enumerate(cols)]), cols


def _writing_style(df: DataFrame, a: FeatureAssets, id_col: str) -> tuple[DataFrame, list[str]]:
    """Document vectors of a style model over all windows of the text."""
    from glosa.operators.style import style_vectors
    out = "e_WritingStyleEmbeddings"
    return style_vectors(df, a.style, out=out, id_col=id_col), [out]


def _style_dim(a: FeatureAssets) -> int:
    return a.style.dim if a.style is not None else _doc_dim("WritingStyleEmbeddings", 100)(a)


REGISTRY: dict[str, FeatureSpec] = {s.name: s for s in [
    _scalar("NumCharacters", tx.num_characters),
    _scalar("NumWords", tx.num_words),
    _scalar("AverageWordLength", tx.average_word_length),
    _scalar("WordLengthStandardDeviation", tx.word_length_std),
    FeatureSpec("StopwordRatio", NUMERICAL, lambda a: 1, columns=_stop),
    _scalar("ExclamationMarkRatio", tx.exclamation_ratio),
    _scalar("NumReferences", tx.num_references),
    _scalar("NumUserAdressed", tx.num_user_addressed),
    _scalar("NumMediumAdressed", tx.num_medium_addressed),
    _scalar("AverageEmojiRepetition", tx.average_emoji_repetition),
    FeatureSpec("SpellingMistakes", NUMERICAL, lambda a: len(iss.SLOT_NAMES), columns=_issues,
                names=lambda a: list(iss.SLOT_NAMES)),
    FeatureSpec("SentimentTextBlob", NUMERICAL, lambda a: 1, by_text=_polarity),
    FeatureSpec("SentimentBERT", NUMERICAL, lambda a: a.scorers.get("SentimentBERT", (None, 3))[1],
                by_text=_sentiment_bert),
    FeatureSpec("DocumentEmbeddingsFastTextPool", EMBEDDING, lambda a: a.word_vector_dim, by_text=_pooled),
    FeatureSpec("DocumentEmbeddingsBERT", EMBEDDING, _doc_dim("DocumentEmbeddingsBERT", 768),
                attach=_doc_vector("DocumentEmbeddingsBERT")),
    # Without a style model a table or text scorer, as for other vectors.
    FeatureSpec("WritingStyleEmbeddings", EMBEDDING, _style_dim, attach=_doc_vector("WritingStyleEmbeddings"), by_text=_writing_style),
]}


_BUILT_IN = dict(REGISTRY)


def _by_text(s: FeatureSpec, a: FeatureAssets) -> bool:
    return s.by_text is not None and (s.attach is None or a.style is not None)


# Table-backed features that aggregate over the comment's tokens; requested
# together, they share one token pass (see ``token_lookup_results``).
TOKEN_LOOKUP_FEATURES = {"SentimentTextBlob": "f_SentimentTextBlob",
                         "DocumentEmbeddingsFastTextPool": "e_DocumentEmbeddingsFastTextPool"}


def _token_lookups(df: DataFrame, a: FeatureAssets, id_col: str) -> DataFrame:
    from glosa.operators.lookups import token_lookup_results
    if a.polarity is None or a.word_vectors is None:
        raise ValueError("SentimentTextBlob and DocumentEmbeddingsFastTextPool need a polarity table and a "
                         "word-vector table")
    return token_lookup_results(df, word_vectors=a.word_vectors, dim=a.word_vector_dim, lexicon=a.polarity, id_col=id_col,
                                pooled_out=TOKEN_LOOKUP_FEATURES["DocumentEmbeddingsFastTextPool"],
                                polarity_out=TOKEN_LOOKUP_FEATURES["SentimentTextBlob"])


def output_column(spec: FeatureSpec) -> str:
    return f"{'f' if spec.kind == NUMERICAL else 'e'}_{spec.name}"


def fit_feature(spec: FeatureSpec, rows: DataFrame, assets: FeatureAssets):
    """Fit a trainable feature on the training text and keep the model in
    ``assets.fitted`` (test rows and later batches reuse it)."""
    if not spec.trainable or spec.estimator is None:
        raise ValueError(f"{spec.name} is not trainable")
    model = spec.estimator(assets, TEXT, output_column(spec)).fit(rows.select(TEXT))
    assets.fitted[spec.name] = model
    return model


def _apply_fitted(df: DataFrame, spec: FeatureSpec, assets: FeatureAssets) -> tuple[DataFrame, list[str]]:
    out = output_column(spec)
    res = assets.fitted[spec.name].transform(df)
    is_vec = isinstance(res.schema[out].dataType, VectorUDT)
    col = vector_to_array(F.col(out)) if is_vec else F.col(out)
    if spec.kind == NUMERICAL:
        d = spec.dim(assets)
        names = [out] if d == 1 else [f"{out}_{i}" for i in range(d)]
        if is_vec or d > 1:
            cols = [col[i].cast("double").alias(n) for i, n in enumerate(names)]
        else:
            cols = [col.cast("double").alias(out)]
    else:
        names, cols = [out], [col.cast("array<double>").alias(out)]
    return res.select(*df.columns, *cols), names


def register_feature(spec: FeatureSpec) -> None:
    """Add a user feature under its config name."""
    REGISTRY[spec.name] = spec


def resolve(names: Sequence[str]) -> list[FeatureSpec]:
    """Config names → specs; an unknown name is an error (not a skip)."""
    missing = [n for n in names if n not in REGISTRY]
    if missing:
        raise KeyError(f"unknown features: {missing}")
    return [REGISTRY[n] for n in names]


@dataclass
class FeatureLayout:
    """Column order, kinds, widths and per-dimension names."""
    numerical: list[str]
    embeddings: list[tuple[str, int]]
    names: list[str]
    kinds: list[str]
    presence: list[str] = field(default_factory=list)  # the last columns of ``numerical``

    @property
    def width(self) -> int:
        return len(self.numerical) + sum(d for _, d in self.embeddings)

    @property
    def numerical_names(self) -> list[str]:
        return [n for n, k in zip(self.names, self.kinds) if k == NUMERICAL]


def layout_of(names: Sequence[str], assets: FeatureAssets) -> FeatureLayout:
    num, emb, fnames, kinds = [], [], [], []
    for spec in resolve(names):
        d = spec.dim(assets)
        fnames += spec.feature_names(assets)
        kinds += [spec.kind] * d
    return FeatureLayout(num, emb, fnames, kinds)


def asset_tables(assets: FeatureAssets) -> dict[str, DataFrame]:
    """The tables behind table-backed features."""
    named = {"word_vectors": assets.word_vectors, "polarity": assets.polarity}
    named |= {f"doc_vectors:{n}": df for n, (df, _) in assets.doc_vectors.items()}
    return {n: df for n, df in named.items() if df is not None}


def feature_set_hash(names: Sequence[str], assets: FeatureAssets, inputs: dict[str, str] | None = None) -> str:
    """Cache key of a feature list (S4): the list, the parameters of its assets and
    the fingerprints of the tables it reads (``inputs``)."""
    key = {"names": list(names), "stop": list(assets.stopwords or tx.DEFAULT_STOPWORDS),
           "rules": [(r.rule_id, r.category, r.pattern) for r in assets.issue_rules],
           "wv_dim": assets.word_vector_dim, "doc_dims": {n: d for n, (_, d) in assets.doc_vectors.items()},
           "scorers": sorted(assets.scorers), "style": assets.style.key() if assets.style is not None else None, "fitted": {n: getattr(m, "uid", "") for n, m in assets.fitted.items()},
           "inputs": inputs or {}}
    return hashlib.sha1(json.dumps(key, sort_keys=True).encode()).hexdigest()[:16]


def build_features(df: DataFrame, names: Sequence[str], assets: FeatureAssets | None = None,
                   id_col: str = COMMENT_ID, keep: Sequence[str] = (*LABELS, FOLD),
                   fit_rows: DataFrame | None = None) -> tuple[DataFrame, FeatureLayout]:
    """One projection for row-local features, keyed joins for the rest.

    What follows from the text alone is computed from ``df`` and joined by id and text key,
    so that no feature's plan holds another's; the text itself moves only where a feature
    of its own needs it in the joined row.
    Returns the feature table (id, kept label/fold columns, numerical double
    columns in config order, embedding ``array<double>`` columns) and its layout.
    Trainable features (U2) use their model in ``assets.fitted`` or are fitted
    on ``fit_rows`` (the training text) first.
    """
    assets = assets or FeatureAssets()
    specs = resolve(names)
    text = F.col(TEXT)
    kept = [c for c in keep if c in df.columns]
    col_of: dict[str, list[str]] = {}
    row_cols: list[Column] = []
    # A text is split once for all features of its words.
    numbers = F.col("_words")
    words = tx.from_word_numbers(numbers) if any(s is _BUILT_IN.get(s.name) for s in specs) else {}
    for s in specs:
        if s.columns is not None:
            made, own = s.columns(text, assets), s is _BUILT_IN.get(s.name)
            col_of[s.name] = df.select(*made).columns
            if own and s.name in words:
                made = [words[s.name].alias(f"f_{s.name}")]
            elif own and s.name == "SpellingMistakes":
                made = iss.issue_columns(text, assets.issue_rules, words=numbers["n"])
            row_cols += made
    from glosa.operators.lookups import TEXT_KEY, join_by_key, text_key
    base = df.select(id_col, TEXT, *kept, *text_key(text))
    if any(s is _BUILT_IN.get(s.name) and s.name in (*words, "SpellingMistakes") for s in specs):
        from glosa.operators.words import word_numbers
        stop = tx.DEFAULT_STOPWORDS if assets.stopwords is None else assets.stopwords
        base = base.withColumn("_words", word_numbers(text, stop, tx.USER_TOKEN, tx.MEDIUM_TOKEN))
    reads_text = any(s.trainable or (s.attach is not None and not _by_text(s, assets) and s.name not in assets.doc_vectors) for s in specs)
    out = base.select(id_col, *([TEXT] if reads_text else []), *kept, *TEXT_KEY, *row_cols)
    fused = [s.name for s in specs if s.name in TOKEN_LOOKUP_FEATURES and s is _BUILT_IN[s.name]]
    if len(fused) > 1:
        out = join_by_key(out, _token_lookups(df.select(id_col, TEXT), assets, id_col), id_col)
        col_of.update({n: [TOKEN_LOOKUP_FEATURES[n]] for n in fused})
    for s in specs:
        if s.trainable:
            if s.name not in assets.fitted:
                if fit_rows is None:
                    raise ValueError(f"{s.name} is trainable and not fitted; pass the training rows")
                fit_feature(s, fit_rows, assets)
            out, cols = _apply_fitted(out, s, assets)
            col_of[s.name] = cols
        elif _by_text(s, assets) and s.name not in col_of:
            found, cols = s.by_text(df.select(id_col, TEXT), assets, id_col)
            out = join_by_key(out, found, id_col)
            col_of[s.name] = cols
        elif s.attach is not None and s.name not in col_of:
            out, cols = s.attach(out, assets, id_col)
            col_of[s.name] = cols
    # Each spec's own columns, in config order; their number must be what the spec says.
    layout = layout_of(names, assets)
    for s in specs:
        cols, dim = col_of[s.name], s.dim(assets)
        if len(cols) != (dim if s.kind == NUMERICAL else 1) or len(s.feature_names(assets)) != dim:
            raise ValueError(f"{s.name} declares {dim} dimensions but gives columns {cols} and "
                             f"{len(s.feature_names(assets))} names")
        if s.kind == NUMERICAL:
            layout.numerical += cols
        else:
            layout.embeddings.append((cols[0], dim))
        if f"f_has_{s.name}" in out.columns:
            layout.presence.append(f"f_has_{s.name}")
    layout.numerical += layout.presence
    layout.names += [c.removeprefix("f_") for c in layout.presence]
    layout.kinds += [NUMERICAL] * len(layout.presence)
    return out.select(id_col, *kept, *layout.numerical, *[c for c, _ in layout.embeddings]), layout


def assemble(df: DataFrame, layout: FeatureLayout, num_out: str = "num", emb_out: str = "emb") -> DataFrame:
    """P4/P5 inputs: the numerical block and the concatenated embedding block as ML
    vectors. Every row stays: a missing number becomes 0, a missing embedding
    zeros (count such rows with ``incomplete_rows``). Both vectors carry the
    features' names as ML attributes (P7)."""
    out = df
    if layout.numerical:
        filled = df.select("*", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_n_{i}")
                                  for i, c in enumerate(layout.numerical)])
        cols = [f"_n_{i}" for i in range(len(layout.numerical))]
        out = VectorAssembler(inputCols=cols, outputCol=num_out).transform(filled).drop(*cols)
        out = out.withMetadata(num_out, _attributes(layout.numerical_names))
    if layout.embeddings:
        blocks = [F.transform(F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), d)), lambda x: F.coalesce(x, F.lit(0.0)))
                  for c, d in layout.embeddings]
        out = out.withColumn(emb_out, array_to_vector(F.concat(*blocks)))
        out = out.withMetadata(emb_out, _attributes([f"{c}_{i}" for c, d in layout.embeddings for i in range(d)]))
    return out


def _attributes(names: Sequence[str]) -> dict:
    return {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]},
                        "num_attrs": len(names)}}


def incomplete_rows(df: DataFrame, layout: FeatureLayout) -> int:
    """Rows for which ``assemble`` fills something in, or whose vector was missing."""
    bad = F.lit(False)
    for c in layout.numerical:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c))
    for c, _ in layout.embeddings:
        bad = bad | F.col(c).isNull()
    for c in layout.presence:
        bad = bad | (F.col(c) == 0.0)
    return df.where(bad).count()


class TextFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The row-local features of a list of names as one vector column, in list order.

    A pipeline that begins with it takes texts; it saves and loads like any other. A
    missing number becomes 0, as in ``assemble``."""

    features = Param(Params._dummy(), "features", "feature names", TypeConverters.toListString)
    stopwords = Param(Params._dummy(), "stopwords", "words of StopwordRatio", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, features=None, stopwords=None):
        super().__init__()
        self._setDefault(inputCol=TEXT, outputCol="num")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        specs = resolve(self.getOrDefault(self.features))
        foreign = [s.name for s in specs if s.columns is None or s.kind != NUMERICAL]
        if foreign:
            raise ValueError(f"not numbers of the text alone: {foreign}")
        stop = self.getOrDefault(self.stopwords) if self.isSet(self.stopwords) else None
        assets = FeatureAssets(stopwords=stop)
        cols = [c for s in specs for c in s.columns(F.col(self.getInputCol()), assets)]
        names = df.select(*cols).columns
        # The features are columns before they are an array: each is evaluated once.
        wide = df.select("*", *[c.alias(f"_t_{i}") for i, c in enumerate(cols)])
        numbers = [F.coalesce(F.nanvl(F.col(f"_t_{i}").cast("double"), F.lit(0.0)), F.lit(0.0)) for i in range(len(names))]
        return wide.withColumn(self.getOutputCol(), array_to_vector(F.array(*numbers))).drop(*[f"_t_{i}" for i in range(len(names))])
