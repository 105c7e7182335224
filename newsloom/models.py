"""Batch slots for supplied models: summary, sentiment, sentence vectors.

``make_model`` is called once per Python worker and returns a function from a
list of texts to a list of results. If a batch fails, its texts are tried one by
one, so that one bad text costs one row; its message goes into ``error``, after
those of slots before. Blank texts do not reach summary and sentiment models.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.summary import NO_INPUT
from newsloom.functions.text import is_blank

Model = Callable[[Sequence[str]], Sequence]


def _slot(make_model: Callable[[], Model], result_type: T.DataType, batch_size: int):
    schema = T.StructType(
        [T.StructField("value", result_type), T.StructField("error", T.StringType())]
    )

    def make_predict():
        model = make_model()

        def guarded(texts):
            try:
                values = list(model(texts))
                if len(values) != len(texts):
                    raise ValueError(f"{len(values)} results for {len(texts)} texts")
                return [(v, None) for v in values]
            except Exception as batch_error:
                if len(texts) == 1:
                    return [(None, str(batch_error))]
                return [guarded([t])[0] for t in texts]

        def predict(texts):
            values, errors = np.full((2, len(texts)), None, dtype=object)
            given = [i for i, text in enumerate(texts) if text]
            if given:
                for i, result in zip(given, guarded([str(texts[i]) for i in given])):
                    values[i], errors[i] = result
            return {"value": values, "error": errors}

        return predict

    return predict_batch_udf(make_predict, return_type=schema, batch_size=batch_size)


def _apply(df, text, make_model, result_type, batch_size):
    """Run the model on the non-blank rows only; the others keep a null result."""
    udf = _slot(make_model, result_type, batch_size)
    # The slot sees a non-null text in every row and leaves out the empty ones.
    given = F.when(is_blank(F.col(text)), "").otherwise(F.col(text))
    return df.withColumn("_blank", is_blank(F.col(text))).withColumn("_result", udf(given))


def _with_error(df: DataFrame, own: Column) -> DataFrame:
    """``error`` with the message of this slot after those of slots before."""
    before = [F.col("error")] if "error" in df.columns else []
    return df.withColumn("error", F.nullif(F.concat_ws("; ", *before, own), F.lit("")))


def summarize_with(
    df: DataFrame, make_model, content: str = "content", out: str = "summary", batch_size: int = 32
) -> DataFrame:
    """``make_model()(texts)`` gives one summary per text."""
    r = F.col("_result")
    failed = F.concat(F.lit("Error generating summary: "), r["error"])
    rows = _apply(df, content, make_model, T.StringType(), batch_size).withColumn(
        out,
        F.when(F.col("_blank"), NO_INPUT).when(r["error"].isNotNull(), failed).otherwise(r["value"]),
    )
    return _with_error(rows, r["error"]).drop("_blank", "_result")


def score_with(
    df: DataFrame,
    make_model,
    text: str = "summary",
    label: str = "sentiment",
    score: str = "score",
    batch_size: int = 64,
) -> DataFrame:
    """``make_model()(texts)`` gives one ``(label, score)`` pair per text."""

    def make_encoded():
        model = make_model()
        return lambda texts: [f"{float(s)!r}\t{name}" for name, s in model(texts)]

    r = F.col("_result")
    parts = F.split(r["value"], "\t", 2)
    failed = F.concat(F.lit("Error analyzing sentiment: "), r["error"])
    bad = r["error"].isNotNull()
    rows = (
        _apply(df, text, make_encoded, T.StringType(), batch_size)
        .withColumn(
            label, F.when(F.col("_blank"), NO_INPUT).when(bad, failed).otherwise(F.get(parts, F.lit(1)))
        )
        .withColumn(
            score,
            F.when(F.col("_blank") | bad, 0.0).otherwise(F.get(parts, F.lit(0)).cast("double")),
        )
    )
    return _with_error(rows, r["error"]).drop("_blank", "_result")


def embed_with(
    df: DataFrame, make_model, content: str = "content", out: str = "features", batch_size: int = 64
) -> DataFrame:
    """``make_model()(texts)`` gives one list of floats per text; blank texts are given too.

    A text that fails has a null vector, and its message in ``error``.
    """
    schema = T.StructType([T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def make_predict():
        model = make_model()

        def guarded(texts):
            try:
                values = [np.asarray(v, dtype=float) for v in model(texts)]
                if len(values) != len(texts):
                    raise ValueError(f"{len(values)} results for {len(texts)} texts")
                return [(v, None) for v in values]
            except Exception as batch_error:
                if len(texts) == 1:
                    return [(None, str(batch_error))]
                return [guarded([t])[0] for t in texts]

        def predict(texts):
            found = guarded([str(t) for t in texts])
            width = max((len(v) for v, _ in found if v is not None), default=1)
            values = np.full((len(found), width), np.nan)
            for i, (v, _) in enumerate(found):
                if v is not None:
                    values[i] = v
            return {"value": values, "error": np.asarray([e for _, e in found], dtype=object)}

        return predict

    udf = predict_batch_udf(make_predict, return_type=schema, batch_size=batch_size)
    rows = df.withColumn("_result", udf(F.coalesce(F.col(content), F.lit(""))))
    result = F.col("_result")
    rows = rows.withColumn(out, F.when(result["error"].isNull(), array_to_vector(result["value"])))
    return _with_error(rows, result["error"]).drop("_result")
