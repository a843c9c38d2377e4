"""Dense and sparse vector expressions and the encoder seam."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.memory import release


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double; 0 for a null, empty or zero vector.

    For a few pairs per row. Bulk comparison goes through ``operators.search``.
    """
    a, b = _col(a), _col(b)
    norm = _dot(a, a) * _dot(b, b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(usable & (norm > 0), _dot(a, b) / F.sqrt(norm)).otherwise(F.lit(0.0))


def normalise_sparse(weights: Column | str) -> Column:
    """Integer token ids, only positive weights."""
    keyed = F.transform_keys(_col(weights), lambda k, _: k.cast("int"))
    return F.map_filter(keyed, lambda _, v: v > 0)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _six_digits(values: pd.Series) -> pd.Series:
    return values.map(lambda vs: None if vs is None else [f"{float(v):.6g}" for v in vs])


def sparsevec_text(weights: Column | str, dim: int) -> Column:
    """Text form ``{index:value,...}/dim``, indices 1-based and ascending.

    Only the weights visit Python: the JVM's %g keeps trailing zeros.
    """
    entries = F.array_sort(F.map_entries(_col(weights)))
    indices = F.transform(entries, lambda e: (e["key"].cast("int") + 1).cast("string"))
    values = _six_digits(F.transform(entries, lambda e: e["value"].cast("double")))
    body = F.array_join(F.zip_with(indices, values, lambda i, v: F.concat(i, F.lit(":"), v)), ",")
    return F.concat(F.lit("{"), F.coalesce(body, F.lit("")), F.lit("}/" + str(dim)))


# ------------------------------------------------------------------- encoder seam

#: encoder: list of texts -> (dense float32 matrix, list of {token id: weight})
Encoder = Callable[[list[str]], tuple[np.ndarray, list[dict[int, float]]]]

SPARSE_DIM = 250002  # fixed value: size of the sparse vocabulary
EMBED_BATCH = 16     # fixed value: texts per encoder call
PIECE = 16           # encoder calls whose results are held at once

_WORD = re.compile(r"\w+")


def hashing_encoder(dim: int = 64, vocabulary: int = SPARSE_DIM) -> Encoder:
    """Deterministic stand-in for an embedding model: signed feature hashing."""

    def encode(texts: list[str]) -> tuple[np.ndarray, list[dict[int, float]]]:
        dense = np.zeros((len(texts), dim), dtype=np.float32)
        sparse: list[dict[int, float]] = []
        for row, text in enumerate(texts):
            weights: dict[int, float] = {}
            for word in _WORD.findall(text.lower()):
                h = zlib.crc32(word.encode())
                weights[h % vocabulary] = weights.get(h % vocabulary, 0.0) + 1.0
                dense[row, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            sparse.append(weights)
        norms = np.linalg.norm(dense, axis=1, keepdims=True)
        return np.divide(dense, norms, out=dense, where=norms > 0), sparse

    return encode


def embed_batches(df: DataFrame, make_encoder: Callable[[], Encoder] = hashing_encoder, *,
                  text: str = "text", batch: int = EMBED_BATCH) -> DataFrame:
    """Add ``embedding`` and ``sparse``; one encoder per task, ``batch`` texts a call."""
    schema = T.StructType([*df.schema.fields,
                           T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("sparse", T.MapType(T.IntegerType(), T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from encoded(frames, make_encoder(), text, batch)

    return df.mapInPandas(run, schema)


def encoded(frames: Iterator[pd.DataFrame], encode: Encoder, text: str, batch: int) -> Iterator[pd.DataFrame]:
    """The frames with ``embedding`` and ``sparse``, in pieces of ``PIECE`` calls, as a map of
    weights takes far more memory in Python than its text."""
    for frame in frames:
        for lo in range(0, len(frame), PIECE * batch):
            piece = frame.iloc[lo:lo + PIECE * batch]
            dense: list[np.ndarray] = []
            sparse: list[dict[int, float]] = []
            for at in range(0, len(piece), batch):
                vectors, weights = encode(piece[text].iloc[at:at + batch].fillna("").tolist())
                dense.extend(vectors)
                sparse.extend({int(k): float(v) for k, v in w.items() if v > 0} for w in weights)
            yield piece.assign(embedding=dense, sparse=sparse)
        release()
