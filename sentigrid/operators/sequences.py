"""Fixed-length id sequences and dense document vectors."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentigrid.functions.binding import let

# ids below the first vocabulary id
PAD_ID, UNKNOWN_ID, START_ID, END_ID = 0, 1, 2, 3
FIRST_TERM_ID = 4


def token_ids(tokens: Column, vocabulary: list[str]) -> Column:
    """Ids of an array<string>; position in the vocabulary plus FIRST_TERM_ID, or UNKNOWN_ID.

    The lookup is one hash lookup per token over whole Arrow batches.
    """
    first, unknown = FIRST_TERM_ID, UNKNOWN_ID

    @F.arrow_udf("array<int>")
    def look_up(lists: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        lists = lists.cast(pa.list_(pa.string()))
        known = pc.index_in(lists.flatten(), value_set=pa.array(vocabulary, pa.string()))
        ids = pc.fill_null(pc.add(known, pa.scalar(first, pa.int32())), pa.scalar(unknown, pa.int32()))
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(ends, ids.cast(pa.int32()), mask=lists.is_null())

    return look_up(tokens)


def encode_sequences(df: DataFrame, vocabulary: list[str], max_length: int = 256,
                     tokens_col: str = "tokens") -> DataFrame:
    """Adds input_ids and attention_mask of exactly max_length: start, tokens, end, padding.

    Cutting at max_length belongs to the encoding: a model takes no longer input.
    """
    ids = df.withColumn("_ids", token_ids(F.slice(tokens_col, 1, max_length - 2), vocabulary))
    framed = ids.withColumn("_ids", F.concat(F.array(F.lit(START_ID)), "_ids", F.array(F.lit(END_ID))))
    padding = F.lit(max_length) - F.size("_ids")
    return framed.withColumns({
        "input_ids": F.concat("_ids", F.array_repeat(F.lit(PAD_ID), padding)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), padding)),
    }).drop("_ids")


def signed_counts(tokens: Column, dim: int = 64) -> Column:
    """Signed feature hashing: per place the number of tokens with a plus less that with a minus, array<int>.

    The first seven hex digits of a token's md5 name its place, the eighth its sign. Arrow batches: each different
    token of a batch is hashed once; a null array stays null.
    """
    @F.arrow_udf("array<int>")
    def count(lists: pa.Array) -> pa.Array:
        import hashlib

        import numpy as np

        lists = lists.cast(pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        heads = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in coded.dictionary.to_pylist()]
        place = np.array([h // 16 % dim for h in heads], dtype=np.int64)
        sign = np.array([1 if h % 16 < 8 else -1 for h in heads], dtype=np.int64)
        known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        codes = coded.indices.fill_null(0).to_numpy(zero_copy_only=False)[known]
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lists), dtype=np.int64), lengths)[known]
        sums = np.zeros(len(lists) * dim, dtype=np.int64)
        if len(codes):
            cells = rows * dim + place[codes]
            sums = (np.bincount(cells, weights=sign[codes], minlength=len(sums))).astype(np.int64)
        ends = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(ends, pa.array(sums.astype(np.int32)), mask=lists.is_null())

    return count(tokens)


def hashed_embedding(df: DataFrame, dim: int = 64, tokens_col: str = "tokens") -> DataFrame:
    """Adds `embedding` (array<float>): signed hashed counts scaled to length one. Needs no model file.

    A text whose signs cancel everywhere, and one without tokens, is all zeros.
    """
    counts = signed_counts(F.coalesce(tokens_col, F.array().cast("array<string>")), dim)

    def scaled(c: Column) -> Column:
        length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda total, x: total + (x * x).cast("double")))
        return let(length, lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))

    return df.withColumn("embedding", let(counts, scaled))


def embed_documents(df: DataFrame, make_encoder: Callable, text_col: str = "clean",
                    batch_size: int = 32) -> DataFrame:
    """Adds `embedding` from any encoder: `make_encoder()` loads it once per executor and returns
    a function from a batch of texts to a float matrix."""
    encode = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn("embedding", encode(F.col(text_col)))


def onnx_encoder(model_path: str, vocabulary: list[str], max_length: int = 512) -> Callable:
    """An encoder factory for an ONNX model that takes input_ids and attention_mask.

    Texts are split at spaces and looked up in `vocabulary`; the first output is averaged over
    the tokens if it has one vector per token.
    """
    pad, unknown, start, end, first = PAD_ID, UNKNOWN_ID, START_ID, END_ID, FIRST_TERM_ID

    def make():
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        ids = {t: i + first for i, t in enumerate(vocabulary)}

        def encode(texts):
            rows = [[start, *[ids.get(w, unknown) for w in t.split()][: max_length - 2], end] for t in texts]
            width = max(len(r) for r in rows)
            tokens = np.array([r + [pad] * (width - len(r)) for r in rows], dtype=np.int64)
            mask = np.array([[1] * len(r) + [0] * (width - len(r)) for r in rows], dtype=np.int64)
            out = session.run(None, {"input_ids": tokens, "attention_mask": mask})[0]
            if out.ndim == 3:
                out = (out * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1, keepdims=True)
            return out.astype(np.float32)

        return encode

    return make
