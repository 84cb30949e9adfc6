"""Packing by power-of-two decomposition.

A document of n tokens is cut into whole sequences of the greatest length and then into the
powers of two that make up the rest.  Every piece is a sequence of its own, in the bucket of
its length: no sequence crosses documents, and none needs padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.scratch import whole_text

LIMIT = 1024
END_ID = 0
#: text of the vocabulary's special token and its id
SPECIAL = ("<|endoftext|>", 50256)


def public_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of a document's pieces, longest first; all are powers of two up to ``limit``."""
    return [limit] * (n // limit) + [1 << k for k in range(limit.bit_length() - 2, -1, -1)
                                     if (n % limit) >> k & 1]


def encoder(vocabulary: str):
    """Text -> token ids.  The same ids as the JSON form of the vocabulary gives, a few times faster."""
    import public_tokenizers
    import tiktoken
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks=ranks, special_tokens=dict([SPECIAL]))
    allowed = {SPECIAL[0]}
    return lambda text: (encoding.encode(text, allowed_special=allowed) if SPECIAL[0] in text
                         else encoding.encode_ordinary(text))


def pack(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``ids`` is left out if ``with_ids`` is false.  A null text counts as empty and gives the
    end id alone.  Rows repeated with one doc_id are packed one by one.  Columns other than
    doc_id and text are ignored.  sequence_id is unique; offset is 0, as a sequence holds
    one piece.  ``limit`` must be a power of two.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    vocabulary = vocabulary or public_vocabulary()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (
        ", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            tokens: list[np.ndarray] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text), END_ID], dtype="<u4")
                start = 0
                for length in cut_lengths(len(ids), limit):
                    rows.append((doc_id, start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids)))
                    start += length
                if with_ids:
                    tokens.append(ids)
            arrays = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([r[2] for r in rows], dtype=np.int64))).astype(np.int32)
                flat = np.concatenate(tokens or [np.zeros(0, "<u4")]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    pieces = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(cut, schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(),
                               "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences with their ids, one folder per length."""
    pieces.write.partitionBy("length").parquet(path)
