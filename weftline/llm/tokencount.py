"""Token counts of whole texts by a tokenizer file, with lengths the only thing that leaves a batch.

Long texts are split where the pre-tokenizer starts a new piece whatever surrounds it: before a single
space between two letters. Counts of the parts then add up to the count of the whole. Parts are encoded in
batches of about `batch_bytes` UTF-8 bytes, so memory follows that bound and not the longest text; a text
that offers no such place (base64, scripts without spaces) stays whole, as its words cannot be cut safely.

Defined results: null counts as the empty text (0 tokens); special strings inside a text are handled
as the library does by default; nothing is added, cut or padded. Equal texts get equal counts. Other
columns pass through untouched.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SAFE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_loaded: dict[str, object] = {}


def parts(text: str, size: int) -> Iterator[str]:
    """The text in parts of at least `size` characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def load(vocabulary: str):
    """A function from a list of texts to their numbers of tokens, for .json or .model files; one per process."""
    if vocabulary not in _loaded:
        if vocabulary.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            _loaded[vocabulary] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task slots are the parallelism
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(vocabulary)
            model.no_truncation()
            model.no_padding()
            encode = getattr(model, "encode_batch_fast", model.encode_batch)
            _loaded[vocabulary] = lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]
    return _loaded[vocabulary]


def count_all(texts: list[str], vocabulary: str, part_chars: int, batch_bytes: int) -> np.ndarray:
    """Numbers of tokens of the texts."""
    count, totals = load(vocabulary), np.zeros(len(texts), np.int64)
    held, owners, size = [], [], 0

    def flush() -> None:
        np.add.at(totals, owners, count(held))
        held.clear()
        owners.clear()

    splits = vocabulary.endswith(".json")
    for i, text in enumerate(texts):
        for part in parts(text, part_chars) if splits else (text,):
            held.append(part)
            owners.append(i)
            size += len(part) if part.isascii() else len(part.encode())
            if size >= batch_bytes:
                flush()
                size = 0
    if held:
        flush()
    return totals


def token_counts(docs: DataFrame, vocabulary: str, *, text_col: str = "text", part_chars: int = 1 << 15, batch_bytes: int = 1 << 18) -> DataFrame:
    """`docs` without its text column, with n_bytes and n_tokens (longs)."""
    keep = [c for c in docs.columns if c != text_col]
    slim = docs.select(*keep, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(text_col, F.lit("")).alias("__text"))
    schema = T.StructType([*slim.drop("__text").schema.fields, T.StructField("n_tokens", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts = count_all(texts.to_pylist(), vocabulary, part_chars, batch_bytes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*batch.schema.names[:-1], "n_tokens"])

    return slim.mapInArrow(run, schema)
