"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes and long texts are split at safe boundaries. The
model is a SentencePiece BPE model, whose pieces hold the mark of a space at
their start only. A single space between two characters that are neither a
space nor that mark is therefore a safe boundary: the space is left out and the
mark that the library puts before every input stands for it, so the parts'
counts add up to the count of the whole.

Cases: a null text counts as empty (no tokens); a text without a safe boundary
is encoded whole; repeated rows give repeated rows; a null id stays null; an
empty table gives an empty result; other columns of the input are not read, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import binary_text, slices_by_bytes, utf8

MARKS = (" ", "\u2581")
_models: dict[str, object] = {}


def load_model(path: str):
    """The SentencePiece model of a path, once for each worker process."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(model.get_piece_size()):
            if MARKS[1] in model.id_to_piece(i).lstrip(MARKS[1]):
                raise ValueError("the model has pieces across spaces; texts cannot be split")
        _models[path] = model
    return _models[path]


def safe_parts(text: str, size: int) -> list[str]:
    """Cut a text at safe boundaries into parts of about ``size`` characters."""
    if len(text) <= size:
        return [text]
    parts, start = [], 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while 0 <= cut and (cut + 1 >= len(text) or text[cut + 1] in MARKS or text[cut - 1] in MARKS):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        parts.append(text[start:cut])
        start = cut + 1
    return [*parts, text[start:]]


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    batch_bytes: int = 1 << 20,
    part_chars: int = 1 << 15,
) -> DataFrame:
    """Return id, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for whole in batches:
            for batch in slices_by_bytes(whole, "text", batch_bytes):
                raw = batch.column("text").to_pylist()
                parts = [safe_parts(utf8(x), part_chars) for x in raw]
                lengths = iter([len(x) for x in model.encode([y for x in parts for y in x], num_threads=1)])
                tokens = [sum(next(lengths) for _ in x) for x in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(x) for x in raw], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([x > limit for x in tokens], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return (
        docs.select(F.col(id_col).alias("doc_id"), binary_text(F.col(text_col)).alias("text"))
        .mapInArrow(encode, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
        .withColumnRenamed("doc_id", id_col)
    )
