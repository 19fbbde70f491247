"""Token counts without token ids.

Pieces are counted once per distinct pre-token, joined to the pre-token
frequencies of each document and summed.

A pre-token is a run of blanks with what follows up to the next blank (the
library puts one blank before the text).  No piece of the vocabulary has a
blank after another character, so merges never cross the start of a
pre-token and the sum equals the count for the whole text; ``check_vocabulary``
refuses a model where that does not hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, short_hot_split, utf8
from .words import count_keys

BLANK = "▁"
#: Pre-tokens whose counts every map task holds; about 30 MB of Python objects.
HOT_PRETOKENS = 1 << 18

_RUNS = re.compile(rb" +[^ ]*")


def pretokens(text: bytes) -> list[bytes]:
    """The pre-tokens of ``text``, each without its first blank."""
    text = text.replace(BLANK.encode(), b" ")
    if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
        return text.split(b" ") if text else []
    return [x[1:] for x in _RUNS.findall(b" " + text)]


def load_model(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def check_vocabulary(model) -> None:
    """Raise if a piece holds a blank after another character."""
    for i in range(model.get_piece_size()):
        if BLANK in model.id_to_piece(i).lstrip(BLANK):
            raise ValueError("a piece crosses a word boundary; pre-tokens are not independent")


def piece_counts(table: DataFrame, model_file: str) -> DataFrame:
    """Add ``pieces`` to a table of distinct pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_file)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            found = model.encode([k.decode("utf-8", "replace") for k in keys], num_threads=1)
            # a lone blank; the library puts no blank before an empty text
            pieces = [len(x) if k else 1 for k, x in zip(keys, found, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], names=["key", "n", "pieces"])

    return table.select("key", "n").mapInArrow(run, "key binary, n long, pieces long")


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``model_file`` is a sentencepiece BPE model whose normaliser keeps the
    text.  A null text counts as empty (no bytes, no tokens); repeated rows
    and null ids each keep their own row; an empty table gives no rows.
    """
    spark = docs.sparkSession
    check_vocabulary(load_model(model_file))
    table = saved(piece_counts(count_keys(docs, pretokens), model_file), "pretokens")
    hot, rest = short_hot_split(table, "n", HOT_PRETOKENS)
    known = hot.select("key", "pieces").toArrow()
    lookup = spark.sparkContext.broadcast(dict(zip(known["key"].to_pylist(), known["pieces"].to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lookup.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("key", "row", "doc_id", "n_bytes", "n", "known")}

            def add(*values, out=out):
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)

            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                total = 0
                for key, n in Counter(pretokens(text)).items():
                    if (p := pieces.get(key)) is None:
                        add(key, row, None, None, n, 0)
                    else:
                        total += n * p
                # no pre-token has a blank after another character
                add(b"row %d" % row, row, doc_id, len(text), 0, total)
                row += 1
            yield pa.record_batch(
                [pa.array(v, t) for v, t in zip(out.values(), (pa.binary(), *[pa.int64()] * 5), strict=True)], names=list(out)
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "key binary, row long, doc_id long, n_bytes long, n long, known long"
    )
    tokens = F.sum(F.col("known") + F.col("n") * F.coalesce("pieces", F.lit(0)))
    return (
        rows.join(rest.select("key", "pieces"), "key", "left")
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
