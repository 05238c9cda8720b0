"""SentencePiece encoding and decoding through a table of distinct chunks.

In the vocabulary used here no piece holds a whitespace marker after another character, so no merge
crosses the border before a run of markers: segmenting each marked word on its own gives the ids of
the whole text. :func:`chunk_model` checks this for the vocabulary it is given. Each task keeps a
table of the distinct marked words it has met, segments and decodes each of them once, and joins ids
back by position. The table lives in the task, because a corpus-wide one would shuffle every word of
every text to save a segmentation that costs less than the shuffle.

Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from tapeloom.llm.common import Memo, per_row

MARK = "▁"
#: A run of spaces with the word after it, after the one space that the model puts in front.
CHUNK = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunk_model(path: str):
    """The processor of a model file whose pieces keep to one marked word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} crosses a whitespace marker; texts can't be cut into words")
    if model.encode(" a") != model.encode(MARK + "a") or model.encode("  a") == model.encode("a"):
        raise ValueError("the model rewrites white space; texts can't be cut into words")
    return model


def chunk_table(model, size: int = 400_000) -> Memo:
    """Chunk -> (ids, ids as text, number of ids, decoded text with its leading space)."""
    lone = model.piece_to_id(MARK)

    def fill(chunk: str):
        rest = chunk[1:]  # the model puts this space back
        ids = model.encode(rest) if rest else [lone]
        # decode() drops the one space that stands for the model's own marker
        text = " " + model.decode(ids) if rest else " "
        return ids, ",".join(map(str, ids)), len(ids), text

    return Memo(fill, size)


def chunks(text: str) -> list[str]:
    return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """(id, ids array, decoded text) of every whole text."""
    path = model_path or default_model()

    def make():
        table = chunk_table(chunk_model(path))

        def one(text: str):
            found = [table[c] for c in chunks(text)]
            return [i for f in found for i in f[0]], "".join([f[3] for f in found])[1:]

        return one

    return per_row(df, text_col, [id_col], make, [("ids", ArrayType(IntegerType())), ("decoded", StringType())])


def digests(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, carry: list[str] | None = None, with_ids: bool = False
) -> DataFrame:
    """Number of ids and digests of ids and decoded text; with ``with_ids`` the ids as well."""
    path = model_path or default_model()

    def make():
        table = chunk_table(chunk_model(path))

        def one(text: str):
            found = [table[c] for c in chunks(text)]
            ids = hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest()
            decoded = hashlib.sha256("".join([f[3] for f in found])[1:].encode()).hexdigest()
            row = sum([f[2] for f in found]), ids, decoded
            return (*row, [i for f in found for i in f[0]]) if with_ids else row

        return one

    outputs = [("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType())]
    return per_row(df, text_col, carry or [id_col], make, outputs + [("ids", ArrayType(IntegerType()))] * with_ids)
