"""Token counts: batch encoding inside Arrow functions that return lengths only.

Batches are balanced by bytes, so a worker holds the encodings of a bounded amount of text. A long text
is cut at safe boundaries: a space that follows a character that isn't white space. The byte-level
pre-tokenizer always starts a new piece there (a space is the first character of its piece or part of a
run of white space), it looks ahead only inside runs of white space, and no special token holds white
space, so the counts of the parts add up to the count of the whole text. Texts are split only if the tokenizer file
itself says that it works so (byte-level pieces, no normaliser, no added token that takes white space).

Defined results: null or empty text 0 bytes and 0 tokens; repeated rows are counted each; a text without
a safe boundary is encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import arrow_map, arrow_type, named, pick, slices, typed

#: Characters of a part of a long text, and bytes of a batch that goes to the encoder.
PART_CHARS = 16_384
ENCODE_BYTES = 512 << 10

_BOUNDARY = re.compile(r"(?<=\S) ")


def split_safely(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """Parts of about part_chars that begin at a safe boundary; their counts add up."""
    if len(text) <= part_chars:
        return [text]
    parts, start = [], 0
    while len(text) - start > part_chars:
        found = _BOUNDARY.search(text, start + part_chars)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.start()
    parts.append(text[start:])
    return parts


def splits_at_spaces(config: dict) -> bool:
    """Whether a tokenizers file starts a new piece at every safe boundary."""
    pieces = config.get("pre_tokenizer") or {}
    byte_level = pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not pieces.get("add_prefix_space")
    blind = not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in config.get("added_tokens") or ())
    return bool(byte_level and blind and not config.get("normalizer"))


@functools.cache
def _tokenizer(path: str):
    """(lengths of a list of texts, whether long texts may be split) of a file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], splits_at_spaces(json.loads(tokenizer.to_str()))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row.

    tokenizer_path names a tokenizers .json or a sentencepiece .model that every executor can read.
    """
    schema = pa.schema([("doc_id", arrow_type(docs, id_col)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, splits = _tokenizer(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                texts = [x or "" for x in part.column("text").to_pylist()]
                totals = [0] * len(texts)
                owner, pending, size = [], [], 0

                def flush():
                    for row, n in zip(owner, lengths(pending) if pending else [], strict=True):
                        totals[row] += n
                    owner.clear()
                    pending.clear()

                for row, text in enumerate(texts):
                    for piece in split_safely(text) if splits else [text]:
                        owner.append(row)
                        pending.append(piece)
                        size += len(piece) if piece.isascii() else len(piece.encode())
                        if size >= ENCODE_BYTES:
                            flush()
                            size = 0
                flush()
                yield named(schema, doc_id=part.column("doc_id"), n_bytes=[len(x.encode()) for x in texts], n_tokens=totals)

    counted = arrow_map(pick(docs, doc_id=id_col, text=text_col), encode, f"{typed(docs, id_col, 'doc_id')}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
