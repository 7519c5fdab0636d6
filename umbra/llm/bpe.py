"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut, before the library's regex sees them, at places where one match of the pattern
must end and the next begin, so the ids are those of the whole text. Decoding joins the raw bytes of
the ids; no id is ever decoded to characters on its own.

Defined cases: a null text counts as empty; an empty text has no ids and the digest of zero bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.base import bounded_batches, by_value

by_value(__name__)

RANKS = "byte_bpe_50k.tiktoken"
#: Texts above this many characters are cut at safe places, into pieces of about this length.
PIECE = 20_000
#: A place inside a text where a match must end: an ASCII letter, digit or mark, then a space. Every
#: alternative that took the first character takes no white space after it.
SAFE = re.compile(r"(?<=[!-~])(?= )")
#: Where a piece has no such place: an ASCII letter before what is none, or a digit before what is none.
SAFE_INNER = re.compile(r"(?<=[A-Za-z])(?=[0-9!-&(-/:-@\[-`{-~ \n])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~ \n])")


def load(rank_file: str):
    """The tokenizer of a rank file: a path, or the name of a file of the installed vocabularies."""
    import os

    import public_tokenizers
    import tiktoken

    path = rank_file if os.path.sep in rank_file else public_tokenizers.path(rank_file)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE):
    """``text`` cut at safe places into pieces that encode to the ids of the whole; a piece is longer
    than ``limit`` only where no place is safe."""
    start, n = 0, len(text)
    while n - start > limit:
        at = SAFE.search(text, start + limit)
        end = at.start() if at else n
        if end - start > 4 * limit:
            inner = SAFE_INNER.search(text, start + limit, end)
            end = inner.start() if inner else end
        yield text[start:end]
        start = end
    yield text[start:]


def encode(enc, text: str) -> np.ndarray:
    """Ids of ``text`` as little-endian unsigned 32-bit integers."""
    if len(text) <= PIECE:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in pieces(text)])


def decode(enc, ids: np.ndarray) -> bytes:
    return enc.decode_bytes(ids.tolist())


def tokenize(docs: DataFrame, rank_file: str = RANKS, keep_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids (with ``keep_ids``), ids_sha256, decoded_sha256 of each row (doc_id, text), and its columns ``keep``."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        enc = load(rank_file)
        for b in batches:
            n, one, two, kept = [], [], [], []
            for text in b.column("text").to_pylist():
                ids = encode(enc, text or "")
                n.append(len(ids))
                one.append(hashlib.sha256(ids.tobytes()).hexdigest())
                two.append(hashlib.sha256(decode(enc, ids)).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            cols += [b.column(c) for c in keep]
            names += keep
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, schema)


def detokenize(rows: DataFrame, rank_file: str = RANKS) -> DataFrame:
    """doc_id, raw (the bytes that the ids stand for) of each row (doc_id, ids); null ids give null."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        enc = load(rank_file)
        for b in batches:
            raw = [None if x is None else enc.decode_bytes(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, raw binary")
