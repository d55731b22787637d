"""Token counts: texts go to the tokenizer in batches of equal bytes inside an Arrow function, only lengths return.

Long texts are split where no token can reach across, so the counts equal those of the whole text:

* sentencepiece models with the identity normalizer whose pieces hold the word mark only at their start: before a
  single space between two other characters. Merges never cross that place; the space goes, as the model puts one
  before each text.
* tokenizers files (.json): not split, as what is safe depends on the file's pre-tokenizer.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated rows; a null id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SUB_BATCH_BYTES, pick, ship, sizes, text_slices

#: Characters from which a text is split.
LONG_TEXT = 1 << 16
#: A space between two characters that are neither space nor word mark.
_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


def split_safely(text: str, longest: int = LONG_TEXT) -> list[str]:
    """Parts of at most about `longest` characters whose token counts add up to the text's."""
    parts, at = [], 0
    while len(text) - at > longest:
        found = _SAFE.search(text, at + longest)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.end()
    parts.append(text[at:] if at else text)
    return parts


def _splits_safely(model_file: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    return (
        not norm.precompiled_charsmap
        and norm.add_dummy_prefix
        and norm.escape_whitespaces
        and not norm.remove_extra_whitespaces
        and not any(re.search("[^▁]▁", p.piece) for p in model.pieces)
    )


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, made once a worker."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    safe = _splits_safely(path)

    def count(texts: list[str]) -> list[int]:
        parts, owner = [], []
        for k, text in enumerate(texts):
            own = split_safely(text) if safe else [text]
            parts += own
            owner += [k] * len(own)
        totals = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(parts):  # so that the ids of few parts exist at once
            to, chars = at, 0
            while to < len(parts) and (to == at or chars + len(parts[to]) <= LONG_TEXT * 4):
                chars += len(parts[to])
                to += 1
            np.add.at(totals, owner[at:to], [len(ids) for ids in model.encode(parts[at:to], num_threads=1)])
            at = to
        return totals.tolist()

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit of each row; path: a sentencepiece .model or a tokenizers .json."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in text_slices(batches, "text", SUB_BATCH_BYTES):
            n = np.array(count(part.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes(part.column(1))), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kept = pick(docs, id_col, text_col).toDF("id", "text")
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
