"""Functions that SQL cannot express: recursive JSON merge, content of message parts, citation markers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The markers that models are asked to write.
_MARKER = re.compile(r"«cite:(\d+)»(.*?)«/cite»", re.S)
_OPEN = re.compile(r"«cite:\d+»")
_ANY = re.compile(r"«cite:\d+»|«/cite»")
_CITATION = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("doc_index", T.IntegerType())])
_CITED = T.StructType([T.StructField("clean", T.StringType()), T.StructField("citations", T.ArrayType(_CITATION))])


def merge(base: object, extra: object) -> object:
    """Objects merge key by key, the base's keys first; anything else is replaced."""
    if not isinstance(base, dict) or not isinstance(extra, dict):
        return extra
    return {k: merge(base[k], extra[k]) if k in base and k in extra else extra.get(k, base.get(k)) for k in [*base, *(k for k in extra if k not in base)]}


def _parsed(text: str | None) -> tuple[object] | None:
    try:
        return None if text is None else (json.loads(text),)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def json_deep_merge(base: pd.Series, extra: pd.Series) -> pd.Series:
    """JSON of the second merged over the first; a null leaves the other, and so does one that doesn't parse; neither: null."""
    out = []
    for a, b in zip(base, extra, strict=True):
        one, two = _parsed(a), _parsed(b)
        out.append((None if two is None else b) if one is None else a if two is None else json.dumps(merge(one[0], two[0]), ensure_ascii=False))
    return pd.Series(out)


def content_text(value: object) -> str:
    """Text of a message's content: a string, parts, or an object by text, refusal, content."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(map(content_text, value))
    if isinstance(value, dict):
        return next((content_text(value[k]) for k in ("text", "refusal", "content") if value.get(k) is not None), "")
    return ""


@F.pandas_udf(T.StringType())
def message_content(raw: pd.Series) -> pd.Series:
    """The text of a message's raw JSON content; null where there is none or it doesn't parse."""
    return pd.Series([None if (x := _parsed(t)) is None else content_text(x[0]) for t in raw])


def parse_citations(text: str | None, n_documents: int) -> tuple[str, list[tuple[int, int, str, int]]]:
    """The text without markers, and (start, end, cited text, document) of each valid citation, in UTF-16 offsets.

    A marker around another one is stripped; one of an unknown document leaves its text alone.
    """
    if not text:
        return "", []
    out, found, at, size = [], [], 0, 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece.encode("utf-16-le")) // 2

    for m in _MARKER.finditer(text):
        put(_ANY.sub("", text[at : m.start()]))
        at = m.end()
        if _OPEN.search(m[2]):
            put(_ANY.sub("", m[2]))
            continue
        start = size
        put(m[2])
        if int(m[1]) < n_documents:
            found.append((start, size, m[2], int(m[1])))
    if not found and at == 0:
        return text, []
    put(_ANY.sub("", text[at:]))
    return "".join(out), found


@F.pandas_udf(_CITED)
def citations(text: pd.Series, n_documents: pd.Series) -> pd.DataFrame:
    rows = [parse_citations(t, 0 if pd.isna(n) else int(n)) for t, n in zip(text, n_documents, strict=True)]
    return pd.DataFrame({"clean": [c for c, _ in rows], "citations": [[{"start": s, "end": e, "text": t, "doc_index": d} for s, e, t, d in f] for _, f in rows]})
