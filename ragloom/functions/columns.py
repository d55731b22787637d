"""Scalar functions as column expressions: texts, vectors, order and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded down."""
    return F.floor(utf16_length(text) / 4).cast("int")


def sentences(text: Column) -> Column:
    """Parts after ., ! or ? and white space, without blank ones."""
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: s.rlike(r"(?U)\S"))


def same_length(a: Column, b: Column) -> Column:
    return F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))


def _wide(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot_double(a: Column, b: Column) -> Column:
    """Dot product in double precision; unequal lengths are an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(same_length(a, b).isNull(), total)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, given as a float."""
    return dot_double(a, b).cast("float")


def squares(v: Column) -> Column:
    return F.aggregate(_wide(v), F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine as a float; 0 for a zero vector; unequal lengths are an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(squares(a)) * F.sqrt(squares(b))
    return F.when(same_length(a, b).isNull(), F.when(size == 0, 0.0).otherwise(F.try_divide(total, size))).cast("float")


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    size = F.sqrt(squares(v))
    return F.when(size == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / size).cast("float")))


def lost_in_middle(rank: Column, n: Column) -> Column:
    """Place of the item of a rank (both from 0): even ranks fill from the left, odd ones from the right."""
    half = F.floor(rank / 2).cast("int")
    return F.when(n <= 2, rank).when(rank % 2 == 0, half).otherwise(n - 1 - half).cast("int")


# What tells of an error that may pass, as patterns that Java and Python read alike.
TRANSIENT_STATUS = r"(?<![0-9A-Za-z])(429|5[0-9][0-9])(?![0-9A-Za-z])"
TRANSIENT_PHRASES = "rate limit|too many requests|throttl|internal server error|service unavailable|bad gateway|gateway timeout"


def is_transient(message: Column) -> Column:
    """Whether an error message tells of a status or condition that may pass."""
    return F.coalesce(message.rlike(TRANSIENT_STATUS) | F.lower(message).rlike(TRANSIENT_PHRASES), F.lit(False))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_code_fence(text: Column) -> Column:
    """What a text that starts with a Markdown fence holds, from its first line's end to its last fence; other texts as they are."""
    bare = _trimmed(text)
    inside = F.regexp_replace(bare, r"(?s)^[^\n]*\n", "")
    inside = _trimmed(F.regexp_replace(inside, r"(?s)^(.*)```.*$", "$1"))
    return F.when(bare.startswith("```") & bare.contains("\n"), inside).otherwise(text)


def data_uri(path: Column, content: Column) -> Column:
    """data: URI of an image file by its extension."""
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}
    mime = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), kind), F.lit("application/octet-stream"))
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def text_data_uri(text: Column) -> Column:
    return F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", ""))


def role_name(role: Column) -> Column:
    return F.when(F.lower(role).isin("system", "user", "assistant", "tool"), F.lower(role))


def ensure_json_word(text: Column) -> Column:
    """A system message that asks for JSON, as providers want the word to appear."""
    return F.when(F.upper(text).contains("JSON"), text).otherwise(F.concat_ws(" ", text, F.lit("Respond in JSON.")))


def model_family(model: Column) -> Column:
    """The way of asking that a model's name calls for: reasoning, gpt5 or legacy."""
    return F.when(model.rlike("(?i)^o[134]"), "reasoning").when(model.rlike("(?i)^gpt-5"), "gpt5").otherwise("legacy")


def tool_arguments(text: Column) -> Column:
    """JSON of a tool call's arguments: as given if it parses, else as a JSON string."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"(\\|\")", r"\\$1"), "\n", r"\\n"), F.lit('"')))


def tool_choice(kind: Column, name: Column) -> Column:
    """auto, none and required by their names; any other kind names a function."""
    return F.when(F.lower(kind).isin("auto", "none", "required"), F.lower(kind)).otherwise(F.to_json(F.struct(F.lit("function").alias("type"), F.struct(name.alias("name")).alias("function"))))


def input_type(kind: Column) -> Column:
    """A provider's name for what is embedded; documents by default."""
    return F.when(F.lower(kind) == "query", "search_query").when(F.lower(kind) == "classification", "classification").when(F.lower(kind) == "clustering", "clustering").otherwise("search_document")


def total_tokens(*counts: Column) -> Column:
    """Sum of counts, nulls being none; null if all are."""
    return F.when(F.coalesce(*counts).isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in counts), F.lit(0)).cast("long"))
