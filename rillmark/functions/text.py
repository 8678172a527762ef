"""Text, path, JSON and number expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = r"(?U)\s+"
#: What SQL engines with ASCII classes take as white space.
ASCII_WHITE = r"[\t\n\f\r ]+"


def tokens(text: Column, white: str = WHITE) -> Column:
    """White-space tokens; an array without empty strings."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), white), "")


def index_tokens(text: Column, shortest: int = 2, longest: int = 20) -> Column:
    """Distinct lower-cased word tokens of 2 to 20 characters, as a text index keeps them."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= shortest) & (F.length(w) <= longest)))


def normalize_text(text: Column) -> Column:
    """Runs of white space become one space; trimmed; lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")))


def normalize_path(path: Column) -> Column:
    return F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path by its parts, longest first, without repeats."""
    parts = F.array_remove(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))


def excerpt(text: Column, length: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)


def clean_local_path(path: Column, container: str = "/app/data/", local: str = "data/") -> Column:
    """Double slashes collapse; a container's path becomes the local one."""
    return F.replace(F.replace(path, F.lit("//"), F.lit("/")), F.lit(container), F.lit(local))


def blank(value: Column) -> Column:
    """Null where a string is null or empty: what counts as missing."""
    return F.nullif(value, F.lit(""))


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank(v) for v in values])


def format_bbox(box: Column) -> Column:
    return F.format_string("(%.1f, %.1f) → (%.1f, %.1f)", box["x0"], box["y0"], box["x1"], box["y1"])


def highlight(text: Column, passage: Column) -> Column:
    """HTML-escaped text with the escaped passage marked."""

    def escaped(x: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            x = F.replace(x, F.lit(sign), F.lit(name))
        return x

    inner = escaped(passage)
    return F.when(passage == "", escaped(text)).otherwise(F.replace(escaped(text), inner, F.concat(F.lit("<mark>"), inner, F.lit("</mark>"))))


def flatten_parts(parts: Column) -> Column:
    """The texts of a message's parts (array of struct with text), joined."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def point_id(source: Column, chunk_id: Column) -> Column:
    """A UUID's text from the md5 of ``source:chunk_id``."""
    digest = F.md5(F.concat(source, F.lit(":"), chunk_id.cast("string")))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def company_and_year(doc_id: Column) -> tuple[Column, Column]:
    """Company and four-digit year of a name such as ``some-company_2019``; null if missing."""
    dated = doc_id.rlike(r"_\d{4}$")
    name = F.when(dated, F.regexp_extract(doc_id, r"^(?s)(.*)_\d{4}$", 1)).otherwise(doc_id)
    return blank(F.trim(F.translate(name, "-_", "  "))), F.when(dated, F.regexp_extract(doc_id, r"_(\d{4})$", 1))


def compute_cost(prompt_tokens: Column, completion_tokens: Column, price_in: float, price_out: float) -> Column:
    return prompt_tokens / 1000.0 * F.lit(price_in) + completion_tokens / 1000.0 * F.lit(price_out)


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """difflib's ratio; its arguments are not interchangeable."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def fuzzy_bound(left: Column, right: Column) -> Column:
    """No ratio exceeds this, so pairs below a threshold need no UDF."""
    total = F.length(left) + F.length(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.least(F.length(left), F.length(right)) / total)


#: Keys whose texts come first when fragments are gathered from JSON.
FRAGMENT_KEYS = ["answer", "statement", "reason", "summary", "explanation", "content", "message"]


def _fragments(value) -> list[str]:
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if isinstance(value, (int, float)):
        return [str(value)]
    if isinstance(value, list):
        return [x for item in value for x in _fragments(item)]
    if not isinstance(value, dict):
        return []
    own = value.get("text")
    head = [own.strip()] if isinstance(own, str) and own.strip() else []
    ranked = [k for k in FRAGMENT_KEYS if k in value] + [k for k in value if k not in FRAGMENT_KEYS and k != "text"]
    return head + [x for k in ranked for x in _fragments(value[k])]


@F.pandas_udf(T.StringType())
def json_text(values: pd.Series) -> pd.Series:
    """The texts in a JSON document, joined by spaces; null if it is none or holds none."""

    def one(text):
        try:
            found = _fragments(json.loads(text)) if isinstance(text, str) else []
        except ValueError:
            found = []
        return " ".join(found).strip() if found else None

    return values.map(one)


def repaired_json(text: str | None) -> str | None:
    """The JSON document in a model's answer: the whole text, else the widest braces, else brackets."""
    if not isinstance(text, str):
        return None
    whole = text.strip()
    spans = [(0, len(whole))] + [(whole.find(a), whole.rfind(b) + 1) for a, b in ("{}", "[]")]
    for begin, end in spans:
        if 0 <= begin < end - 1 or (begin == 0 and end > 0):
            try:
                return json.dumps(json.loads(whole[begin:end]), ensure_ascii=False)
            except ValueError:
                continue
    return None


@F.pandas_udf(T.StringType())
def repair_json(values: pd.Series) -> pd.Series:
    """repaired_json of a column."""
    return values.map(repaired_json)


def bpe_tokens(path: str, pattern: str) -> Callable[[Column], Column]:
    """A splitter of texts into byte-pair tokens by a file of ranks, for chunkers in place of ``tokens``.

    A token's bytes that are not whole characters become replacement marks."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        codec = _codec(path, pattern)
        return texts.map(lambda t: [codec.decode_single_token_bytes(i).decode("utf-8", "replace") for i in codec.encode_ordinary(t or "")])

    return split


@cache
def _codec(path: str, pattern: str):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
