"""Scalar functions over strings, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "token_count",
    "counted_tokens",
    "strip",
    "page_tag",
    "fenced_json",
    "json_candidates",
    "extract_json",
    "is_json",
    "strip_fence",
    "sanitize_name",
    "dots_to_colon",
    "index_number",
    "page_number",
    "first_tag",
    "last_tag",
    "parent_code",
    "header_level",
    "header_title",
    "apply_offset",
    "chat_role",
    "chat_history",
    "finish_reason",
    "yes_or_no",
    "suffix",
    "stem",
    "base_name",
    "document_name",
    "title_or_untitled",
    "preview",
    "shortened",
    "squeezed",
]

#: Texts to their numbers of tokens.
Counter = Callable[[list[str]], list[int]]
_FENCE, _JSON_FENCE = "```", "```json"


def token_count(text: Column) -> Column:
    """A token for every four characters; null has none."""
    return F.coalesce(F.shiftright(F.length(text), 2), F.lit(0)).cast("long")


def counted_tokens(text: Column, counter: Counter | None = None) -> Column:
    """Tokens as ``counter`` counts them on the executors, for batches of texts; ``token_count`` without one.

    Null and empty texts have none.  What the counter fails on is counted text by text, and estimated where that fails too.
    """
    if counter is None:
        return token_count(text)

    def one(said: str) -> int:
        try:
            return int(counter([said])[0])
        except Exception:
            return len(said) // 4

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        given = [t for t in texts if t]
        try:
            found = [int(n) for n in counter(given)] if given else []
            if len(found) != len(given):
                raise ValueError("not a count for each text")
        except Exception:
            found = [one(t) for t in given]
        counts = iter(found)
        return pd.Series([next(counts) if t else 0 for t in texts], dtype="int64")

    return count(text)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def squeezed(text: Column) -> Column:
    """Lower case without any white space, for fuzzy comparison."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def page_tag(index: Column, text: Column, end: str = "\n") -> Column:
    """A page's text between its numbered tags."""
    return F.concat(F.lit("<physical_index_"), index, F.lit(">\n"), text, F.lit("\n</physical_index_"), index, F.lit(">" + end))


def _last_fence(text: Column) -> Column:
    """1-based place of the last fence, 0 without one."""
    back = F.locate(_FENCE, F.reverse(text))
    return F.when(back > 0, F.length(text) - back - F.lit(1)).otherwise(0)


def fenced_json(raw: Column) -> Column:
    """What stands between the first json fence and the last fence, else all, with single spaces and null for None.

    A json fence that is never closed gives an empty string.
    """
    start = F.locate(_JSON_FENCE, raw) + len(_JSON_FENCE)
    inside = F.substring(raw, start, F.greatest(_last_fence(raw) - start, F.lit(0)))
    body = F.when(F.contains(raw, F.lit(_JSON_FENCE)), inside).otherwise(raw)
    return strip(F.regexp_replace(F.replace(body, F.lit("None"), F.lit("null")), r"(?U)\s+", " "))


def json_candidates(raw: Column) -> tuple[Column, Column]:
    """The text to parse, and the same without commas before closing brackets."""
    body = fenced_json(raw)
    return body, F.replace(F.replace(body, F.lit(",]"), F.lit("]")), F.lit(",}"), F.lit("}"))


def is_json(text: Column) -> Column:
    """Whether the text is one JSON value.  The parser stops after a value, so the value is parsed as the only one of a list."""
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    has = lambda k: F.try_variant_get(one, f"$[{k}]", "variant").isNotNull()
    return F.coalesce(F.try_parse_json(text).isNotNull() & has(0) & ~has(1), F.lit(False))


def extract_json(raw: Column, schema: str) -> Column:
    """A reply's JSON by ``schema``; a second try mends trailing commas; null if neither parses."""
    first, second = json_candidates(raw)
    return F.when(is_json(first), F.from_json(first, schema)).when(is_json(second), F.from_json(second, schema))


def strip_fence(raw: Column) -> Column:
    """After the first json fence and before the last fence, stripped."""
    after = F.when(F.contains(raw, F.lit(_JSON_FENCE)), F.substring(raw, F.locate(_JSON_FENCE, raw) + len(_JSON_FENCE), F.length(raw))).otherwise(raw)
    end = _last_fence(after)
    return strip(F.when(end > 0, F.substring(after, F.lit(1), end - 1)).otherwise(after))


def sanitize_name(name: Column, replacement: str = "-") -> Column:
    return F.replace(F.replace(name, F.lit("/"), F.lit(replacement)), F.lit("\\"), F.lit(replacement))


def dots_to_colon(text: Column) -> Column:
    """Leader dots, with or without spaces between them, as a colon."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def index_number(raw: Column) -> Column:
    """The number of a page tag, open or bare; null for anything else."""
    return F.regexp_extract(raw, r"^<?physical_index_\s*(\d+)\s*>?\s*$", 1).try_cast("int")


def page_number(raw: Column) -> Column:
    """A page as a number; null where it is none, so that callers keep the raw value beside it."""
    return F.when(F.trim(raw).rlike(r"^[+-]?\d+$"), F.trim(raw).try_cast("int"))


def first_tag(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"<physical_index_(\d+)>", 1).try_cast("int"), F.lit(-1))


def last_tag(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"<physical_index_(\d+)>"), F.lit(1)), F.lit(-1)).try_cast("int"), F.lit(-1))


def parent_code(code: Column) -> Column:
    """A dotted code without its last part; null for a single part."""
    return F.when(F.contains(code, F.lit(".")), F.regexp_extract(code, r"(?s)^(.*)\.[^.]*$", 1))


_HEADER = r"(?U)^(#{1,6})\s+([^\n]+)$"


def header_level(stripped: Column) -> Column:
    """1 to 6 for a stripped header line, else null."""
    return F.nullif(F.length(F.regexp_extract(stripped, _HEADER, 1)), F.lit(0))


def header_title(stripped: Column) -> Column:
    return strip(F.regexp_extract(stripped, _HEADER, 2))


def apply_offset(page: Column, offset: Column) -> Column:
    return F.when(page.isNotNull(), page + offset)


def chat_role(role: Column) -> Column:
    return F.when(role == "user", F.lit("user")).otherwise(F.lit("model"))


def chat_history(turns: Column, prompt: Column) -> Column:
    """Turns (role, content) as a model wants them, with the prompt as the last one of the user."""
    mapped = F.transform(turns, lambda t: F.struct(chat_role(t["role"]).alias("role"), t["content"].alias("content")))
    return F.array_append(mapped, F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def finish_reason(raw: Column) -> Column:
    over = F.contains(raw, F.lit("MAX_TOKENS")) | F.contains(raw, F.lit("LENGTH"))
    return F.when(over, F.lit("max_output_reached")).otherwise(F.lit("finished"))


def yes_or_no(raw: Column, key: str) -> Column:
    """A reply's answer under ``key``; without one no."""
    return F.coalesce(F.get_json_object(fenced_json(raw), f"$.{key}"), F.lit("no"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def suffix(path: Column) -> Column:
    """Lower case with its dot, empty without one; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def document_name(path: Column, title: Column) -> Column:
    """The file name, or for a stream its sanitised title."""
    return F.when(path.isNotNull(), base_name(path)).otherwise(sanitize_name(title_or_untitled(title)))


def title_or_untitled(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))


def preview(text: Column, lines: int = 50, characters: int = 2000) -> Column:
    """The first lines, cut at a number of characters with a mark; null is empty."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    return F.coalesce(F.when(F.length(head) > characters, F.concat(F.substring(head, 1, characters), F.lit("\n... (truncated)"))).otherwise(head), F.lit(""))


def shortened(text: Column, most: int = 40) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
