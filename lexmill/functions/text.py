"""Text functions as Column expressions; Unicode NFKC, lines and similarities need Python (UDFs)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from . import similarity as S

#: White space as Python's ``str.isspace`` has it, as a Java character class body.
WS = r"\p{IsWhite_Space}\x1c-\x1f"
#: Line ends of Python's ``str.splitlines``, as a Java character class body.
ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
#: Zero-width characters, block-level tags, named entities.
ZERO_WIDTH = ["​", "‌", "‍", "⁠", "﻿"]
BLOCK_TAGS = ["article", "blockquote", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre", "section", "tr"]
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "ndash": "–", "mdash": "—"}
MARK = ""  #: stands for a line break of a block tag while tags are removed
OTHER = ""  #: stands for either of the two where a text has them


def sha256_text(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{WS}]")


def hash_rank(record_id: Column, seed: int, algorithm: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(algorithm), F.lit(str(seed)), record_id), 256)


def remove_script_style(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")


def remove_tags(c: Column) -> Column:
    """Comments and tags go; a block tag becomes one line break, unless at the start or after one."""
    safe = F.replace(F.replace(c, F.lit(OTHER), F.lit(OTHER + "1")), F.lit(MARK), F.lit(OTHER + "0"))
    pieces = F.regexp_extract_all(safe, F.lit(r"(?s:<!--.*?-->)|</?[A-Za-z][A-Za-z0-9]*\b[^>]*>|[^<]+|<"), F.lit(0))

    def piece(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        tag = t.startswith("<") & (F.length(t) > 1)
        return F.when(tag & (name != "") & name.isin(BLOCK_TAGS), F.lit(MARK)).when(tag, F.lit("")).otherwise(t)

    joined = F.array_join(F.transform(pieces, piece), "")
    broken = F.regexp_replace(F.regexp_replace(joined, rf"(\A|\n){MARK}+", "$1"), rf"{MARK}+", "\n")
    return F.when(c.contains("<"), F.replace(F.replace(broken, F.lit(OTHER + "0"), F.lit(MARK)), F.lit(OTHER + "1"), F.lit(OTHER))).otherwise(c)


def decode_entities(c: Column) -> Column:
    """One pass over named and numeric entities; unknown or invalid ones stay."""
    table = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))
    pieces = F.regexp_extract_all(c, F.lit(r"&(?:#(?:x[0-9A-Fa-f]+|[0-9]+)|[A-Za-z]+);|[^&]+|&"), F.lit(0))

    def piece(t: Column) -> Column:
        body = F.regexp_extract(t, r"^&#?(.*);$", 1)
        point = F.when(t.startswith("&#x"), F.conv(body.substr(2, 12), 16, 10)).otherwise(body).cast("long")
        valid = point.between(0, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "utf-32")
        return F.when(t.startswith("&#") & t.endswith(";"), F.when(valid, char).otherwise(t)).when(t.startswith("&") & t.endswith(";"), F.coalesce(F.element_at(table, body), t)).otherwise(t)

    return F.when(c.contains("&"), F.array_join(F.transform(pieces, piece), "")).otherwise(c)


def normalize_html(c: Column) -> Column:
    return decode_entities(remove_tags(c))


def remove_zero_width(c: Column) -> Column:
    return F.translate(c, "".join(ZERO_WIDTH), "")


@F.udf(StringType(), useArrow=False)  # a hundred texts at once: an Arrow batch may hold 64 MB of them, and their copies
def _nfkc(x: str | None) -> str | None:
    return None if x is None else unicodedata.normalize("NFKC", x)


_nfkc_once = _nfkc.asNondeterministic()


def nfkc(c: Column) -> Column:
    """Unicode NFKC; ASCII texts are not sent to Python's normaliser."""
    return F.coalesce(_nfkc_once(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, rf"[{WS}&&[^\n]]+", " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"\A[ \n]+|[ \n]+\z", "")


_LINES = pa.struct([("start", pa.int32()), ("value", pa.string())])


def _cut(texts: pa.Array, part: int) -> pa.Array:
    """Of each text the stripped non-blank lines, ``part`` texts at once; Python's own rules for line ends and white space are the contract's."""
    ends, starts, values = [0], [], []
    for k in range(0, len(texts), part):
        some = []
        for text in texts.slice(k, part).to_pylist():
            at = 0
            for line in (text or "").splitlines(keepends=True):
                if value := line.strip():
                    starts.append(at + len(line) - len(line.lstrip()))
                    some.append(value)
                at += len(line)
            ends.append(len(starts))
        values.append(pa.array(some, pa.string()))
    held = pa.concat_arrays(values) if values else pa.array([], pa.string())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(starts, pa.int32()), held], fields=list(_LINES)))


def with_lines(df: DataFrame, text: str, part: int = 64) -> DataFrame:
    """``df`` with ``lines``: ARRAY<STRUCT<start, value>> of the stripped non-blank lines with their code point offsets."""

    @F.arrow_udf("array<struct<start:int,value:string>>")
    def lines(texts: pa.Array) -> pa.Array:
        return _cut(texts, part)

    return df.withColumn("lines", lines.asNondeterministic()(F.col(text)))  # else it may be computed once for each use


# --- similarity, in basis points -------------------------------------------------


def basis(numerator: Column, denominator: Column) -> Column:
    n, d = numerator.cast("long"), denominator.cast("long")
    return F.when(d == 0, F.lit(10000)).otherwise(F.floor((n * 10000 + F.floor(d / 2)) / d)).cast("int")


#: Bytes of text whose pairs are compared at once.
PAIRS = 4 << 20


def _compared(score: Callable[[list[str], list[str]], np.ndarray]) -> Callable[[Column, Column], Column]:
    """An Arrow UDF of two texts; null where one of them is."""

    @F.arrow_udf(IntegerType())
    def compared(a: pa.Array, b: pa.Array) -> pa.Array:
        both = pc.and_(pc.is_valid(a), pc.is_valid(b))
        runs = np.cumsum(pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PAIRS
        cuts, out = [*np.flatnonzero(np.diff(runs, prepend=-1)).tolist(), len(a)], [pa.array([], pa.int32())]
        for i, j in zip(cuts, cuts[1:]):
            x, y = (pc.fill_null(c.slice(i, j - i), "").to_pylist() for c in (a, b))
            out.append(pa.array(score(x, y), pa.int32()))
        return pc.if_else(both, pa.concat_arrays(out), pa.scalar(None, pa.int32()))

    return lambda a, b: compared(a, b)


levenshtein = _compared(S.distances)
ratio = _compared(S.ratios)
#: Best ratio of the shorter text with windows of its length.
partial_ratio = _compared(S.partial_ratios)
token_sort_ratio = _compared(lambda a, b: S.token_sort_ratios(list(map(S.tokens, a)), list(map(lru_cache(8)(S.tokens), b))))
token_set_ratio = _compared(lambda a, b: S.token_set_ratios(list(map(S.tokens, a)), list(map(lru_cache(8)(S.tokens), b))))


def char_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    def score(a: list[str], b: list[str]) -> np.ndarray:
        grams = lru_cache(8)(S.grams)  # the sides that recur
        return S.jaccards((S.grams(x, n), grams(y, n)) for x, y in zip(a, b))

    return _compared(score)(a, b)


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased; each CJK ideograph on its own."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]"), F.lit(0)), F.lower)


WEIGHTS = {"ratio": 25, "partial_ratio": 20, "token_sort": 15, "token_set": 15, "char_jaccard": 25}
SCORES = {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "char_jaccard": char_jaccard}


def combined(scores: dict[str, Column], weights: dict[str, int]) -> Column:
    total = sum((scores[k] * w for k, w in weights.items()), F.lit(50))
    return F.floor(total / 100).cast("int")


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_AROUND = re.compile(" *([:|]) *")


def matching_view_of(text: str, normalise: bool = True, lower: bool = True, collapse: bool = True) -> str:
    """Form in which candidates and templates are compared."""
    v = text if not normalise or text.isascii() else unicodedata.normalize("NFKC", text)
    v = v if not lower else v.lower() if v.isascii() else v.translate(_ASCII_LOWER)
    v = " ".join(v.split()) if collapse else v
    return _AROUND.sub(r"\1", v) if collapse and (":" in v or "|" in v) else v


def matching_view(c: Column, normalise: bool = True, lower: bool = True, collapse: bool = True, part: int = 64) -> Column:
    """The same of a column, ``part`` texts at once."""

    @F.arrow_udf(StringType())
    def view(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(k, part).to_pylist() for k in range(0, max(1, len(texts)), part))
        return pa.concat_arrays([pa.array([None if x is None else matching_view_of(x, normalise, lower, collapse) for x in some], pa.string()) for some in parts])

    return view(c)


def changed_characters(a: Column, b: Column) -> Column:
    """Positions that differ, and the difference in length."""
    both = F.slice(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x != y), 1).otherwise(0)), F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b))))
    same = F.when(F.least(F.length(a), F.length(b)) == 0, 0).otherwise(F.aggregate(both, F.lit(0), lambda s, x: s + x))
    return (same + F.abs(F.length(a) - F.length(b))).cast("int")
