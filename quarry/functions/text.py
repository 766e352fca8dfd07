"""Identifiers, terms and text shaping, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The identifier and camel-case patterns, the names too common to search for.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{1,63}"
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"
STOP_NAMES = (
    "self this super cls len str int float bool dict list set tuple print range open type object "
    "get set add put pop push append extend update keys values items join split strip format map "
    "filter reduce sort sorted min max sum any all abs next iter isinstance hasattr getattr setattr "
    "log info debug warn warning error exception then catch resolve reject require new return "
    "string number boolean console window document toString valueOf equals hashCode length size"
).split()


def identifiers(text: Column) -> Column:
    """Array of the identifiers of a text, in order, with repeats."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))


def split_identifier(name: Column) -> Column:
    """parseHTTPRequest_v2 -> [parse, http, request, v, 2]."""
    return F.transform(F.regexp_extract_all(name, F.lit(CAMEL), F.lit(0)), F.lower)


def with_parts(name: Column, shortest: int) -> Column:
    """A name in lower case, then its parts of ``shortest`` characters or more, if it has several."""
    parts = split_identifier(name)
    own = F.filter(parts, lambda p: F.char_length(p) >= shortest)
    return F.concat(F.array(F.lower(name)), F.when(F.size(parts) > 1, own).otherwise(F.array().cast("array<string>")))


def _until(groups: Column, limit: int) -> Column:
    """Distinct terms of the groups, group by group until there are ``limit``; the last group counts
    whole, so there may be a few more. A group whose first term is there already is passed over."""
    empty = F.array().cast("array<string>")

    def step(seen: Column, group: Column) -> Column:
        done = (F.size(seen) >= limit) | F.array_contains(seen, F.get(group, F.lit(0)))
        return F.when(done, seen).otherwise(F.array_distinct(F.concat(seen, group)))

    return F.aggregate(groups, empty, step)


#: Names whose parts a worker remembers.
REMEMBERED = 1 << 17


def _terms_udf(limit: int, split: bool):
    """The rule of ``identifier_terms``, text by text; with ``split``, terms are cut at underscores."""

    def terms(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, parts_of, groups = re.compile(IDENTIFIER), re.compile(CAMEL), {}
        for column in texts:
            out = []
            for x in column.to_pylist():
                seen: dict[str, None] = {}
                for name in dict.fromkeys(names.findall(x or "")):
                    own = groups.get(name)
                    if own is None:
                        parts = [p.lower() for p in parts_of.findall(name)]
                        own = [name.lower(), *(p for p in parts if len(p) > 1 and len(parts) > 1)]
                        if len(groups) < REMEMBERED:
                            groups[name] = own
                    if own[0] not in seen:
                        seen.update(dict.fromkeys(own))
                        if len(seen) >= limit:
                            break
                out.append([p for t in seen for p in t.split("_") if p] if split else list(seen))
            yield pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(terms, "array<string>")


def identifier_terms(text: Column, limit: int = 400) -> Column:
    """Ordered distinct identifiers and their parts, for indexing: name by name until there are
    ``limit``; the last one counts whole, one whose first term is there already is passed over."""
    return _terms_udf(limit, False)(text)


def identifier_tokens(text: Column, limit: int = 400) -> Column:
    """The full-text tokens of ``identifier_terms``, in order."""
    return _terms_udf(limit, True)(text)


def query_terms(text: Column, limit: int = 24) -> Column:
    """Ordered distinct search terms: no stop names, parts of three characters or more."""
    stop = F.array(*[F.lit(s) for s in STOP_NAMES])
    names = F.filter(F.array_distinct(identifiers(text)), lambda x: ~F.array_contains(stop, F.lower(x)))
    keep = lambda g: F.filter(g, lambda t: ~F.array_contains(stop, t))
    return _until(F.transform(names, lambda x: keep(with_parts(x, 3))), limit)


def index_tokens(text: Column) -> Column:
    """Full-text tokens: lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def dotted_names(text: Column) -> Column:
    """Names like a.b.c of three characters or more."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+"), F.lit(0)), lambda x: F.char_length(x) >= 3)


def numbered_lines(text: Column) -> Column:
    """Array of lines, each after its right-aligned number."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 5, " "), F.lit("  "), x))


def collapsed(text: Column, most: int = 240) -> Column:
    """White space collapsed, clipped."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def clipped(text: Column, most: int = 2400, mark: str = "\n... [clipped]") -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def card(header: Column, text: Column, most: int = 600) -> Column:
    """Header and non-blank lines, clipped: what an embedder reads."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.char_length(F.trim(x)) > 0)
    return F.substring(F.concat_ws("\n", header, F.array_join(lines, "\n")), 1, most)


def card_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def question_key(text: Column) -> Column:
    """Dedupe key of a question: letters' case and white space don't count."""
    return F.substring(F.sha1(F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))), 1, 16)


def json_object(reply: Column) -> Column:
    """The text from the first { to the last } of a reply, without code fences; null if none."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def slug(name: Column) -> Column:
    """Last path segment, dots to dashes, lower case."""
    return F.lower(F.replace(F.element_at(F.split(name, "/"), -1), F.lit("."), F.lit("-")))


def l2_normalized(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-9)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
