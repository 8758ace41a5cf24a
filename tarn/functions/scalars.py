"""Scalar functions of the engine: scores, names, texts and paths, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
RRF_K = 60
NAME_BOOST = 0.25
BM25_SEED_WEIGHT = 0.65
#: How well a name matches a query token.
TIER_EXACT, TIER_PREFIX, TIER_SUBSTRING = 1.0, 0.9, 0.75
#: Multipliers of graph scores by chunk type; others count fully.
TYPE_MULTIPLIERS = {
    "function": 1.0, "method": 1.0, "class": 0.9, "interface": 0.8, "struct": 0.8,
    "trait": 0.8, "impl": 0.8, "enum": 0.5, "type": 0.4,
}
CONSTRUCTOR_MULTIPLIER = 0.2


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def saturation(frequency: Column, length: Column, average: Column) -> Column:
    return frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * length / average))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in double precision; 0 when the lengths differ or a vector is zero."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    bad = (F.size(a) != F.size(b)) | (na == 0) | (nb == 0)
    return F.when(bad, F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def boost_terms(query: Column) -> Column:
    """Words of a query that can boost a name: lower case, longer than one character."""
    return F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: F.length(t) > 1)


def name_boost(score: Column, name: Column, words: Column) -> Column:
    hits = F.size(F.filter(words, lambda t: F.contains(F.lower(name), t)))
    gain = F.when(F.size(words) > 0, NAME_BOOST * hits / F.size(words)).otherwise(0.0)
    return F.least(score + gain, F.lit(1.0))


def name_tier(name: Column, token: Column) -> Column:
    low, t = F.lower(name), F.lower(token)
    return F.when(low == t, TIER_EXACT).when(F.startswith(low, t), TIER_PREFIX).otherwise(TIER_SUBSTRING)


def name_like(name: Column, token: Column, escape: bool = False) -> Column:
    """Case-insensitive substring match; % and _ in the token are wildcards unless escaped."""
    pattern = F.lower(token)
    if escape:
        return F.contains(F.lower(name), pattern)
    return F.like(F.lower(name), F.concat(F.lit("%"), pattern, F.lit("%")))


def type_multiplier(chunk_type: Column, name: Column) -> Column:
    out = F.when((chunk_type == "method") & name.endswith(".constructor"), CONSTRUCTOR_MULTIPLIER)
    for kind, value in TYPE_MULTIPLIERS.items():
        out = out.when(chunk_type == kind, value)
    return out.otherwise(1.0)


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_dot_extension(path: Column) -> Column:
    """From the first dot of the file name on, lower case (scanner rule)."""
    return F.lower(F.regexp_extract(basename(path), r"(\..*)$", 1))


def last_dot_extension(path: Column) -> Column:
    """From the last dot on, case kept (parser rule)."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def preview(content: Column, lines: int) -> Column:
    return F.array_join(F.slice(F.split(content, "\n"), 1, lines), "\n")


def squeezed(text: Column) -> Column:
    """A signature on one line: runs of white space become one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_generics(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"<.*$", ""))


def breadcrumb(path: Column, chunk_type: Column, name: Column, parent: Column, signature: Column) -> Column:
    """The text that places a chunk: its file, its class, itself and its signature, a line each."""
    signature_line = F.when(F.coalesce(signature, F.lit("")) != "", F.concat(F.lit("Signature: "), signature))
    titles = {"class": "Class", "function": "Function", "interface": "Interface", "type": "Type"}
    own = F.when(chunk_type == "method", F.concat(F.lit("Method: "), name))
    for kind, title in titles.items():
        own = own.when(chunk_type == kind, F.concat(F.lit(f"{title}: "), name))
    own = own.otherwise(F.concat(chunk_type, F.lit(": "), name))
    of_class = F.when((chunk_type == "method") & parent.isNotNull(), F.concat(F.lit("Class: "), parent))
    signed = chunk_type.isin("method", "function")
    return F.concat_ws("\n", F.concat(F.lit("File: "), path), of_class, own, F.when(signed, signature_line))


def embedding_text(
    language: Column, chunk_type: Column, name: Column, content: Column, signature: Column, docstring: Column, parent: Column
) -> Column:
    """What is embedded: code of functions and methods as it is, a summary of anything else."""

    def line(title: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(title + ": "), value))

    summary = F.concat_ws(
        "\n",
        F.concat(language, F.lit(" "), chunk_type, F.lit(": "), name),
        line("Signature", signature),
        line("Description", docstring),
        line("Class", parent),
        F.concat(F.lit("Preview:\n"), F.trim(preview(content, 20))),
    )
    return F.when(chunk_type.isin("function", "method"), content).otherwise(summary)


def percent(done: Column, total: Column) -> Column:
    """Whole percent done, halves up, at most 100; 0 of nothing is 0."""
    part = F.floor(100.0 * done / total + 0.5)
    return F.when(total == 0, 0).otherwise(F.least(part, F.lit(100))).cast("int")


def _tenths(value: Column) -> Column:
    return F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10)


def readable_bytes(n: Column) -> Column:
    """Bytes as they are below a kilobyte, then with one decimal, halves up."""
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1024 ** (power + 1), F.concat(_tenths(n / 1024**power), F.lit(f" {unit}")))
    return out.when(n.isNotNull(), F.concat(_tenths(n / 1024**3), F.lit(" GB")))


def readable_duration(ms: Column) -> Column:
    """Milliseconds below a second, seconds with one decimal below a minute, then minutes and seconds."""
    minutes = F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), F.floor(ms / 1000 % 60).cast("string"), F.lit("s"))
    return (
        F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(_tenths(ms / 1000), F.lit("s")))
        .when(ms.isNotNull(), minutes)
    )
