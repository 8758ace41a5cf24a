"""The code tokenizer as column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiters between tokens (underscore is none of them).
DELIMITERS = r"""[\s.,;:!?(){}\[\]<>'"/\\|@#$%^&*+=`~-]+"""
#: Camel-case boundaries, applied one after the other.
BOUNDARIES = (r"([a-z])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([0-9])([A-Z])")
#: Where any of them stands; a token without one is its own only part.
BOUNDARY = "[a-z][A-Z]|[A-Z][A-Z][a-z]|[0-9][A-Z]"
MIN_LENGTH, MAX_LENGTH = 2, 50
#: Words that are never terms.
STOP_WORDS = (
    "a abstract an and are as assert async at await be boolean break but by byte can case catch char class cls const "
    "continue could declare def default del do double else enum except export extends false final finally float for "
    "from function get global had has if implements import in instanceof int interface into is it lambda let long may "
    "might must namespace new none nonlocal not null of on or package pass private protected public raise readonly "
    "return self set short should static super switch synchronized than that the this throw throws to transient true "
    "try type typeof var void volatile was were while will with would yield"
).split()


def tokens(text: Column) -> Column:
    """Delimiter-separated tokens of a text, in order (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), DELIMITERS), lambda t: t != "")


def camel_parts(token: Column) -> Column:
    for pattern in BOUNDARIES:
        token = F.regexp_replace(token, pattern, "$1 $2")
    return F.split(token, " ")


def is_term(term: Column) -> Column:
    # Only what begins with a digit meets the pattern.
    number = (term >= "0") & (term < ":") & term.rlike("^[0-9]+$")
    return F.length(term).between(MIN_LENGTH, MAX_LENGTH) & ~term.isin(*STOP_WORDS) & ~number


def is_whole(token: Column) -> Column:
    """Without a boundary: the token emits itself in lower case and nothing else."""
    return (token == F.lower(token)) | ~token.rlike(BOUNDARY)


def words(text: Column) -> Column:
    """The tokens of a text (null: none), empty ones among them, and after them all that those that aren't whole emit."""
    text = F.coalesce(text, F.lit(""))
    found = F.split(text, DELIMITERS)
    cut_up = F.flatten(F.transform(F.filter(found, lambda t: ~is_whole(t)), emitted))
    return F.when(text.rlike(BOUNDARY), F.concat(found, cut_up)).otherwise(found)


def emitted(token: Column) -> Column:
    """Lower-cased parts, adjacent pairs, and the whole token unless it is the first part.

    A token without capitals has no boundary, and few capitals make one, so most skip the replacements.
    """
    parts = camel_parts(token)
    whole = F.lower(token)
    pairs = F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.lower(F.concat(parts[i], parts[i + 1]))
        ),
    ).otherwise(F.array().cast("array<string>"))
    last = F.when(whole != F.lower(parts[0]), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.when(is_whole(token), F.array(whole)).otherwise(F.concat(F.transform(parts, F.lower), pairs, last))


def terms(text: Column) -> Column:
    """All terms of a text in order, repeats kept."""
    return F.filter(F.flatten(F.transform(tokens(text), emitted)), is_term)


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term): the distinct terms of each query; how often one repeats is ignored."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
