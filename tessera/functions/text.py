"""Terms, digests, snippets and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOPWORDS = ["a", "all", "an", "by", "do", "for", "from", "how", "in", "is", "of", "on", "one", "place", "the", "through", "to", "we", "what", "where", "which"]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: Column) -> Column:
    """The distinct terms of ``text`` in order: parted at non-alphanumerics and where a capital follows a small letter,
    without stopwords and single characters, plurals made singular."""
    split = F.split(F.lower(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")), r"[^a-z0-9]+")
    long_enough = F.filter(split, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))
    singular = F.transform(
        long_enough,
        lambda t: F.when((F.length(t) > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y"))).when((F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t),
    )
    return F.coalesce(F.array_distinct(F.filter(singular, lambda t: ~t.isin(*STOPWORDS))), F.array().cast("array<string>"))


def stable_digest(*parts: Column) -> Column:
    """SHA-256 over the parts, each ended by a zero byte; a null part counts as empty."""
    ended = [x for p in parts for x in (F.encode(F.coalesce(p, F.lit("")), "UTF-8"), F.unhex(F.lit("00")))]
    return F.sha2(F.concat(*ended), 256)


def symbol_id(repo: Column, path: Column, kind: Column, container: Column, name: Column, signature: Column) -> Column:
    """``sym.<kind>.<name with _ for odd characters>.<12 digits>``."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9]", "_")
    clean = F.when(clean == "", "anon").otherwise(clean)
    digest = F.sha2(F.concat_ws("\n", repo, path, kind, F.coalesce(container, F.lit("-")), name, signature), 256)
    return F.concat(F.lit("sym."), kind, F.lit("."), clean, F.lit("."), F.substring(digest, 1, 12))


def token_estimate(text: Column) -> Column:
    """The number of runs of non-blank characters."""
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))


def snippet(text: Column, lines: int = 4, most: int = 200) -> Column:
    """The first non-blank lines, trimmed and joined by a space, cut at ``most`` characters with ``...``."""
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " "))), lambda x: x != "")
    joined = F.array_join(F.slice(kept, 1, lines), " ")
    return F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most), F.lit("..."))).otherwise(joined)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity_score(a: Column, b: Column) -> Column:
    """Cosine similarity as an integer from 0 to 1,000,000; 0 where a vector has no length."""
    denominator = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cosine = F.greatest(F.least(dot(a, b) / denominator, F.lit(1.0)), F.lit(-1.0))
    return F.when(denominator <= 1.1920929e-07, F.lit(0).cast("bigint")).otherwise(F.round((cosine + 1) * 500000).cast("bigint"))


def normalised_vector(vector: Column) -> Column:
    """``vector`` at length 1, in double precision; one of length 0 stays as it is."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 1e-12, F.transform(v, lambda x: x / norm)).otherwise(v)


def chunk_text(sections: dict[str, Column]) -> Column:
    """The text of a chunk: one labelled section for each column that is not null, parted by blank lines, with line feeds alone as line ends."""
    said = [F.concat(F.lit(f"{label}:\n"), F.regexp_replace(c, r"\r\n?", "\n")) for label, c in sections.items()]
    return F.concat_ws("\n\n", *said)


def backing_file(target: Column) -> Column:
    """The file that a route, setting or interface stands in: what comes before ``#``."""
    return F.substring_index(target, "#", 1)


def test_relevance(is_test: Column, evidence: Column, affine: Column) -> Column:
    """The rank of a hit among tests, the most relevant first; what is no test has 0."""
    told = F.when(evidence == "references_symbol", 0).when(evidence == "imports_file", 1)
    return F.when(~is_test, 0).when(affine, 3).otherwise(F.coalesce(told, F.when(evidence.isNull(), 1).otherwise(2)))


test_relevance.__test__ = False
