"""Person names from a user-given name table (replaces model inference).

Scripts written without spaces (Chinese, Japanese, Thai, ...) hold a name
wherever its characters stand together. Any other name occurs where its words
stand next to each other; words end at white space, at punctuation around
them, and where the two kinds of script meet. Names may have any length.

Matching is one equi-join on the *whole* name. The name table gives the
distinct lengths of its names, in words and in unspaced characters; a text
offers its n-grams of just those lengths. A Bloom filter of the names
(:func:`logweave.plans.bloom.maybe_among`, 16 MB at most) drops n-grams that
are no name before they are shuffled; the join decides about the others, so
each n-gram left that equals a name is a find, and the rows grow with the text
alone, whatever names begin alike. Texts go through in pieces of ``CHUNK``
words or characters that overlap by the longest name, so no row holds all
n-grams of a long text. Names and n-grams are dealt over ``SALTS`` keys, so a
name that stands in a third of all rows is no single key. The join is a
shuffled one: the name table, salted at that, is never sent to the driver.

The names found per row come back as ``array<string>`` for
:func:`logweave.operators.redact.redact` (``persons_col``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bloom import maybe_among

CHUNK = 512
SALTS = 8

_TOKEN_EDGE = r"(?U)^[\p{P}\p{S}]+|[\p{P}\p{S}]+$"
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{30FC}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_BORDER = rf"(?<=[{_UNSPACED}])(?=[^{_UNSPACED}])|(?<=[^{_UNSPACED}])(?=[{_UNSPACED}])"
_RUN = rf"[{_UNSPACED}]+"


def _words(text: Column) -> Column:
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), _BORDER, " ")
    toks = F.split(spaced, r"(?U)\s+", -1)
    return F.filter(F.transform(toks, lambda t: F.regexp_replace(t, _TOKEN_EDGE, "")), lambda t: F.length(t) > 0)


def _pieces(of: Column, size: Column, cut, longest: int) -> Column:
    """``of`` cut into overlapping pieces: every n-gram up to ``longest`` lies whole in the piece it starts in."""
    starts = F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(CHUNK))
    return F.explode(F.transform(starts, lambda i: cut(of, i, F.lit(CHUNK + longest - 1))))


def _grams(piece: Column, size: Column, gram, lengths: list[int]) -> Column:
    """The distinct n-grams of the wanted lengths that start in the first ``CHUNK`` places of a piece."""

    def of_length(n: int) -> Column:
        places = F.sequence(F.lit(1), F.least(size - n + 1, F.lit(CHUNK)))
        places = F.when(size >= n, places).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: gram(piece, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of_length(n) for n in lengths]))


def name_table(names: DataFrame, name_col: str = "name") -> DataFrame:
    """(name, form, unspaced, length): what a text must hold for each distinct name, and its length in characters or words."""
    nm = names.select(F.trim(F.col(name_col)).alias("name")).where(F.length("name") > 0).distinct()
    whole = F.col("name").rlike(rf"^{_RUN}$")
    nm = nm.select("name", whole.alias("unspaced"), F.when(~whole, _words(F.col("name"))).alias("words"))
    nm = nm.select(
        "name",
        F.when(F.col("unspaced"), F.col("name")).otherwise(F.array_join("words", " ")).alias("form"),
        "unspaced",
        F.when(F.col("unspaced"), F.length("name")).otherwise(F.size("words")).alias("length"),
    )
    return nm.where(F.col("length") > 0)


def person_names(
    df: DataFrame,
    names: DataFrame,
    key_cols: list[str],
    text_col: str = "text",
    name_col: str = "name",
    out_col: str = "persons",
) -> DataFrame:
    """Add ``out_col`` = distinct names from ``names`` that occur in ``text_col``, in order.

    ``key_cols`` must identify a row of ``df``.
    """
    nm = name_table(names, name_col)
    lengths = nm.groupBy("unspaced", "length").count().collect()  # one row per length of a name
    by_kind = {k: sorted(r["length"] for r in lengths if r["unspaced"] is k) for k in (True, False)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key_cols)])  # one column: null keys are equal, too
    offers = []
    if by_kind[False]:
        n = by_kind[False]
        rows = df.select(key.alias("__lw_key"), _words(text).alias("all"))
        rows = rows.select("__lw_key", _pieces(F.col("all"), F.size("all"), F.slice, n[-1]).alias("piece"))
        gram = lambda p, i, k: F.array_join(F.slice(p, i, k), " ")
        offers.append(rows.select("__lw_key", F.lit(False).alias("unspaced"), F.explode(_grams(F.col("piece"), F.size("piece"), gram, n)).alias("form")))
    if by_kind[True]:
        n = by_kind[True]
        rows = df.select(key.alias("__lw_key"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_RUN), 0))).alias("all"))
        rows = rows.select("__lw_key", _pieces(F.col("all"), F.length("all"), F.substring, n[-1]).alias("piece"))
        offers.append(rows.select("__lw_key", F.lit(True).alias("unspaced"), F.explode(_grams(F.col("piece"), F.length("piece"), F.substring, n)).alias("form")))
    if not offers:
        return df.withColumn(out_col, F.array().cast("array<string>"))
    offered = offers[0] if len(offers) == 1 else offers[0].unionByName(offers[1])
    offered = maybe_among(offered, nm, ["unspaced", "form"], sum(r["count"] for r in lengths))
    offered = offered.withColumn("salt", F.pmod(F.xxhash64("__lw_key"), F.lit(SALTS)).cast("int"))
    nm = nm.select("name", "form", "unspaced", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # Spark's estimate of the name table counts neither the salts nor what Parquet saves
    found = offered.join(nm.hint("merge"), ["unspaced", "form", "salt"]).groupBy("__lw_key").agg(F.sort_array(F.collect_set("name")).alias("__lw_found"))
    out = df.join(found, key == F.col("__lw_key"), "left")
    return out.withColumn(out_col, F.coalesce("__lw_found", F.array().cast("array<string>"))).drop("__lw_found", "__lw_key")
