"""Claims of an answer that can be checked literally: code, versions, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a literal that counts. Fixed value.
LONGEST = 64
_CODE = r"```([\s\S]*?)```|```[\s\S]*$|`([^`]*)`"
#: A version with a v, and a number with its signs: from a digit that is no part of a word or number before it.
_PARTS = r"[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*"
_VERSION = rf"(?<![\p{{L}}\p{{N}}_.+-])[vV][0-9]+(?:\.[0-9]+)+(?:-{_PARTS}(?:\+{_PARTS})?|\+{_PARTS})?(?:(?=\.(?:$|[\s)\]}}>'\"`]))|(?![\p{{L}}\p{{N}}_.+-]))"
_NUMBER = r"(?:(?<![\p{L}\p{N}_./%+:-])|(?<=(?:^|[^0-9.:/+-]):)|(?<![\p{L}\p{N}_])[+-])[0-9][0-9.:/+%-]*+(?![\p{L}\p{N}_])"


def code_literals(text: Column) -> Column:
    """A struct of ``inline`` code and of ``fenced`` lines, each once, in order; what isn't closed ends the search."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CODE), F.lit(0))
    fence = F.lit("```")
    inline = F.transform(F.filter(found, lambda m: ~F.startswith(m, fence)), lambda m: F.trim(F.regexp_replace(m, "^`|`$", "")))
    bodies = F.transform(F.filter(found, lambda m: F.startswith(m, fence) & F.endswith(m, fence) & (F.length(m) >= 6)), lambda m: F.substring(m, F.lit(4), F.length(m) - 6))
    # what stands on the fence's own line names the language
    lines = F.flatten(F.transform(bodies, lambda b: F.slice(F.split(b, "\n"), F.lit(2), F.greatest(F.size(F.split(b, "\n")) - 1, F.lit(0)))))
    kept = lambda parts: F.array_distinct(F.filter(parts, lambda x: x != ""))
    return F.struct(kept(inline).alias("inline"), kept(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\r+$", "")))).alias("fenced"))


def exact_claims(text: Column) -> Column:
    """An array of (literal, kind): versions, dates and numbers, each once, in order; the numbers of a list are none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s*[0-9]+[.)](?:\s+|$)", ""))
    tokens = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r"\s+"))), lambda t: t.rlike("[0-9]"))

    def of_token(token: Column) -> Column:
        found = F.regexp_extract_all(token, F.lit(f"{_VERSION}|{_NUMBER}"), F.lit(0))
        cut = F.transform(found, lambda m: F.when(m.rlike("^[vV]"), m).otherwise(F.regexp_replace(m, r"[.:/+-]+$", "")))
        return F.filter(cut, lambda m: F.octet_length(m) <= LONGEST)

    literals = F.array_distinct(F.flatten(F.transform(tokens, of_token)))
    date = lambda m: m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(m, "yyyy-MM-dd").isNotNull()
    kind = lambda m: F.when(m.rlike("^[vV]"), "prefixed_version").when(date(m), "iso_date").otherwise("numeric")
    return F.transform(literals, lambda m: F.struct(m.alias("literal"), kind(m).alias("kind")))


def claims(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, literal, kind)``: every claim of every answer; code counts as it is written."""
    text = F.col(text_col)
    code = code_literals(text)
    typed = lambda parts, kind: F.transform(parts, lambda x: F.struct(x.alias("literal"), F.lit(kind).alias("kind")))
    every = F.concat(typed(code["inline"], "code"), typed(code["fenced"], "fence"), exact_claims(text))
    return answers.select(id_col, F.explode(every).alias("c")).select(id_col, "c.literal", "c.kind")


def verification_states(answers: DataFrame, checked: DataFrame, verbatim: DataFrame, conflicting: DataFrame, id_col: str = "query_id") -> DataFrame:
    """``(id, literals, supported, state)`` of every answer.

    ``checked``: (id, literal, supported); ``verbatim``: ids of answers that stand in their evidence word for word; ``conflicting``: ids
    whose evidence contradicts itself.  An unsupported literal is insufficient evidence, then conflicts count, then a verbatim answer is
    verified; supported literals alone are partial support, and without any the check did not run.
    """
    counts = checked.groupBy(id_col).agg(F.count("*").alias("literals"), F.count_if("supported").alias("supported"))
    flag = lambda df, name: df.select(id_col).distinct().withColumn(name, F.lit(True))
    known = answers.select(id_col).distinct().join(counts, id_col, "left").na.fill(0, ["literals", "supported"])
    known = known.join(flag(verbatim, "_v"), id_col, "left").join(flag(conflicting, "_c"), id_col, "left")
    state = (
        F.when(F.col("supported") < F.col("literals"), "insufficient_evidence").when(F.col("_c"), "conflicting").when(F.col("_v"), "verified")
        .when(F.col("supported") > 0, "partially_supported").otherwise("not_run")
    )
    return known.select(id_col, "literals", "supported", state.alias("state"))
