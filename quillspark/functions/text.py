"""Text expressions with the semantics of Python's re and str, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def blank(c: Column) -> Column:
    """Whether there is nothing but white space."""
    return ~c.rlike(r"(?U)\S")


def last_group(text: Column, pattern: str, groups: int) -> Column:
    """The stripped text of the group that took part in the first match, or null."""
    return F.coalesce(*(F.nullif(strip(F.regexp_extract(text, pattern, g)), F.lit("")) for g in range(1, groups + 1)))


def first_of(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern, in the order given, that the text matches."""
    out = None
    for name, pattern in patterns:
        out = F.when(text.rlike(pattern), F.lit(name)) if out is None else out.when(text.rlike(pattern), F.lit(name))
    return out


def ordered_text(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str, name: str = "text") -> DataFrame:
    """Texts of a group joined in order; the order never depends on how rows arrive."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["__text"]), separator).alias(name))


def joined(text: str, order: str, separator: str) -> Column:
    """An aggregate of the texts of a group in order, nulls left out, '' where there is none."""
    literal = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return F.coalesce(F.expr(f"listagg(`{text}`, '{literal}') within group (order by `{order}`)"), F.lit(""))


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def preview(text: Column, n: int = 150) -> Column:
    return F.translate(F.substring(text, 1, n), "\n", " ")


def prompt_answer_only(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer based only on the context above."))


def prompt_instruct(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Instruct: Answer the question using only the context below.\nContext: "), context, F.lit("\nQuestion: "), question, F.lit("\nOutput:"))


def prompt_plain(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def continuation(decoded: Column, prompt: Column) -> Column:
    """What a model wrote after its prompt."""
    return strip(decoded.substr(F.length(prompt) + 1, F.length(decoded)))
