"""What may be released: classifications, redaction, safe profiles, small cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels of classification, lowest first.
LEVELS = ["public", "internal", "confidential", "restricted"]


def highest(levels: list[str], taxonomy: list[str] = LEVELS) -> str:
    """The join of classifications: the highest; the lowest there is without any."""
    return max(levels, key=taxonomy.index, default=taxonomy[0])


def derived_level(inputs: list[str], explicit: str | None = None, taxonomy: list[str] = LEVELS) -> str:
    """What a value made from others is: as high as the highest input, or higher if it is said so, never lower."""
    return highest([*inputs, *([explicit] if explicit else [])], taxonomy)


def level_column(columns: list[Column], taxonomy: list[str] = LEVELS) -> Column:
    """The highest of several columns that hold levels; nulls and unknown levels count as the highest there is."""
    ranks = F.array(*map(F.lit, taxonomy))
    rank = lambda c: F.when(F.array_contains(ranks, c), F.array_position(ranks, c)).otherwise(len(taxonomy)).cast("int")
    made = [F.coalesce(rank(c), F.lit(len(taxonomy))) for c in columns]
    return F.element_at(ranks, F.greatest(*made) if len(made) > 1 else made[0])


def redact(df: DataFrame, levels: dict[str, str], at: str, mark: str = "***", taxonomy: list[str] = LEVELS) -> DataFrame:
    """df with the values of columns of that level or higher replaced: text by the mark, anything else by null. Nulls stay."""
    hidden = {c for c, level in levels.items() if taxonomy.index(level) >= taxonomy.index(at)}
    kinds = dict(df.dtypes)
    cell = lambda c: F.when(F.col(c).isNotNull(), F.lit(mark)) if kinds[c] == "string" else F.lit(None).cast(kinds[c])
    return df.select(*[cell(c).alias(c) if c in hidden else F.col(c) for c in df.columns])


def safe_profile(profile: DataFrame, levels: dict[str, str], at: str = "confidential", taxonomy: list[str] = LEVELS) -> DataFrame:
    """A column profile without what tells values of sensitive columns: least, greatest, and the quantiles at the ends.

    Columns that have no level count as sensitive.
    """
    open_ = [c for c, level in levels.items() if taxonomy.index(level) < taxonomy.index(at)]
    tell = [c for c in profile.columns if c in ("min", "max", "value", "top", "p01", "p99", "minimum", "maximum", "examples")]
    keep = F.col("column").isin(open_) if open_ else F.lit(False)
    return profile.select(*[F.when(keep, F.col(c)).alias(c) if c in tell else F.col(c) for c in profile.columns])


def leaks(document: object, most: int = 20, path: str = "$") -> list[str]:
    """Places of a profile document that look like raw values: long lists of texts, and texts that look like addresses or numbers of persons."""
    import re

    out = []
    if isinstance(document, dict):
        for k, v in document.items():
            out += leaks(v, most, f"{path}.{k}")
    elif isinstance(document, list):
        if sum(isinstance(v, str) for v in document) > most:
            out.append(f"{path}: {len(document)} texts")
        for k, v in enumerate(document):
            out += leaks(v, most, f"{path}[{k}]")
    elif isinstance(document, str) and re.search(r"[^@\s]+@[^@\s]+\.[^@\s]+|\b\d{3}-\d{2}-\d{4}\b|\b(?:\d[ -]?){13,19}\b", document):
        out.append(f"{path}: a personal value")
    return out


def release_decision(levels: dict[str, str], target: str, cohort: int, least: int, taxonomy: list[str] = LEVELS) -> dict[str, str]:
    """Per column what a release to a target may carry: value; aggregate, of columns above the target, if the smallest group
    is large enough; withheld."""
    return {c: "value" if taxonomy.index(level) <= taxonomy.index(target) else "aggregate" if cohort >= least and level != taxonomy[-1] else "withheld" for c, level in levels.items()}


def suppress_joint(cells: DataFrame, n: str, k: int) -> DataFrame:
    """Cells of a joint table that hold k rows or more; the others go, whatever their margins."""
    return cells.where(F.col(n) >= k)


def rare_categories(df: DataFrame, column: str, threshold: int) -> DataFrame:
    """Values that fewer rows than the threshold have, which a summary with them would give away: value, n."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).where(F.col("n") < threshold)


def suppress_column(df: DataFrame, column: str, k: int, mark: str = "(suppressed)") -> DataFrame:
    """df with a column's values that fewer than k rows have replaced; counted per value first."""
    rare = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")).where(F.col("_n") < k).select("_v", F.lit(True).alias("_rare"))
    return df.join(rare, F.col(column) == F.col("_v"), "left").withColumn(column, F.when(F.col("_rare"), F.lit(mark)).otherwise(F.col(column))).select(*df.columns)
