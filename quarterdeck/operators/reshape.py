"""Moving between long and wide, stacking, and key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.functions.cells import Cell

KEY = ("ticker", "concept", "end")


def to_long(df: DataFrame, value: str, concept: str) -> DataFrame:
    return df.select("ticker", "end", F.col(value).alias("value"), F.lit(concept).alias("concept"))


def add_as_concept(facts: DataFrame, df: DataFrame, value: str, concept: str) -> DataFrame:
    return facts.unionByName(to_long(df, value, concept), allowMissingColumns=True)


def unpivot_states(wide: DataFrame, concepts: Sequence[str] | Mapping[str, str],
                   keys: Sequence[str] = ("ticker", "end")) -> DataFrame:
    """Encoded wide columns back to long rows; absent cells give no row."""
    names = concepts if isinstance(concepts, Mapping) else {c: c for c in concepts}
    cells = ", ".join(f"named_struct('concept', '{concept}', '_state', `{column}`)"
                      for column, concept in names.items())
    rows = wide.select(*keys, F.expr(f"inline(array({cells}))"))
    state = Cell.of("_state")
    return rows.filter(state.exists).select(*keys, "concept", state.value.alias("value"))


def unpivot_values(wide: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("ticker", "end"),
                   keep_null: bool = True) -> DataFrame:
    cells = ", ".join(f"named_struct('concept', '{c}', 'value', double(`{c}`))" for c in columns)
    long = wide.select(*keys, F.expr(f"inline(array({cells}))"))
    return long if keep_null else long.filter(F.col("value").isNotNull())


def pivot_mean(long: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """Long to wide by mean; a period without any value does not appear."""
    return (long.filter(F.col("concept").isin(*concepts) & F.col("value").isNotNull())
            .groupBy("ticker", "end")
            .agg(*[F.avg(F.when(F.col("concept") == c, F.col("value"))).alias(c)
                   for c in concepts]))


def duplicates(facts: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return (facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def duplicate_warning(facts: DataFrame) -> DataFrame:
    """One row: number of rows with a repeated key and whether that is worth a warning."""
    return duplicates(facts).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("duplicate_rows")
    ).withColumn("warn", F.col("duplicate_rows") > K.DUPLICATE_WARNING_ROWS)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in an explicit order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_place", F.row_number().over(window))
            .filter(F.col("_place") == 1).drop("_place"))


def base_concept(concept: Column | str) -> Column:
    """Concept name without its derivation suffixes."""
    return F.regexp_replace(concept, r"(?<=.)(_CALC|_TTM|_QUARTERLY)+$", "")


def is_quality_flag(concept: Column) -> Column:
    return concept.endswith("_flag") | concept.isin(*K.FLAGS_WITHOUT_SUFFIX)


def price_summary(snapshot: DataFrame) -> DataFrame:
    fields = ("price", "shares_outstanding", "market_cap")
    rows = snapshot.filter(F.col("concept").isin(*fields) & F.col("value").isNotNull())
    return rows.groupBy("ticker").agg(*[
        F.avg(F.when(F.col("concept") == f, F.col("value"))).alias(f) for f in fields])
