"""Time split and one-hot encoding fitted on the training weeks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import schemas, session
from weekrank.operators import joins, ordered

MIN_WEEKS = 5


@dataclass(frozen=True)
class TimeSplit:
    """Last week of the training and of the validation span; later weeks are the test span."""

    train_until: object
    validate_until: object
    week: str = schemas.WEEK_TS

    def train(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.week) <= F.lit(self.train_until))

    def validation(self, df: DataFrame) -> DataFrame:
        return df.filter((F.col(self.week) > F.lit(self.train_until)) & (F.col(self.week) <= F.lit(self.validate_until)))

    def test(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.week) > F.lit(self.validate_until))

    def labelled(self, df: DataFrame) -> DataFrame:
        """All rows with their span in column `split`; rows without a week drop out."""
        week = F.col(self.week)
        span = F.when(week <= F.lit(self.train_until), "train").when(week <= F.lit(self.validate_until), "val").otherwise("test")
        return df.filter(week.isNotNull()).withColumn("split", span)


def time_split(df: DataFrame, week: str = schemas.WEEK_TS, train_share: float = 0.6, validation_share: float = 0.2,
               boundary: str = "exclusive") -> TimeSplit:
    """Cut the distinct weeks 60/20/20 in time order. Only the two cut weeks reach the driver.

    `exclusive` takes the first floor(n * share) weeks; `inclusive` takes the week at that position too.
    """
    weeks = df.select(week).dropna().distinct()
    n = weeks.count()
    if n < MIN_WEEKS:
        raise ValueError(f"not enough weeks to split: {n}")
    if boundary == "inclusive":
        train_at, validate_at = int(n * train_share), int(n * (train_share + validation_share))
    else:
        train_at = int(n * train_share) - 1
        validate_at = train_at + int(n * validation_share)

    def week_at(position: int):
        return weeks.orderBy(week).offset(position).limit(1).collect()[0][0]

    return TimeSplit(week_at(train_at), week_at(validate_at), week)


@dataclass(frozen=True)
class OneHot:
    """Fitted levels of one categorical column; each becomes a 0/1 column `prefix__level`."""

    column: str
    levels: tuple[str, ...]
    kept: tuple[str, ...]
    prefix: str

    @property
    def names(self) -> list[str]:
        return [f"{self.prefix}__{level}" for level in self.levels]

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Encode the rows the levels came from: rare levels count as `other`."""
        level = F.coalesce(F.col(self.column).cast("string"), F.lit("unknown"))
        level = F.when(level.isin(*self.kept), level).otherwise(F.lit("other")) if self.kept else F.lit("other")
        return self._encode(df, level)

    def transform(self, df: DataFrame) -> DataFrame:
        """Encode other rows: levels outside the fitted ones give zeros everywhere."""
        return self._encode(df, F.coalesce(F.col(self.column).cast("string"), F.lit("unknown")))

    def _encode(self, df: DataFrame, level) -> DataFrame:
        if self.column not in df.columns:
            return df
        return df.withColumns({name: (level == F.lit(value)).cast("int") for name, value in zip(self.names, self.levels)})


def fit_one_hot(df: DataFrame, column: str = "genre_bucket", min_freq: int = 20, prefix: str | None = "genre") -> OneHot:
    """Levels as named 0/1 columns, so their names reach the driver; `fit_levels` keeps many levels a table."""
    if column not in df.columns:
        return OneHot(column, (), (), prefix or column)
    levels = fit_levels(df, column, min_freq).collect()
    return OneHot(column, tuple(sorted({r["level"] for r in levels})), tuple(sorted(r["level"] for r in levels if r["own"])), prefix or column)


def fit_levels(df: DataFrame, column: str, min_freq: int = 20) -> DataFrame:
    """The fitted levels as a table (level, own, n) of any size, stored once; nothing reaches the driver.

    `own` is true for a frequent level. All rare ones together are one row `other` with `own` false. A frequent level
    that is itself called `other` is a row of its own.
    """
    level = F.coalesce(F.col(column).cast("string"), F.lit("unknown"))
    counts = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= max(1, int(min_freq))
    return session.cut(counts.groupBy(F.when(own, F.col("level")).otherwise("other").alias("level"), own.alias("own")).agg(F.sum("n").alias("n")))


def numbered_levels(levels: DataFrame) -> DataFrame:
    """(level, level_index): one number from 0 for every different level, in the order of the levels."""
    return ordered.running_number(levels.select("level").distinct(), ["level"], "level_index", -1)


def with_level(df: DataFrame, column: str, levels: DataFrame, fitting: bool, name: str = "level") -> DataFrame:
    """Adds the level that marks a row. Rare levels are `other` with `fitting` and null (all zeros) without it.

    Without `fitting` a value `other` meets a fitted level of that name, as for named columns.
    """
    known = levels.filter("own") if fitting else levels
    known = known.select(F.col("level").alias("_level")).distinct().withColumn("_found", F.col("_level"))
    value = F.coalesce(F.col(column).cast("string"), F.lit("unknown"))
    keys = df.columns
    joined = joins.lookup(df.withColumn("_level", value), session.cut(known), ["_level"], spread_by=keys)
    found = F.coalesce("_found", F.lit("other")) if fitting else F.col("_found")
    return joined.withColumn(name, found).drop("_level", "_found")


def level_vectors(df: DataFrame, column: str, levels: DataFrame, fitting: bool, output: str = "levels") -> DataFrame:
    """Adds one sparse vector a row with a 1 at the number of its level (`numbered_levels`), all zeros where it has none.

    There is no column per level and no list of levels in the driver: the vector comes from the level table by a join, and its
    column carries the size, but no names (`OneHotEncoder` writes the name of every level into the schema, which goes to the driver
    and to every task). The vector goes into `model.fit_logistic` like any other feature.
    """
    numbered = session.cut(numbered_levels(levels))
    n = numbered.count()
    vectors = session.cut(numbered.select("level", _unit_vector(n, F.concat(F.lit("["), F.col("level_index").cast("string"), F.lit("]")), F.lit("[1.0]")).alias("_vector")))
    # Stored: the second join counts its keys, which would run the first one again.
    marked = joins.lookup(session.cut(with_level(df, column, levels, fitting)), vectors, ["level"], spread_by=df.columns)
    vector = F.coalesce("_vector", _unit_vector(n, F.lit("[]"), F.lit("[]")))
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], vector.alias(output, metadata={"ml_attr": {"num_attrs": n}}))


def _unit_vector(size: int, indices: Column, values: Column) -> Column:
    """A sparse vector from the text of its lists."""
    text = F.concat(F.lit(f'{{"v":{{"type":0,"size":{size},"indices":'), indices, F.lit(',"values":'), values, F.lit("}}"))
    return F.from_json(text, T.StructType([T.StructField("v", VectorUDT())]))["v"]
