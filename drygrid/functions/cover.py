"""Land-cover codes: first-level class, names and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Land-cover code -> (name, colour).
COVER = {
    0: ("Unknown", "#282828"),
    20: ("Shrubs", "#FFBB22"),
    30: ("Herbaceous vegetation", "#FFFF4C"),
    40: ("Cultivated and managed vegetation/agriculture", "#F096FF"),
    50: ("Urban", "#FA0000"),
    60: ("Bare", "#B4B4B4"),
    70: ("Snow and ice", "#F0F0F0"),
    80: ("Permanent water bodies", "#0032C8"),
    90: ("Herbaceous wetland", "#0096A0"),
    100: ("Moss and lichen", "#FAE6A0"),
    111: ("Closed forest, evergreen needle leaf", "#58481F"),
    112: ("Closed forest, evergreen broad leaf", "#009900"),
    113: ("Closed forest, deciduous needle leaf", "#70663E"),
    114: ("Closed forest, deciduous broad leaf", "#00CC00"),
    115: ("Closed forest, mixed", "#4E751F"),
    116: ("Closed forest, not matching any of the others", "#007800"),
    121: ("Open forest, evergreen needle leaf", "#666000"),
    122: ("Open forest, evergreen broad leaf", "#8DB400"),
    123: ("Open forest, deciduous needle leaf", "#8D7400"),
    124: ("Open forest, deciduous broad leaf", "#A0DC00"),
    125: ("Open forest, mixed", "#929900"),
    126: ("Open forest, not matching any of the others", "#648C00"),
    200: ("Oceans, seas", "#000080"),
}
# First-level code -> (name, colour).
LEVEL1 = {
    0: ("Unknown", "#282828"),
    11: ("Closed forest", "#58481F"),
    12: ("Open forest,", "#666000"),
    20: ("Shrubland", "#FFBB22"),
    30: ("Herbaceous vegetation", "#FFFF4C"),
    40: ("Cropland", "#F096FF"),
    50: ("Built-up", "#FA0000"),
    60: ("Bare sparse vegetation", "#B4B4B4"),
    70: ("Snow and ice", "#F0F0F0"),
    80: ("Permanent water bodies", "#0032C8"),
    90: ("Herbaceous wetland", "#0096A0"),
    100: ("Moss and lichen", "#FAE6A0"),
    200: ("Oceans, seas", "#000080"),
}
WATER = (80, 200)
NOT_LAND = (0, 70, 80, 200)


def level_1(code: Column) -> Column:
    """Forest sub-classes 111-116 to 11 and 121-126 to 12; every other code unchanged."""
    return F.when(code.between(111, 116), F.lit(11)).when(code.between(121, 126), F.lit(12)).otherwise(code)


def is_water(level1: Column) -> Column:
    return level1.isin(*WATER)


def _lookup(table: dict[int, tuple[str, str]], code: Column, part: int) -> Column:
    entries = F.create_map(*[F.lit(x) for key, pair in table.items() for x in (key, pair[part])])
    return F.try_element_at(entries, code.cast("int"))


def description(code: Column, first_level: bool = False, one_forest: bool = False) -> Column:
    name = _lookup(LEVEL1 if first_level else COVER, code, 0)
    return F.when(code.isin(11, 12), F.lit("Forest")).otherwise(name) if one_forest else name


def colour(code: Column, first_level: bool = False) -> Column:
    return _lookup(LEVEL1 if first_level else COVER, code, 1)


def levels(cover: DataFrame, code: str = "code", first_level: bool = True, one_forest: bool = False) -> DataFrame:
    """Classes present, sorted, with name and colour. At most one row per known code."""
    key = level_1(F.col(code)) if first_level else F.col(code)
    if first_level and one_forest:
        key = F.when(key == 12, F.lit(11)).otherwise(key)
    return (
        cover.where(F.col(code).isNotNull())
        .select(key.cast("int").alias("level"))
        .distinct()
        .withColumn("description", description(F.col("level"), first_level, first_level and one_forest))
        .withColumn("colour", colour(F.col("level"), first_level))
        .orderBy("level")
    )


def cover_table(spark: SparkSession) -> DataFrame:
    """Fixed table of every code with its first-level class."""
    rows = [(k, name, tint) for k, (name, tint) in COVER.items()]
    return spark.createDataFrame(rows, "code int, name string, colour string").withColumn("level1", level_1(F.col("code")))
