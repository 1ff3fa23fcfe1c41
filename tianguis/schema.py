"""Record types as Spark schemas, and the coercions that bring loose records into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBSERVATION = (
    "observation_id string, source_id string, source_name string, url string, listing_id string, title string, description string, "
    "brand string, seller string, province string, municipality string, price double, currency string, quantity double, unit string, "
    "pack_count int, availability string, condition string, image_id string, captured_at timestamp, published_at timestamp, raw string"
)
TARGET = (
    "target_id string, name string, brand string, model string, variant string, quantity double, unit string, pack_count int, condition string, "
    "keywords array<string>, exclude_keywords array<string>, provinces array<string>"
)
RATE = "from_currency string, to_currency string, rate double, as_of timestamp, source string"
SOURCE_STATUS = (
    "source_id string, source_name string, status string, error string, fetched_at timestamp, observations_returned int, "
    "source_ids_returned array<string>, discarded_by_prefilter int"
)

# Match levels from worst to best.
MATCH_LEVELS = ["NO_MATCH", "LOW", "MEDIUM", "HIGH", "EXACT"]


def clean_string(c: Column) -> Column:
    """Trimmed; empty counts as null."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def loose_double(c: Column) -> Column:
    """A number from text in either decimal style; null where there is none.

    With both marks the last one is the decimal mark and the other one groups; a lone comma
    or point is the decimal mark; several points are no number. Digit groups may be joined by
    single underscores.
    """
    s = F.regexp_replace(F.trim(c.cast("string")), " ", "")
    comma, point = s.contains(","), s.contains(".")
    last_comma = F.length(s) - F.instr(F.reverse(s), ",")
    last_point = F.length(s) - F.instr(F.reverse(s), ".")
    plain = (
        F.when(comma & point & (last_comma > last_point), F.translate(F.replace(s, F.lit("."), F.lit("")), ",", "."))
        .when(comma & point, F.replace(s, F.lit(","), F.lit("")))
        .when(comma, F.translate(s, ",", "."))
        .otherwise(s)
    )
    number = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"
    return F.when(plain.rlike(number), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def loose_int(c: Column) -> Column:
    """A whole number, or null."""
    v = loose_double(c)
    return F.when(v == F.floor(v), v.try_cast("int"))


def loose_timestamp(c: Column) -> Column:
    """ISO 8601 with Z or an offset, UTC without one; null where it isn't one."""
    return F.try_to_timestamp(clean_string(c))


def as_observations(records: DataFrame, default_source: str = "desconocida") -> DataFrame:
    """Loose records, one column a field, as observations with ``row_uid``.

    Missing columns are null, the title falls back to ``product``, the source to
    ``default_source`` and the id to ``{source}:{row}``. ``raw`` keeps the record as JSON
    unless there already is one. Columns that are not fields are only in ``raw``.
    """
    have = set(records.columns)

    def field(name):
        return F.col(name) if name in have else F.lit(None).cast("string")

    columns = []
    for part in OBSERVATION.split(", "):
        name, kind = part.split(" ")
        if name == "raw":
            value = field("raw").cast("string") if "raw" in have else F.to_json(F.struct(*[F.col(c) for c in records.columns]))
        elif name == "title":
            value = F.coalesce(clean_string(field("title")), clean_string(field("product")), F.lit(""))
        elif name == "source_id":
            value = F.coalesce(clean_string(field(name)), F.lit(default_source))
        else:
            value = {"double": loose_double, "int": loose_int, "timestamp": loose_timestamp}.get(kind, clean_string)(field(name))
            if kind == "timestamp" and name in have and dict(records.dtypes)[name] == "timestamp":
                value = F.col(name)
        columns.append(value.alias(name))
    uid = F.col("row_uid").cast("long") if "row_uid" in have else F.monotonically_increasing_id()
    out = records.select(*columns, uid.alias("row_uid"))
    return out.withColumn("observation_id", F.coalesce("observation_id", F.concat_ws(":", "source_id", F.col("row_uid").cast("string"))))
