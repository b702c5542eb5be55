"""Records made fit for a log: secret fields masked, long texts and lists cut, by a walk over the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Names of fields whose value never stands in a log, and the bounds of what does.
SECRET = (
    "token", "apikey", "api_key", "authorization", "password", "passwordhash", "secret", "sessionsecret", "cookie",
    "telegrambottoken", "phone", "phonee164", "sellerphone", "chatid", "telegramchatid", "email", "contactemail",
)
MASK, TOO_DEEP = "[redacted]", "[diep genest]"
LONGEST_TEXT, LONGEST_LIST, DEEPEST = 500, 50, 5


def masked(value: Column, kind: DataType, depth: int = 0) -> Column:
    """The value with every secret field below it masked; null stays null, what lies too deep is named so.

    A masked field becomes a text. In a map a key's name decides row by row, so a map's values become texts:
    JSON where they weren't. All of it is one projection, made from the type alone.
    """
    if depth > DEEPEST:
        return F.when(value.isNotNull(), F.lit(TOO_DEEP))
    if isinstance(kind, StringType):
        return F.when(F.length(value) > LONGEST_TEXT, F.concat(F.substring(value, 1, LONGEST_TEXT), F.lit("…"))).otherwise(value)
    if isinstance(kind, ArrayType):
        return F.transform(F.slice(value, 1, LONGEST_LIST), lambda v: masked(v, kind.elementType, depth + 1))
    if isinstance(kind, StructType):
        fields = [(F.when(value.isNotNull(), F.lit(MASK)) if f.name.lower() in SECRET else masked(value.getField(f.name), f.dataType, depth + 1)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, MapType):
        inner = lambda v: masked(v, kind.valueType, depth + 1)
        plain = (lambda v: inner(v).cast("string")) if not isinstance(kind.valueType, (ArrayType, StructType, MapType)) or depth >= DEEPEST else (lambda v: F.to_json(inner(v)))
        return F.transform_values(value, lambda k, v: F.when(F.lower(k.cast("string")).isin(*SECRET), F.lit(MASK)).otherwise(plain(v)))
    return value


def for_log(rows: DataFrame) -> DataFrame:
    """Every column of the rows, masked by its name and type."""
    return rows.select(*((F.lit(MASK) if f.name.lower() in SECRET else masked(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in rows.schema.fields))
