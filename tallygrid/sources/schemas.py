"""Column lists of the tables; the order is the order on disk."""

from pyspark.sql import types as T

from ..fixed import WEATHER_VIEW_COLUMNS

COUNT_KEYS = ["sensor_id", "date", "hour"]

COUNTS = T.StructType(
    [
        T.StructField("sensor_id", T.IntegerType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("hour", T.ByteType(), False),
        T.StructField("count", T.IntegerType(), False),
        T.StructField("source", T.StringType(), False),
    ]
)

WEATHER_HOURLY = T.StructType(
    [
        T.StructField("ts_utc", T.TimestampNTZType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("hour", T.ByteType(), False),
        *[T.StructField(name, T.DoubleType()) for name in WEATHER_VIEW_COLUMNS],
    ]
)

WEATHER_PAYLOAD = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    *[
                        T.StructField(name, T.ArrayType(T.DoubleType()))
                        for name in WEATHER_VIEW_COLUMNS
                    ],
                ]
            ),
        )
    ]
)

HOLIDAYS = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("holiday_name", T.StringType())]
)

TERMS = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("term", T.IntegerType()),
        T.StructField("start", T.DateType()),
        T.StructField("end", T.DateType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("start", T.DateType()),
        T.StructField("end", T.DateType()),
    ]
)
