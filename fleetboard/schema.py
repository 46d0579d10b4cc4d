"""The star schema: one fact (trip) and two dimensions (boat, driver)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# The 0/1 check columns with the label each one is shown under.
SAFETY_CHECKS = {
    "checklifevest": "Life Vest",
    "checklifevestchildren": "Children Vest",
    "checkfireextandsand": "Fire Ext.",
    "checktrashbin": "Trash Bin",
    "checkgas": "Gas",
    "checkhelper": "Helper",
    "checkboatmanuniformid": "Uniform ID",
}

TRIP = T.StructType(
    [
        T.StructField("orderid", T.LongType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("boatid", T.LongType()),
        T.StructField("driverid", T.LongType()),
        T.StructField("departure", T.TimestampNTZType()),
        T.StructField("arrival", T.TimestampNTZType()),
        T.StructField("datecancelled", T.TimestampNTZType()),
        T.StructField("boatamount", MONEY),
        T.StructField("noofpassengers", T.IntegerType()),
        T.StructField("ispaid", T.IntegerType()),
        T.StructField("inspectedby", T.IntegerType()),
        T.StructField("islandtourtype", T.StringType()),
        T.StructField("status", T.StringType()),
        *[T.StructField(c, T.IntegerType()) for c in SAFETY_CHECKS],
    ]
)

BOAT = T.StructType(
    [
        T.StructField("boatid", T.LongType()),
        T.StructField("boatno", T.StringType()),
        T.StructField("boatsize", T.StringType()),
        T.StructField("boatcapacity", T.IntegerType()),
        T.StructField("isavailable", T.IntegerType()),
        T.StructField("iot_speedKnots", MONEY),
    ]
)

DRIVER = T.StructType(
    [
        T.StructField("driverid", T.LongType()),
        T.StructField("firstname", T.StringType()),
        T.StructField("lastname", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Tables:
    """The three tables every report reads.  ``boatid`` and ``driverid`` are the
    primary keys of their dimensions."""

    trip: DataFrame
    boat: DataFrame
    driver: DataFrame

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """Run SQL that names the tables as ``{trip}``, ``{boat}``, ``{driver}``.

        Values go in as named (``:start``) or positional (``?``) parameters,
        never by pasting text.
        """
        return self.trip.sparkSession.sql(
            text, args=args, trip=self.trip, boat=self.boat, driver=self.driver
        )
