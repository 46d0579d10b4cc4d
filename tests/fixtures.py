"""Hand-made star schema rows with the cases the synthetic tables lack."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from fleetboard.schema import BOAT, DRIVER, TRIP, Tables
from fleetboard.sources import rows_frame


def at(text: str | None) -> dt.datetime | None:
    return dt.datetime.fromisoformat(text) if text else None


def trip(n, **given):
    row = dict.fromkeys(TRIP.names)
    row.update(orderid=n, lineno=1, **given)
    for name in ("departure", "arrival", "datecancelled"):
        row[name] = at(row[name])
    if row["boatamount"] is not None:
        row["boatamount"] = Decimal(row["boatamount"])
    return tuple(row[c] for c in TRIP.names)


TRIPS = [
    trip(1, boatid=1, driverid=2, departure="2026-01-05 08:00:00", arrival="2026-01-05 10:00:00",
         boatamount="100.50", noofpassengers=4, ispaid=1, inspectedby=7, islandtourtype="A",
         status="Done", checklifevest=1, checkgas=1),
    trip(2, boatid=1, driverid=2, departure="2026-01-05 08:30:00", arrival="2026-01-05 09:00:00",
         boatamount="50.25", noofpassengers=5, ispaid=0, inspectedby=7, islandtourtype="B",
         status="Done", checklifevest=0, checkgas=1),
    # last instants of the end date; arrival equal to departure
    trip(3, boatid=2, driverid=3, departure="2026-01-31 23:59:59.500000",
         arrival="2026-01-31 23:59:59.500000", boatamount="10.00", noofpassengers=1, ispaid=None,
         inspectedby=0, islandtourtype="", status="", checklifevest=1),
    # arrival before departure
    trip(4, boatid=2, driverid=3, departure="2026-02-01 00:00:00", arrival="2026-01-31 20:00:00",
         boatamount="20.00", noofpassengers=None, ispaid=2, inspectedby=9, islandtourtype=None,
         status="Unknown", checklifevest=None),
    # no departure; no arrival
    trip(5, boatid=3, driverid=None, departure=None, boatamount="5.00", noofpassengers=2, ispaid=1,
         status=None, datecancelled="2026-01-10 12:00:00"),
    # no amount on any trip of this size; placeholder driver; seed status
    trip(6, boatid=4, driverid=1, departure="2026-02-03 17:00:00", noofpassengers=3, ispaid=0,
         inspectedby=None, status="0", checklifevest=0, datecancelled="2026-02-03 18:00:00"),
    # boat 0 and a boat that is not in the table
    trip(7, boatid=0, driverid=4, departure="2026-02-04 17:15:00", arrival="2026-02-04 18:30:00",
         boatamount="1.00", ispaid=1, status="Done", islandtourtype="A"),
    trip(8, boatid=99, driverid=99, departure="2026-03-01 05:00:00", boatamount="2.00", ispaid=1,
         status="Done", datecancelled="2026-03-01 06:00:00"),
    trip(9, boatid=5, driverid=4, departure="2026-03-02 05:00:00", arrival="2026-03-02 06:15:00",
         boatamount="7.00", ispaid=1, status="Open", datecancelled="2026-03-03 00:00:00"),
]

BOATS = [
    (0, "B-0", "Small", 3, 1, None),
    (1, "B-1", "Small", 10, 1, Decimal("5.10")),
    (2, "B-2", "Medium", 20, 0, Decimal("6.25")),
    (3, "B-3", "Large", None, None, Decimal("7.00")),
    (4, "B-4", "Giant", 20, 2, None),
    (5, "B-5", None, 1, 1, Decimal("9.99")),
    (6, "B-6", "Medium", 5, 0, Decimal("6.00")),
]

DRIVERS = [
    (1, "DEFAULT", "FN"),
    (2, "Ana", "Cruz"),
    (3, "Ben", None),
    (4, "Cy", "Diaz"),
]


def star(spark, trips=TRIPS, boats=BOATS, drivers=DRIVERS) -> Tables:
    return Tables(
        rows_frame(spark, trips, TRIP),
        rows_frame(spark, boats, BOAT),
        rows_frame(spark, drivers, DRIVER),
    )
