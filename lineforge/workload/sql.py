"""SQL texts of the models, written for the check engine independently of the Spark code."""

from __future__ import annotations

from lineforge.workload.bronze import bronze_sql

# Written out here so that a column missing from a model is missed by its check.
INTS = (
    "sourcedItemQuantity releaseItemQuantity pendingItemQuantity orderedQuantity "
    "materialRequestQuantity invoicedItemQuantity customerSuppliedItemNumber"
).split()
SLASHED = "shippedPGIDate orderEntryDate estimatedShipDate shipByDate".split()
TRIMMED = (
    "transportMode trackingNumber status sourcedPartNumber sourceCustomerCode shipId reservePrimPSO "
    "polExternalID partNumber orderType orderlineName modifiedDateTime lastActivityDateTime "
    "isTransferOrder isTrackingActive invoiceReferenceNumber invoiceNumber huNumber facilityPSO "
    "facilityName customerReference crmBillNumber createdDateTime containerNumber carrierName "
    "carrierCode airwayBillNumber customerStorageLocation keyCatCustomerCode profile relatedCustomer "
    "insertDateTime changedDateTime"
).split()


def int_sql(e: str) -> str:
    """By decimal arithmetic, after white space of any kind is gone."""
    bare = f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"
    return f"try_cast(trunc(try_cast({bare} as decimal(38,6))) as integer)"


def date_sql(e: str) -> str:
    return (
        f"case when {e} like '%/%' then cast(cast(try_strptime({e}, '%m/%d/%Y') as date) as varchar) "
        f"else trim({e}) end"
    )


# What differs between lines without an insert time and all others.
LEGACY = {
    "PSO": "regexp_replace(trim(pso), '^(.{8})$', '0\\1')",
    "ISPURGED": "coalesce(trim(isPurged), 'false')",
    "CATORDERSTATUS": "coalesce(trim(catOrderStatus), 'Open')",
}
CURRENT = {
    "PSO": "trim(pso)",
    "ISPURGED": "trim(isPurged)",
    "CATORDERSTATUS": "trim(catOrderStatus)",
}


def by_age(name: str, alias: str) -> str:
    """Keys and one such column: legacy lines, then all others."""
    parts = [
        f'select polExternalID, {rule[name]} as "{alias}" from bronze where insertDateTime is {age}'
        for rule, age in ((LEGACY, "null"), (CURRENT, "not null"))
    ]
    return " union all ".join(parts)


def _silver_columns(special: dict[str, str]) -> str:
    made = {name.upper(): int_sql(name) for name in INTS}
    made |= {name.upper(): date_sql(name) for name in SLASHED}
    made |= {name.upper(): f"trim({name})" for name in TRIMMED}
    made |= {"DEALERCODE": "trim(customerCode)", **special}
    return ",\n  ".join(f"{e} as {alias}" for alias, e in made.items())


SEED = """select * from (values ('1','Future Dated'), ('2','ESD Needed'), ('6','Cancelled'),
  ('4','Sourced'), ('5','Shipped'), ('7','Griefed'), ('0','Null')) as t(sequence, status)"""

BRONZE = f"bronze as ({bronze_sql()})"
SILVER = f"""{BRONZE},
silver as (
  select {_silver_columns(LEGACY)} from bronze where insertDateTime is null
  union all by name
  select {_silver_columns(CURRENT)} from bronze where insertDateTime is not null)"""


def _fact_columns() -> str:
    names = [*INTS, *SLASHED, *TRIMMED, "PSO", "ISPURGED", "CATORDERSTATUS", "DEALERCODE"]
    kept = [n for n in names if n not in ("status", "carrierName")]
    return ", ".join(f"kept.{n} as {n.lower()}" for n in kept)


STATUS = f"status as (select cast(sequence as integer) as sequence, trim(status) as status from ({SEED}))"
FACT = f"""{SILVER},
{STATUS},
fact as (select coded.sequence as status_code, {_fact_columns()}
  from silver kept left join status coded on kept.STATUS = coded.status)"""

FEATURES = f"""{FACT},
extracted as (
  select polexternalid, transportmode, ordertype, orderedquantity,
         try_cast(orderentrydate as date) as entered,
         try_cast(shippedpgidate as date) as shipped,
         try_cast(estimatedshipdate as date) as arrival,
         shippedpgidate, carriercode
  from fact where transportmode is not null and estimatedshipdate is not null),
features as (
  select polexternalid as polExternalID, transportmode as transportMode, ordertype as orderType,
         orderedquantity as orderedQuantity, carriercode as carrierCode,
         entered as orderEntryDate, shipped as shippedPGIDate, arrival as ArrivalDate,
         cast(shipped - entered as integer) as DaysToShip,
         cast(arrival - entered as integer) as DaysToDelivery,
         case transportmode when 'TRUCK' then 1 when 'AIR' then 2 end as transportModeCode,
         case ordertype when 'STOCK' then 1 when 'CPRO' then 2 when 'FDO' then 3
           when 'EMERGENCY' then 4 when 'WARRANTY' then 5 when 'MEGA' then 6
           when 'DOWN' then 7 when 'LCPRO' then 8 end as orderTypeCode
  from extracted where not coalesce(shipped > arrival, false))"""

# Weights of the pinned model: exact in binary, so sums do not depend on rounding.
WEIGHTS = {
    "intercept": 3.5,
    "transportModeCode": -0.75,
    "orderTypeCode": 0.125,
    "orderedQuantity": 0.0625,
    "DaysToShip": 0.875,
}
PREDICTED = (
    "cast(3.5 - 0.75 * coalesce(transportModeCode, 0) + 0.125 * coalesce(orderTypeCode, 0) "
    "+ 0.0625 * coalesce(orderedQuantity, 0) + 0.875 * coalesce(DaysToShip, 0) as real)"
)


def with_(ctes: str, select: str) -> str:
    return f"with {ctes}\n{select}"
