"""Columns of the order-line tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The bronze columns in the contract's order.
BRONZE_COLUMNS = (
    "sourcedItemQuantity",
    "releaseItemQuantity",
    "pendingItemQuantity",
    "orderedQuantity",
    "materialRequestQuantity",
    "invoicedItemQuantity",
    "customerSuppliedItemNumber",
    "transportMode",
    "trackingNumber",
    "status",
    "sourcedPartNumber",
    "sourceCustomerCode",
    "shippedPGIDate",
    "shipId",
    "reservePrimPSO",
    "pso",
    "polExternalID",
    "partNumber",
    "orderType",
    "orderlineName",
    "orderEntryDate",
    "modifiedDateTime",
    "lastActivityDateTime",
    "isTransferOrder",
    "isTrackingActive",
    "isPurged",
    "invoiceReferenceNumber",
    "invoiceNumber",
    "huNumber",
    "facilityPSO",
    "facilityName",
    "estimatedShipDate",
    "customerReference",
    "customerCode",
    "crmBillNumber",
    "createdDateTime",
    "containerNumber",
    "carrierName",
    "carrierCode",
    "airwayBillNumber",
    "catOrderStatus",
    "customerStorageLocation",
    "keyCatCustomerCode",
    "profile",
    "relatedCustomer",
    "shipByDate",
    "insertDateTime",
    "changedDateTime",
)
KEY = "polExternalID"
QUANTITIES = (*(c for c in BRONZE_COLUMNS if c.endswith("Quantity")), "customerSuppliedItemNumber")
DATES = ("shippedPGIDate", "orderEntryDate", "estimatedShipDate", "shipByDate")

# What the pipeline adds to a line; the rest is what a response page holds for it.
ADDED_COLUMNS = ("catOrderStatus", "insertDateTime", "changedDateTime")
SOURCE_COLUMNS = tuple(c for c in BRONZE_COLUMNS if c not in ADDED_COLUMNS)

LINE_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in SOURCE_COLUMNS])

# The fact table's columns in the contract's order.
FACT_COLUMNS = (
    "transportmode",
    "trackingnumber",
    "sourcedpartnumber",
    "status_code",
    "sourceditemquantity",
    "sourcecustomercode",
    "shippedpgidate",
    "shipid",
    "reserveprimpso",
    "releaseitemquantity",
    "pso",
    "polexternalid",
    "pendingitemquantity",
    "partnumber",
    "ordertype",
    "orderlinename",
    "orderentrydate",
    "orderedquantity",
    "modifieddatetime",
    "materialrequestquantity",
    "lastactivitydatetime",
    "istransferorder",
    "istrackingactive",
    "ispurged",
    "invoicereferencenumber",
    "invoicenumber",
    "invoiceditemquantity",
    "hunumber",
    "facilitypso",
    "facilityname",
    "estimatedshipdate",
    "customersupplieditemnumber",
    "customerreference",
    "dealercode",
    "crmbillnumber",
    "createddatetime",
    "containernumber",
    "carriercode",
    "airwaybillnumber",
    "catorderstatus",
    "customerstoragelocation",
    "keycatcustomercode",
    "profile",
    "relatedcustomer",
    "shipbydate",
    "insertdatetime",
    "changeddatetime",
)
