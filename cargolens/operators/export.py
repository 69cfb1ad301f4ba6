"""Declaration export: one XML document per shipment that may be exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import country_code

#: Declaration and root, with the name space of schema instances.
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<ASYCUDA xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">'
FIRST_DESTINATION = "LK"


def statistical_value(total: Column, rate: Column) -> Column:
    return F.round(total.try_cast("double") * rate.try_cast("double"), 2)


def declarations(assessed: DataFrame, items: DataFrame, registered: Column | None = None) -> DataFrame:
    """shipment_id, xml of the shipments of ``assessed`` (from ``readiness.assess``) that may be exported.

    ``items``: shipment_id, row_index, description, total_price. Values that the form can do without are left out where
    they have no text; the shipment's code, packages and weights stand at every item, as the form asks. ``registered`` is
    the date of registration, today if it isn't given.
    """
    f = lambda k: F.try_element_at(F.col("fields"), F.lit(k))["value"]
    m = lambda k: F.try_element_at(F.col("profile"), F.lit(k))
    text = lambda c, name: F.coalesce(c.cast("string"), F.lit("")).alias(name)
    opt = lambda c, name: F.when(F.length(c) > 0, c).alias(name)
    node = lambda name, *parts: F.struct(*parts).alias(name)
    origin, rate, bank = country_code(f("COUNTRY_OF_ORIGIN")), m("currency_rate"), m("financial_code")

    def item(x: Column) -> Column:
        return F.struct(
            x["row_index"].alias("Item_Number"),
            node("Tariff", text(f("HS_CODE"), "Commodity_code"), opt(m("national_customs_codes"), "National_customs_codes")),
            node("Goods_description", text(x["description"], "Commercial_description"), opt(origin, "Country_of_origin_code")),
            node("Packages", text(f("PACKAGE_COUNT"), "Number_of_packages"), opt(m("package_type_code"), "Type_of_packages_code"), opt(m("marks_and_numbers"), "Marks_and_numbers")),
            node("Weight", text(f("GROSS_WEIGHT"), "Gross_mass"), opt(f("NET_WEIGHT"), "Net_mass")),
            node("Valuation_item", text(x["total_price"], "Item_Invoice_amount"), text(f("CURRENCY_CODE"), "Currency_code"), text(rate, "Rate_of_exchange"), text(statistical_value(x["total_price"], rate), "Statistical_value")),
        )

    today = (F.current_date() if registered is None else registered).cast("string")
    form = F.struct(
        node("Identification",
             node("Office_segment", text(m("customs_office_code"), "Customs_clearance_office_code")),
             node("Type", text(m("declaration_type"), "Type_of_declaration"), text(m("general_procedure_code"), "Declaration_gen_procedure_code")),
             node("Registration", F.lit("").alias("Number"), text(today, "Date"))),
        node("Traders",
             node("Exporter", text(m("exporter_code"), "Exporter_code"), text(f("SHIPPER_NAME"), "Exporter_name"), opt(m("exporter_address"), "Exporter_address")),
             node("Consignee", text(m("consignee_code"), "Consignee_code"), text(f("CONSIGNEE_NAME"), "Consignee_name"), opt(m("consignee_address"), "Consignee_address")),
             F.when(F.length(bank) > 0, F.struct(bank.alias("Financial_code"))).alias("Financial")),
        node("Declarant", text(m("declarant_code"), "Declarant_code"), text(m("declarant_name"), "Declarant_name"), opt(m("declarant_representative"), "Declarant_representative")),
        node("General_information",
             node("Country", opt(F.coalesce(m("country_first_destination"), F.lit(FIRST_DESTINATION)), "Country_first_destination"), opt(F.coalesce(m("trading_country"), origin), "Trading_country"), opt(F.coalesce(m("country_of_export_code"), origin), "Country_of_export_code")),
             node("Value_details", text(f("CURRENCY_CODE"), "Invoice_currency_code"), text(f("TOTAL_AMOUNT"), "Invoice_total_amount")),
             node("Cap", text(f("INCOTERM"), "Terms_code"))),
        node("Transport",
             node("Means_of_transport", node("Departure_arrival_information", opt(m("transport_identity"), "Identity"), opt(m("transport_nationality"), "Nationality")), node("Border_information", text(m("transport_mode"), "Mode"))),
             text(m("container_flag"), "Container_flag"), opt(f("PORT_OF_DISCHARGE"), "Delivery_place"), opt(m("location_of_goods"), "Location_of_goods")),
        node("Financial",
             F.when(F.length(m("financial_transaction_code")) > 0, F.struct(m("financial_transaction_code").alias("Code"))).alias("Financial_transaction"),
             F.when(F.length(bank) > 0, F.struct(bank.alias("Code"), opt(m("financial_name"), "Name"), opt(m("financial_branch"), "Branch"))).alias("Bank"), opt(m("terms_of_payment"), "Terms_of_payment")),
        F.transform("items", item).alias("Item"),
    )
    rows = items.groupBy("shipment_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "description", F.col("total_price").cast("string").alias("total_price")))).alias("items"))
    ready = assessed.filter("export_allowed").join(rows, "shipment_id")
    return ready.select("shipment_id", F.regexp_replace(F.to_xml(form, {"rowTag": "ASYCUDA"}), "^<ASYCUDA>", HEAD).alias("xml"))
