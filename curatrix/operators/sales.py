"""Reporting views over the sales star schema.

Facts are aggregated to the join key before they meet a dimension, so that a hot customer or product crosses the
shuffle as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sales_summary(orders: DataFrame, customers: DataFrame) -> DataFrame:
    month = F.date_trunc("month", "order_date").alias("order_month")
    per_order = orders.groupBy("customer_id", month, "order_id").agg(*_amounts())
    per_customer = per_order.groupBy("customer_id", "order_month").agg(F.count("order_id").alias("orders"), F.sum("amount").alias("amount"), F.sum("amounts").alias("amounts"))
    joined = per_customer.join(customers.select("customer_id", "country_code"), "customer_id")
    return joined.groupBy("order_month", "country_code").agg(
        F.sum("orders").alias("total_orders"), F.count("customer_id").alias("unique_customers"),
        F.round(F.sum("amount"), 2).alias("total_revenue"), F.round(F.sum("amount") / F.sum("amounts"), 6).alias("avg_order_value"))


def _amounts():
    return F.sum("total_amount").alias("amount"), F.count("total_amount").alias("amounts")


def order_stats(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("order_count"), F.sum("total_amount").alias("spent"), F.avg("total_amount").alias("mean"),
        F.max("total_amount").alias("largest"), F.min("total_amount").alias("smallest"), F.max("order_date").alias("last_order"))


def _days_since(as_of, c):
    return F.date_diff(F.lit(as_of).cast("date"), c.cast("date"))


def customer_360(customers: DataFrame, orders: DataFrame, countries: DataFrame, as_of) -> DataFrame:
    out = customers.join(order_stats(orders), "customer_id", "left").join(countries, "country_code", "left")
    return out.select(
        "customer_id", "customer_segment", "country_code", "country_name", "region", F.coalesce("order_count", F.lit(0)).alias("total_orders"),
        F.round("spent", 2).alias("total_spent"), F.round("mean", 6).alias("avg_order_value"), F.col("last_order").alias("last_order_date"),
        _days_since(as_of, F.col("last_order")).alias("days_since_last_order"))


def product_performance(products: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    known = orders.select("order_id").distinct().withColumn("known", F.lit(1))
    per_order = items.groupBy("product_id", "order_id").agg(
        F.sum("quantity").alias("units"), F.sum("line_total").alias("revenue"), F.sum("unit_price").alias("price"), F.count("unit_price").alias("prices"))
    stats = per_order.join(known, "order_id", "left").groupBy("product_id").agg(
        F.sum("units").alias("units"), F.sum("revenue").alias("revenue"), F.count("known").alias("orders"), (F.sum("price") / F.nullif(F.sum("prices"), F.lit(0))).alias("price"))
    return products.join(stats, "product_id", "left").select(
        "product_id", "product_name", "category_name", F.col("units").alias("total_units_sold"), F.round("revenue", 2).alias("total_revenue"),
        F.coalesce("orders", F.lit(0)).alias("order_count"), F.round("price", 6).alias("avg_selling_price"),
        F.round((F.col("list_price") - F.col("cost_price")) / F.nullif(F.col("list_price"), F.lit(0.0)) * 100, 4).alias("margin_percent"))


def revenue_by_region(orders: DataFrame, customers: DataFrame, countries: DataFrame) -> DataFrame:
    quarter = F.date_trunc("quarter", "order_date").alias("quarter")
    per_customer = orders.groupBy("customer_id", quarter).agg(F.sum("total_amount").alias("amount"), F.count("order_id").alias("orders"))
    joined = per_customer.join(customers.select("customer_id", "country_code"), "customer_id").join(countries, "country_code")
    return joined.groupBy("region", "country_name", "quarter").agg(
        F.round(F.sum("amount"), 2).alias("total_revenue"), F.sum("orders").alias("order_count"), F.count("customer_id").alias("customer_count"))


# Loyalty tier to score; every other tier scores 1.
TIER_SCORES = {"PLATINUM": 4, "GOLD": 3, "SILVER": 2}


def customer_features(customers: DataFrame, orders: DataFrame, as_of) -> DataFrame:
    out = customers.join(order_stats(orders), "customer_id", "left")
    tier = F.lit(1)
    for name, score in TIER_SCORES.items():
        tier = F.when(F.col("loyalty_tier") == name, score).otherwise(tier)
    zero = lambda c, d: F.round(F.coalesce(c, F.lit(0.0)), d)
    return out.select(
        "customer_id", _days_since(as_of, F.col("created_at")).alias("account_age_days"), F.coalesce("order_count", F.lit(0)).alias("order_count"),
        zero("spent", 2).alias("total_spent"), zero("mean", 6).alias("avg_order_value"), zero("largest", 2).alias("max_order_value"),
        zero("smallest", 2).alias("min_order_value"), F.coalesce(_days_since(as_of, F.col("last_order")), F.lit(9999)).alias("recency_days"), tier.alias("loyalty_score"))
