"""Shared column names, schemas and fixed parameter values."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

# Header of the transaction file, in file order.
RAW_HEADER = [
    "InvoiceNo", "StockCode", "Description", "Quantity",
    "InvoiceDate", "UnitPrice", "CustomerID", "Country",
]

# Same columns under the names used inside this library, same order.
RAW_COLUMNS = [
    "invoice_no", "item_id", "descr", "qty",
    "ts", "unit_price", "user_id", "country",
]

RAW_FILE_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("InvoiceDate", T.StringType()),
    T.StructField("UnitPrice", T.DoubleType()),
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Country", T.StringType()),
])

PRODUCT_FILE_SCHEMA = T.StructType([
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Chinese_Description", T.StringType()),
    T.StructField("Product_Category", T.StringType()),
])

# Stock codes that name services, not goods.
SERVICE_CODES = [
    "POST", "DOT", "M", "S", "B", "PADS", "C2", "D",
    "BANK CHARGES", "ADJUST", "ADJUST2", "TEST001", "TEST002",
]

# Category labels for "other" and "not labelled".
OTHER_CATEGORY = "其他"
UNLABELLED_CATEGORY = "未标注"

# Countries with their own indicator column, in column order.
COUNTRY_LIST = ["United Kingdom", "Germany", "France", "EIRE"]
COUNTRY_COLUMNS = ["country_uk", "country_de", "country_fr", "country_eire", "country_other"]

# Feature column order of the wide tables.
FEATURES_USER = [
    "u_n_orders_log", "u_n_items_log", "u_qty_log", "u_spend_log",
    "u_avg_unit_price_log", "u_avg_basket_size_log", "u_active_days_log",
    "u_last_active_gap_log", "u_weekend_ratio", "u_cat_entropy",
]
FEATURES_ITEM = [
    "i_pop_buyers_log", "i_pop_orders_log", "i_qty_log", "i_price_log",
    "i_pop_rank_frac", "i_first_gap_log", "i_last_gap_log",
    "i_cat_sales_log", "i_cat_sales_share", "i_top_weekday_code",
]
FEATURES_PAIR = [
    "ui_cat_lift_log", "ui_price_gap_log", "ui_emb_sim", "ui_cf_sim", "ui_nn_hit_rate",
]
FEATURES_BASE = FEATURES_USER + FEATURES_ITEM + FEATURES_PAIR + COUNTRY_COLUMNS + ["cat_code_ordinal"]
FEATURES_OWNED = ["ui_owned", "ui_owned_recency_log"]
FEATURES_CONTEXT = [
    "p_ui_n_ord_log", "p_ui_qty_log", "p_ui_first_age_log",
    "i_r30_buy_log", "i_r30_ord_log", "i_r60_buy_log", "i_growth30_log",
    "cc_u_cand_size_log", "cc_i_cand_freq_log", "cc_u_owned_ratio", "cc_i_hit_ratio",
]
FEATURES_CYCLE = [
    "p_cycle_median_log", "p_due_capped", "p_n_dates_log",
    "cc_cat_recent_log", "cc_cat_recent_share", "i_r7_buy_log",
]
FEATURES_RHYTHM = [
    "p_ui_act_mon_frac", "p_ui_recent_ord30_log", "i_rep_incid_frac", "i_r7_buy_log",
]
FEATURES_RANK = [
    "pop_buyers_log", "pop_rank_frac", "price_log", "emb_sim_uservec", "cf_agg_sim",
    "n_routes", "fl_pop", "fl_sim", "fl_vec", "user_n_owned_log",
]

# Recall settings.
RECALL_FINAL_K = 50
QUOTAS_3 = {"popular": 10, "similar": 20, "user_vec": 20}
ROUTE_ORDER_5 = ["popular", "similar", "user_vec", "itemcf", "recent"]
QUOTAS_5 = {"popular": 10, "similar": 10, "user_vec": 15, "itemcf": 10, "recent": 5}
QUOTAS_5_ALT = {"popular": 20, "similar": 10, "user_vec": 5, "itemcf": 10, "recent": 5}
NEIGHBOR_K_5 = 5
HOT_TOP_N = 100

SEED = 42

# Dates used by the registered queries over the test tables.
CUT = datetime(2001, 6, 1)
MONTH_CUTS = [datetime(2001, m, 1) for m in (3, 4, 5, 6, 7)]
