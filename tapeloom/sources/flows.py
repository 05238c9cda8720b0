"""Market flow, large deals and surveillance inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.functions.numeric import clean_number
from tapeloom.functions.text import published_at
from tapeloom.operators.keyed import first_per_key
from tapeloom.sources.prices import read_text_csv

FLOW_SCHEMA = "category string, date string, buyValue string, sellValue string, netValue string"
MEMBER = "symbol string, asmSurvIndicator string, companyName string, gsmStage string, survCode string, survDesc string"
ASM_SCHEMA = f"longterm struct<data:array<struct<{MEMBER.replace(' string', ':string')}>>>, shortterm struct<data:array<struct<{MEMBER.replace(' string', ':string')}>>>"


def market_flow(rows: DataFrame) -> DataFrame:
    """Category flow rows; unparsable days are dropped, unparsable numbers are null."""
    return rows.select(
        F.from_utc_timestamp(published_at(F.col("date")), "Asia/Kolkata").cast("date").alias("day"), F.coalesce("category", F.lit("")).alias("category"),
        clean_number(F.col("buyValue")).alias("buy_value"), clean_number(F.col("sellValue")).alias("sell_value"),
        clean_number(F.col("netValue")).alias("net_value"),
    ).where(F.col("day").isNotNull())


def read_market_flow(spark: SparkSession, path: str) -> DataFrame:
    return market_flow(spark.read.schema(FLOW_SCHEMA).json(path, multiLine=True))


def large_deals(rows: DataFrame, kind: str) -> DataFrame:
    day = F.from_utc_timestamp(published_at(F.col("DATE")), "Asia/Kolkata").cast("date")
    return rows.select(
        day.alias("day"), F.col("SYMBOL").alias("symbol"), F.coalesce("CLIENT NAME", F.lit("")).alias("client"),
        F.upper(F.coalesce("`BUY/SELL`", F.lit(""))).alias("side"), clean_number(F.col("QUANTITY TRADED")).alias("qty"),
        clean_number(F.col("`TRADE PRICE / WGHT. AVG. PRICE`")).alias("price"), F.lit(kind).alias("kind"),
    ).where(F.col("day").isNotNull() & (F.coalesce("symbol", F.lit("")) != ""))


def read_large_deals(spark: SparkSession, bulk: str, block: str) -> DataFrame:
    both = large_deals(read_text_csv(spark, bulk), "bulk").unionByName(large_deals(read_text_csv(spark, block), "block"))
    return both.dropDuplicates(["day", "symbol", "client", "side", "qty", "kind"])


def surveillance(asm: DataFrame, gsm: DataFrame, as_of: Column) -> DataFrame:
    """Membership snapshot; the first row of a (symbol, framework) stands."""
    def side(framework: str, order: int, data: Column, src: DataFrame) -> DataFrame:
        return src.select(F.posexplode_outer(data).alias("pos", "m")).where(F.trim("m.symbol") != "").select(
            F.trim("m.symbol").alias("symbol"), F.lit(framework).alias("framework"),
            F.coalesce("m.asmSurvIndicator", F.lit("")).alias("stage"),
            F.col("m.companyName").alias("detail"), (F.lit(order * 10_000_000) + F.col("pos")).alias("_pos"),
        )

    rows = side("asm_lt", 0, F.col("longterm.data"), asm).unionByName(side("asm_st", 1, F.col("shortterm.data"), asm))
    g = gsm.where(F.trim("symbol") != "").select(
        F.trim("symbol").alias("symbol"), F.lit("gsm").alias("framework"), F.coalesce("gsmStage", F.lit("")).alias("stage"),
        F.concat(F.coalesce("survCode", F.lit("")), F.lit(" "), F.coalesce("survDesc", F.lit(""))).alias("detail"), F.lit(20_000_000).alias("_pos"),
    )
    out = first_per_key(rows.unionByName(g), ["symbol", "framework"], ["_pos", "stage", "detail"])
    return out.drop("_pos").withColumn("as_of", as_of)


def read_surveillance(spark: SparkSession, asm_path: str, gsm_path: str, as_of: Column) -> DataFrame:
    return surveillance(
        spark.read.schema(ASM_SCHEMA).json(asm_path, multiLine=True), spark.read.schema(MEMBER).json(gsm_path, multiLine=True), as_of
    )
