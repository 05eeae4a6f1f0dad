"""``scalar_pack``: every per-value rule (SC-1 .. SC-19) on funding rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from trendspark import bindings as B
from trendspark.functions import scalars as S
from trendspark.functions.text import tokens
from trendspark.params import STOP_WORDS
from trendspark.plans.registry import AS_OF_SQL as ASOF, finish_sql, present, register, with_views

_STOPS_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"

_SQL = with_views(["funding"], f"""
select row_key,
  coalesce(case when stage = 'seed' then null else company_name end, company_uuid) as sc1_fallback,
  case when stage = 'seed' then 1 else 2 end as sc2_list_len,
  concat(company_name, ' ', stage) as sc3_one_line,
  trim(concat_ws(' ', stage, currency)) as sc4_name,
  case when stage = 'seed' then date_trunc('month', date) else date end as sc5_date,
  array_to_string(list_filter(list_transform(string_split_regex(lower(concat('The ', stage, ' round, ', currency)), '\\s+'),
      lambda t: regexp_replace(t, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')),
      lambda t: regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+') and not list_contains({_STOPS_SQL}, t)), '|') as sc6_tokens,
  case when floor(date_diff('second', date, {ASOF}) / 86400) / 30.44::DOUBLE = 0 then 1.0
       else floor(date_diff('second', date, {ASOF}) / 86400) / 30.44::DOUBLE end as sc7_months,
  true as sc8_finite,
  log2(amount_usd) as sc9_log2, sign(amount_usd - 150000) as sc9_sign, abs(amount_usd - 150000) as sc9_abs,
  sqrt(amount_usd) as sc9_sqrt,
  greatest(0.0, least(1.0, amount_usd / 310001 - 0.2)) as sc10_clamp,
  case when amount_usd / 100000 >= 3 then 'large' when amount_usd / 100000 >= 1.5 then 'mid' else 'small' end as sc11_band,
  printf('%.2f', amount_usd / 7) as sc12_fixed2, concat(printf('%.2f', amount_usd / 1000000 * 100), '%') as sc12_pct,
  printf('%.0f', amount_usd / 1000000) as sc12_fixed0, printf('%.3f', amount_usd / 13) as sc12_fixed3,
  array_to_string(list_transform(string_split(replace(stage, '_', ' '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') as sc13_title,
  date as sc14_ts,
  stage = 'seed' as sc15_domestic,
  strftime(date, '%Y%m%d') as sc16_compact,
  concat_ws('|', stage, currency, 'x') as sc16_split,
  concat_ws('|', case when amount_usd / 100000 > 1.0 then 'a' end, 'c') as sc17_keys,
  (amount_usd / 70001 + 1.0) / 2 as sc18_mean,
  case when stage = 'seed' then null else abs(amount_usd - 150000) / 150000 end as sc19_change,
  stage = 'seed' as sc19_infinite
from funding""")


@register("scalar_pack", finish_sql(_SQL, ts=("sc5_date", "sc14_ts"), ints=("sc2_list_len",),
                                    d6=("sc7_months", "sc9_log2", "sc9_sign", "sc9_abs", "sc9_sqrt", "sc10_clamp",
                                        "sc18_mean", "sc19_change")))
def scalar_pack(spark, sf):
    f = B.funding(spark, sf)
    seed = F.col("stage") == "seed"
    days = F.floor(F.timestamp_diff("SECOND", F.col("date"), B.ts_lit(B.AS_OF)) / F.lit(86400))
    months = days / F.lit(30.44)
    change = S.relative_change(F.col("amount_usd"), F.when(seed, F.lit(0.0)).otherwise(F.lit(150000.0)))
    m = F.create_map(F.lit("a"), F.col("amount_usd") / 1e5, F.lit("b"), F.lit(-1.0), F.lit("c"), F.lit(2.0))
    out = f.select(
        "row_key",
        S.fallback(F.when(seed, F.lit(None)).otherwise(F.col("company_name")), "company_uuid").alias("sc1_fallback"),
        S.list_len_or_one(F.when(~seed, F.array("stage", "currency"))).alias("sc2_list_len"),
        S.one_line(F.concat("company_name", F.lit("\n"), "stage")).alias("sc3_one_line"),
        S.name_join("stage", "currency").alias("sc4_name"),
        S.date_from_parts(F.year("date").cast("string"), F.date_format("date", "MMM"),
                          F.when(~seed, F.dayofmonth("date").cast("string"))).cast("timestamp_ntz").alias("sc5_date"),
        F.array_join(tokens(F.concat(F.lit("The "), "stage", F.lit(" round, "), "currency"), STOP_WORDS), "|")
        .alias("sc6_tokens"),
        F.when(months == 0, F.lit(1.0)).otherwise(months).alias("sc7_months"),
        S.finite(F.col("amount_usd") / 1e5).alias("sc8_finite"),
        F.log2("amount_usd").alias("sc9_log2"), F.signum(F.col("amount_usd") - 150000).alias("sc9_sign"),
        F.abs(F.col("amount_usd") - 150000).alias("sc9_abs"), F.sqrt("amount_usd").alias("sc9_sqrt"),
        S.clamp01(F.col("amount_usd") / 310001 - 0.2).alias("sc10_clamp"),
        S.bands(F.col("amount_usd") / 100000, [(3.0, "large"), (1.5, "mid")], "small").alias("sc11_band"),
        S.fixed(F.col("amount_usd") / 7, 2).alias("sc12_fixed2"),
        S.percent(F.col("amount_usd") / 1000000).alias("sc12_pct"),
        S.fixed(F.col("amount_usd") / 1000000, 0).alias("sc12_fixed0"),
        S.fixed(F.col("amount_usd") / 13, 3).alias("sc12_fixed3"),
        S.title_words("stage").alias("sc13_title"),
        S.iso_ts(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")).alias("sc14_ts"),
        S.is_domestic(F.when(seed, F.lit("us")).otherwise(F.lit("EPO")), ("USPTO", "US")).alias("sc15_domestic"),
        S.ymd_compact(F.date_format("date", "yyyy-MM-dd")).alias("sc16_compact"),
        F.array_join(S.split_trim(F.concat("stage", F.lit(" , "), "currency", F.lit(",x "))), "|").alias("sc16_split"),
        F.array_join(F.map_keys(S.filter_map_by_value(m, ">", 1.0)), "|").alias("sc17_keys"),
        S.row_mean([F.col("amount_usd") / 70001, F.lit(None).cast("double"), F.lit(1.0)]).alias("sc18_mean"),
        F.when(F.isnan(change) | (F.abs(change) == float("inf")), F.lit(None)).otherwise(change).alias("sc19_change"),
        (F.abs(change) == float("inf")).alias("sc19_infinite"))
    return present(out)
