"""Survey tables derived from the generated star-schema tables.

The survey data themselves are not distributed. Each view maps whole tables, no
row left out, onto one of the logical tables. The text runs in Spark and DuckDB;
``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_AREA = "CAST(100.0 + 12.5 * (c_nationkey % 8) AS DOUBLE)"
_LON = "CAST(-160.0 + (c_acctbal + 1000.0) / 2200.0 AS DOUBLE)"
_LAT = (
    "CAST(CASE WHEN c_custkey % 499 = 7 THEN -60 + 0.5 * (floor(c_custkey / 499) % 200) "
    "ELSE 18.9 + 0.03 * (c_custkey % 97) END AS DOUBLE)"
)

VIEWS = {
    # Plots are orders, species are brand and type. Some abundances are zero or
    # missing, some species codes are missing, and a third status occurs.
    "plot_species": f"""
        SELECT Island, PlotID, Native_Status, SPP_CODE3A, Plot_Area,
               CASE WHEN max(l_tax) >= 0.08 AND min(l_discount) <= 0 THEN NULL
                    ELSE sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N'
                                  THEN CAST(0 AS DOUBLE) ELSE l_quantity END) END AS Abundance_ha
        FROM (SELECT CAST(n_regionkey AS STRING) AS Island,
                     CAST(l_orderkey AS STRING) AS PlotID,
                     CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'alien'
                          WHEN p_brand = 'Brand#13' THEN 'uncertain'
                          ELSE 'native' END AS Native_Status,
                     CASE WHEN p_size = 50 THEN NULL
                          ELSE concat(p_brand, '-', p_type) END AS SPP_CODE3A,
                     {_AREA} AS Plot_Area,
                     l_tax, l_discount, l_linestatus, l_returnflag, l_quantity
              FROM {{lineitem}}
              JOIN {{orders}} ON l_orderkey = o_orderkey
              JOIN {{customer}} ON o_custkey = c_custkey
              JOIN {{nation}} ON c_nationkey = n_nationkey
              JOIN {{part}} ON l_partkey = p_partkey) s
        GROUP BY Island, PlotID, Native_Status, SPP_CODE3A, Plot_Area""",
    # One raw row per line of an order, so that rows repeat; some MAT are missing.
    "env_raw": f"""
        SELECT CAST(o_orderkey AS STRING) AS PlotIDn,
               {_LON} AS Long_Dec, {_LAT} AS Lat_Dec,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 365.25 END AS newMAT,
               o_totalprice / 100 AS newMAP,
               CAST(dayofyear(o_orderdate) AS DOUBLE) * 10 AS newElev,
               CAST(c_custkey % 83 AS DOUBLE) / 10 AS newVPD,
               CAST(year(o_orderdate) AS DOUBLE) AS newPET,
               o_totalprice / (1000 + 10 * c_nationkey) AS newAridInd,
               CAST(month(o_orderdate) AS DOUBLE) AS HFP,
               CAST(c_nationkey AS DOUBLE) + c_acctbal / 1000 AS HII,
               CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) * 1000 + o_totalprice / 100 AS SubstrateAge_range,
               o_orderpriority AS SubstrateAge_code
        FROM {{lineitem}}
        JOIN {{orders}} ON l_orderkey = o_orderkey
        JOIN {{customer}} ON o_custkey = c_custkey""",
    # Plots are customers here; the seventeenth column is the tip label.
    "local": f"""
        SELECT g.Island, g.PlotID, g.Plot_Area, g.PDmeasure, MAT, MAP, Elev_m, AridInd, VPD, HII, HFP,
               SubstrateAge_range, PD_stand, WD_diff_lrr, WD_wt_diff_lrr, maxDBH_diff_lrr, tip_label,
               maxDBH_wt_diff_lrr, SM_diff_lrr, SM_wt_diff_lrr, PresAbs, Abundance_ha, Total_Abundance_ha,
               concat(g.PlotID, '|', tip_label, '|', g.PDmeasure) AS row_id
        FROM (SELECT CAST(n_regionkey AS STRING) AS Island,
                     CAST(o_custkey AS STRING) AS PlotID,
                     {_AREA} AS Plot_Area,
                     CASE WHEN l_linestatus = 'F' THEN 'MDWNC' ELSE 'MDNN' END AS PDmeasure,
                     concat(p_brand, '-', p_type) AS tip_label,
                     max(c_acctbal) / 365.25 AS MAT,
                     avg(o_totalprice) / 100 AS MAP,
                     CAST(max(dayofyear(o_orderdate)) AS DOUBLE) * 10 AS Elev_m,
                     avg(o_totalprice / (1461 + 10 * c_nationkey)) AS AridInd,
                     avg(l_discount) * 30 AS VPD,
                     CAST(max(c_nationkey) AS DOUBLE) + avg(l_linenumber) AS HII,
                     CAST(max(month(o_orderdate)) AS DOUBLE) AS HFP,
                     max(o_totalprice) / 1461 AS SubstrateAge_range,
                     avg(l_tax) * 10 AS PD_stand,
                     avg(CAST(p_size AS DOUBLE)) / 10 AS WD_diff_lrr,
                     avg(p_size * l_quantity) / 100 AS WD_wt_diff_lrr,
                     avg(p_retailprice) / 100 AS maxDBH_diff_lrr,
                     avg(l_extendedprice) / 14610 AS maxDBH_wt_diff_lrr,
                     avg(l_discount - l_tax) AS SM_diff_lrr,
                     avg(l_quantity) / 10 AS SM_wt_diff_lrr,
                     max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS PresAbs,
                     sum(l_quantity) AS Abundance_ha
              FROM {{lineitem}}
              JOIN {{orders}} ON l_orderkey = o_orderkey
              JOIN {{customer}} ON o_custkey = c_custkey
              JOIN {{nation}} ON c_nationkey = n_nationkey
              JOIN {{part}} ON l_partkey = p_partkey
              GROUP BY 1, 2, 3, 4, 5) g
        JOIN (SELECT CAST(o_custkey AS STRING) AS PlotID,
                     CASE WHEN l_linestatus = 'F' THEN 'MDWNC' ELSE 'MDNN' END AS PDmeasure,
                     sum(l_quantity) AS Total_Abundance_ha
              FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
              GROUP BY 1, 2) t
          ON g.PlotID = t.PlotID AND g.PDmeasure = t.PDmeasure""",
    # One row per order with three numeric and one binary predictor. The response
    # differs by area and by plot; some plots lie far from all others.
    "obs": f"""
        SELECT o_orderkey AS row_id,
               CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS PresAbs,
               o_totalprice / 500500 * (0.4 + 0.05 * (c_nationkey % 8)) * (0.5 + 0.04 * (c_custkey % 13)) AS y,
               CASE WHEN cents < 2 * lines THEN CAST(0 AS DOUBLE)
                    WHEN cents > 8 * lines THEN CAST(1 AS DOUBLE)
                    ELSE o_totalprice / 500500 END AS y01,
               x1, x2, x3,
               CASE WHEN substr(o_orderpriority, 1, 1) <= '2' THEN CAST(1 AS DOUBLE)
                    ELSE CAST(0 AS DOUBLE) END AS urgent,
               CAST(n_regionkey AS STRING) AS Island,
               CAST(o_custkey AS STRING) AS PlotID,
               {_AREA} AS Plot_Area,
               CAST({_AREA} AS STRING) AS Plot_Area2,
               o_orderpriority AS species,
               {_LON} AS Long_Dec, {_LAT} AS Lat_Dec
        FROM {{orders}}
        JOIN (SELECT l_orderkey, avg(l_quantity) / 10 AS x1, avg(l_discount) * 10 AS x2,
                     avg(l_tax) * 10 AS x3, count(*) AS lines,
                     sum(CAST(round(l_discount * 100) AS BIGINT)) AS cents
              FROM {{lineitem}} GROUP BY l_orderkey) q ON o_orderkey = l_orderkey
        JOIN {{customer}} ON o_custkey = c_custkey
        JOIN {{nation}} ON c_nationkey = n_nationkey""",
    # One draw per order, four chains numbered from 2501 on as after a warm-up;
    # orders without lines leave two terms missing.
    "draws_wide": """
        SELECT CAST(o_orderkey % 4 + 1 AS INT) AS chain,
               CAST(floor(o_orderkey / 4) + 2501 AS INT) AS iteration,
               CAST(o_orderkey + 1 AS INT) AS draw,
               o_totalprice / 100000 - 2.5 AS `b_Intercept`,
               (q - 25) / 10 AS `b_AridInds`,
               CAST(dayofyear(o_orderdate) - 120 AS DOUBLE) / 100 AS `b_MATs`,
               CAST(o_custkey % 101 AS DOUBLE) / 25 - 1.6 AS `b_HIIs`,
               CAST(month(o_orderdate) AS DOUBLE) / 4 AS `b_MATs:PD_stands`,
               (d - 0.05) * 20 AS `b_HIIs:PD_stands`
        FROM {orders}
        LEFT JOIN (SELECT l_orderkey, avg(l_quantity) AS q, avg(l_discount) AS d
                   FROM {lineitem} GROUP BY l_orderkey) s ON o_orderkey = l_orderkey""",
    "diagnostics": """
        SELECT CAST(user_id % 4 + 1 AS INT) AS chain, event_id AS iteration,
               CASE event_type WHEN 'error' THEN 'divergent__' WHEN 'view' THEN 'treedepth__'
                               WHEN 'click' THEN 'stepsize__' ELSE 'energy__' END AS Parameter,
               CASE WHEN value > 200 THEN 1 ELSE 0 END AS Value
        FROM {events}""",
    # Root, regions, nations, and suppliers as tips.
    "tree_edges": """
        SELECT 'root' AS parent, concat('r', CAST(r_regionkey AS STRING)) AS child,
               CAST(1.0 + 0.25 * r_regionkey AS DOUBLE) AS length FROM {region}
        UNION ALL
        SELECT concat('r', CAST(n_regionkey AS STRING)), concat('n', CAST(n_nationkey AS STRING)),
               CAST(0.5 + 0.1 * (n_nationkey % 7) AS DOUBLE) FROM {nation}
        UNION ALL
        SELECT concat('n', CAST(s_nationkey AS STRING)), concat('s', CAST(s_suppkey AS STRING)),
               CAST(0.1 + (s_acctbal + 1000.0) / 10000.0 AS DOUBLE) FROM {supplier}""",
    # Quantities by supplier, which is a tip; regions and nations differ.
    "tip_rows": """
        SELECT concat('s', CAST(s_suppkey AS STRING)) AS tip,
               l_quantity + CAST(s_nationkey % 5 AS DOUBLE) * 3 + CAST(s_suppkey % 4 AS DOUBLE) AS y
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    # Log densities of the lines of each order as its draws.
    "loglik": """
        SELECT l_orderkey AS row_id, l_linenumber AS draw,
               CAST(-0.918938533204673 AS DOUBLE) - ln(7) - CAST(0.5 AS DOUBLE) * power((l_quantity - 25) / 7, 2) AS ll
        FROM {lineitem}""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _used(sql: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in sql]


#: Rows of the largest table that one task of a shuffle gets. Grouped by species and plot, a million take about 670 MB.
ROWS_PER_TASK = 500_000
PARTITIONS_KEY, UNSET = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(2**31 - 1)
TASK_BYTES_KEY, TASK_BYTES_DEFAULT, TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "67108864b", "16m"


def deal(spark: SparkSession, rows: int) -> None:
    """Shuffles go into as many partitions as the rows need, so that the memory of a task does not grow with them.

    Nothing changes where the session's number of partitions is enough, or if it says itself what is set here.
    """
    for key in getattr(spark, "_understory_dealt", ()):
        spark.conf.unset(key)
    spark._understory_dealt = []
    wanted = -(-rows // ROWS_PER_TASK)
    if wanted <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return
    for key, default, value in ((PARTITIONS_KEY, UNSET, str(wanted)), (TASK_BYTES_KEY, TASK_BYTES_DEFAULT, TASK_BYTES)):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
            spark._understory_dealt.append(key)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table over the parquet files of one scale."""
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _used(sql)}
    largest = next((tables[t] for t in ("lineitem", "orders", "events") if t in tables), None)
    if largest is not None:
        deal(spark, largest.count())
    return spark.sql(sql, **tables)


def view_sql(name: str) -> str:
    """The same table as SQL over views named like the files."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]).replace("`", '"')
