"""SQL that states each query over the raw tables, for an engine other than Spark.

Written from the definition of each table, not from the Spark plans: sets are
selected by subquery, neighbours found by comparing all positions, intervals by
sorting every term, shared branches by walking the tree.
"""

from __future__ import annotations

import math
from itertools import combinations

from understory.functions.noise import LEVEL, deviate_sql, mix64_sql, mix_sql, normal_sql, row_key_sql, salt, salted_sql
from understory.sources.sample_views import view_sql

EARTH_KM = 6371.0088
RADIUS_KM = 25.0
Z_95 = 1.959963984540054

# Column, score and term names of the survey tables.
ENV_NAMES = (
    "PlotIDn AS PlotID, Long_Dec, Lat_Dec, newMAT AS MAT, newMAP AS MAP, newElev AS Elev_m, "
    "newVPD AS VPD, newPET AS PET, newAridInd AS AridInd, HFP, HII, SubstrateAge_range, SubstrateAge_code"
)
ENV_DOUBLES = (
    "Long_Dec", "Lat_Dec", "MAT", "MAP", "Elev_m", "VPD", "PET", "AridInd", "HFP", "HII", "SubstrateAge_range",
)
SCORES = {
    "MAP": "MAPs", "MAT": "MATs", "Elev_m": "Elev_ms", "AridInd": "AridInds",
    "VPD": "VPDs", "HII": "HIIs", "HFP": "HFPs", "SubstrateAge_range_lg": "Soilz",
}
TRAITS = {
    "PD_stand": "PD_stands", "WD_diff_lrr": "WD_diff_lrrs", "WD_wt_diff_lrr": "WD_wt_diff_lrrs",
    "maxDBH_diff_lrr": "maxDBH_diff_lrrs", "maxDBH_wt_diff_lrr": "maxDBH_wt_diff_lrrs",
    "SM_diff_lrr": "SM_diff_lrrs", "SM_wt_diff_lrr": "SM_wt_diff_lrrs",
}
RAW_MAIN = (
    "AridInd", "MAT", "HII", "SubstrateAge_range",
    "PD_stand", "WD_wt_diff_lrr", "maxDBH_wt_diff_lrr", "SM_wt_diff_lrr",
)
DRAW_TERMS = (
    "b_Intercept", "b_AridInds", "b_MATs", "b_HIIs", "b_MATs:PD_stands", "b_HIIs:PD_stands",
)


def nearest(expression: str, digits: int = 6) -> str:
    """Rounding by plain arithmetic, which both engines do alike."""
    unit = f"CAST(1e{digits} AS DOUBLE)"
    return f"floor(CAST({expression} AS DOUBLE) * {unit} + 0.5) / {unit}"


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    return f'{nearest(expression, digits)} AS "{name or expression}"'


def rs(names, digits: int = 6) -> str:
    return ", ".join(r(f'"{n}"', n, digits) for n in names)


def km(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"{2 * EARTH_KM} * asin(sqrt(least(1.0, power(sin(radians({lat2} - {lat1}) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


# Plot tables ---------------------------------------------------------------

PLOTS = f"ps AS ({view_sql('plot_species')})"
SELECTED = """
sel AS (SELECT PlotID FROM ps WHERE Native_Status = 'native' GROUP BY PlotID
        HAVING count(*) = count(Abundance_ha) AND sum(Abundance_ha) > 0),
p AS (SELECT * FROM ps WHERE PlotID IN (SELECT PlotID FROM sel))"""


def shares_sql(source: str) -> str:
    def status(name: str) -> str:
        flag = f"FILTER (WHERE Native_Status = '{name}')"
        return (
            f"CASE WHEN count(*) {flag} = count(Abundance_ha) {flag} "
            f"THEN sum(Abundance_ha) {flag} END AS {name}"
        )

    return f"""
    abund AS (
      SELECT a.Island, a.PlotID, z.Plot_Area, alien AS Alien_abundance, native AS Native_abundance,
             alien + native AS Abundance_both, alien / nullif(alien + native, 0) AS AlienAbund_Prop
      FROM (SELECT Island, PlotID, {status('alien')}, {status('native')} FROM {source} GROUP BY 1, 2) a
      LEFT JOIN (SELECT DISTINCT PlotID, Plot_Area FROM {source}) z ON a.PlotID = z.PlotID)"""


def richness_sql(source: str) -> str:
    def count(name: str) -> str:
        flag = f"FILTER (WHERE Native_Status = '{name}')"
        return (
            f"count(DISTINCT SPP_CODE3A) {flag} + "
            f"coalesce(max(CASE WHEN SPP_CODE3A IS NULL THEN 1 ELSE 0 END) {flag}, 0)"
        )

    return f"""
    rich AS (
      SELECT Island, PlotID, alien AS Alien_SppN, native AS Native_SppN, alien + native AS SppN_both,
             CAST(alien AS DOUBLE) / nullif(alien + native, 0) AS AlienSppN_Prop
      FROM (SELECT Island, PlotID, {count('alien')} AS alien, nullif({count('native')}, 0) AS native
            FROM {source} WHERE Abundance_ha > 0 GROUP BY 1, 2) s)"""


ENV = f"env AS (SELECT DISTINCT {ENV_NAMES} FROM ({view_sql('env_raw')}) e)"
ALIEN_NATIVE = f"""
{PLOTS}, {SELECTED}, {shares_sql('p')}, {richness_sql('p')}, {ENV},
an AS (SELECT abund.*, Alien_SppN, Native_SppN, SppN_both, AlienSppN_Prop, env.* EXCLUDE (PlotID)
       FROM abund LEFT JOIN rich ON abund.Island = rich.Island AND abund.PlotID = rich.PlotID
       LEFT JOIN env ON abund.PlotID = env.PlotID
       WHERE Alien_abundance IS NOT NULL AND Native_abundance IS NOT NULL AND AlienAbund_Prop IS NOT NULL
         AND Alien_SppN IS NOT NULL AND Native_SppN IS NOT NULL AND AlienSppN_Prop IS NOT NULL
         AND Plot_Area IS NOT NULL AND MAT IS NOT NULL AND MAP IS NOT NULL AND Long_Dec IS NOT NULL)"""
ABUND_OUT = (
    "Island, PlotID, " + rs(["Plot_Area", "Alien_abundance", "Native_abundance", "Abundance_both", "AlienAbund_Prop"])
)
RICH_OUT = "Alien_SppN, Native_SppN, SppN_both, " + rs(["AlienSppN_Prop"])
ALIEN_NATIVE_SQL = (
    f"WITH {ALIEN_NATIVE} SELECT {ABUND_OUT}, {RICH_OUT}, {rs(ENV_DOUBLES)}, SubstrateAge_code FROM an"
)


def scores(names: dict[str, str], source: str, extra: str, digits: int = 6, tail: str = "") -> str:
    moments = ", ".join(f'avg("{c}") AS m_{c}, stddev_samp("{c}") AS s_{c}' for c in names)
    out = ", ".join(r(f'("{c}" - m_{c}) / nullif(s_{c}, 0)', s, digits) for c, s in names.items())
    return f"mom AS (SELECT {moments} FROM {source}) SELECT {extra}, {out} FROM {source}, mom {tail}"


LOCAL = f"loc AS ({view_sql('local')})"


def corr_sql(source: str, columns, with_test: bool) -> str:
    parts = []
    for a, b in combinations(columns, 2):
        test = (
            f", count(*) FILTER (WHERE \"{a}\" IS NOT NULL AND \"{b}\" IS NOT NULL) AS n" if with_test else ""
        )
        parts.append(
            f"SELECT '{a}' AS term_a, '{b}' AS term_b, corr(\"{a}\", \"{b}\") AS r{test} FROM {source}"
        )
    return " UNION ALL ".join(parts)


# Draws ---------------------------------------------------------------------

LONG = f"wide AS ({view_sql('draws_wide')}), lng AS (" + " UNION ALL ".join(
    f"SELECT chain, iteration, draw, '{t}' AS terms, \"{t}\" AS value FROM wide WHERE \"{t}\" IS NOT NULL"
    for t in DRAW_TERMS
) + ")"
INTERVALS = """
sorted AS (SELECT terms, value, row_number() OVER (PARTITION BY terms ORDER BY value) AS k,
                  count(*) OVER (PARTITION BY terms) AS n FROM lng WHERE terms <> 'b_Intercept'),
widths AS (SELECT CAST(0.68 AS DOUBLE) AS width UNION ALL SELECT CAST(0.95 AS DOUBLE)),
spans AS (SELECT a.terms, width, a.k, a.value AS lower, b.value AS upper
          FROM sorted a, widths, sorted b
          WHERE a.terms = b.terms AND b.k = a.k + CAST(floor(a.n * width) AS BIGINT)),
best AS (SELECT * FROM spans
         QUALIFY row_number() OVER (PARTITION BY terms, width ORDER BY upper - lower, k) = 1),
mid AS (SELECT terms, quantile_cont(value, 0.5) AS median FROM lng GROUP BY terms),
ivl AS (SELECT best.terms, width, median, lower, upper FROM best JOIN mid ON best.terms = mid.terms)"""
RHAT = """
halves AS (SELECT terms, chain, value, CASE WHEN k <= floor(n / 2.0) THEN 1 WHEN k > ceil(n / 2.0) THEN 2 END AS half
           FROM (SELECT *, row_number() OVER (PARTITION BY terms, chain ORDER BY iteration) AS k,
                        count(*) OVER (PARTITION BY terms, chain) AS n FROM lng) ranks),
hs AS (SELECT terms, avg(value) AS m, var_samp(value) AS v, count(*) AS n
       FROM halves WHERE half IS NOT NULL GROUP BY terms, chain, half),
rh AS (SELECT terms, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / nullif(avg(v), 0)) AS rhat
       FROM hs GROUP BY terms)"""


def six(value: str) -> str:
    return ", ".join(
        [
            r(f"min({value})", "min"), r(f"quantile_cont({value}, 0.25)", "q1"),
            r(f"quantile_cont({value}, 0.5)", "median"), r(f"avg({value})", "mean"),
            r(f"quantile_cont({value}, 0.75)", "q3"), r(f"max({value})", "max"),
        ]
    )


LOGLIK = f"ll AS ({view_sql('loglik')})"
WAIC = f"""
WITH {LOGLIK}, q AS (SELECT row_id, ln(avg(exp(ll))) AS lppd, var_samp(ll) AS p_waic FROM ll GROUP BY row_id)
SELECT row_id, {r('lppd', None, 8)}, {r('p_waic', None, 8)}, {r('lppd - p_waic', 'elpd', 8)},
       {r('-2 * (lppd - p_waic)', 'waic', 8)} FROM q"""
LOO = f"""
WITH {LOGLIK}, m AS (SELECT row_id, avg(exp(-ll)) AS mw, count(*) AS s FROM ll GROUP BY row_id),
t AS (SELECT ll.row_id, ll, least(exp(-ll), sqrt(s) * mw) AS w FROM ll JOIN m ON ll.row_id = m.row_id)
SELECT row_id, {r('ln(sum(w * exp(ll)) / sum(w))', 'elpd_loo')} FROM t GROUP BY row_id"""

# Space and phylogeny -------------------------------------------------------

OBS = f"obs AS ({view_sql('obs')})"
NEAR = f"""
{OBS}, pos AS (SELECT Long_Dec AS lon, Lat_Dec AS lat, count(*) AS plots, sum(y) AS total FROM obs GROUP BY 1, 2),
pairs AS (SELECT a.lon, a.lat, b.plots, b.total, {km('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d
          FROM pos a, pos b WHERE abs(a.lat - b.lat) < 0.3 AND NOT (a.lon = b.lon AND a.lat = b.lat)),
near AS (SELECT lon, lat, sum(plots) AS neighbours, min(d) AS nearest_km,
                sum(total / d) / sum(plots / d) AS rac
         FROM pairs WHERE d <= {RADIUS_KM} AND d > 0 GROUP BY 1, 2)"""

NEAR_COLUMNS = f"""
{OBS}, pos AS (SELECT Long_Dec AS lon, Lat_Dec AS lat, count(*) AS plots, sum(y) AS y, sum(x1) AS x1, sum(x2) AS x2 FROM obs GROUP BY 1, 2),
pairs AS (SELECT a.lon, a.lat, b.plots, b.y, b.x1, b.x2, {km('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d
          FROM pos a, pos b WHERE abs(a.lat - b.lat) < 0.3 AND NOT (a.lon = b.lon AND a.lat = b.lat)),
near AS (SELECT lon, lat, sum(y / d) / sum(plots / d) AS rac_y, sum(x1 / d) / sum(plots / d) AS rac_x1, sum(x2 / d) / sum(plots / d) AS rac_x2
         FROM pairs WHERE d <= {RADIUS_KM} AND d > 0 GROUP BY 1, 2)"""

PATHS = f"""
RECURSIVE edges AS ({view_sql('tree_edges')}),
tip AS (SELECT child AS tip FROM edges WHERE child NOT IN (SELECT parent FROM edges)),
walk AS (SELECT tip, child AS branch, parent AS up, length FROM edges JOIN tip ON child = tip
         UNION ALL
         SELECT w.tip, e.child, e.parent, e.length FROM walk w JOIN edges e ON e.child = w.up),
cov AS (SELECT a.tip AS tip_i, b.tip AS tip_j, sum(a.length) AS shared
        FROM walk a JOIN walk b ON a.branch = b.branch GROUP BY 1, 2)"""
# Folding a tree of three levels: suppliers, nations, regions.
LOG_DET = f"""
e AS ({view_sql('tree_edges')}),
l3 AS (SELECT parent, sum(1 / length) AS p, sum(ln(length)) AS ld, count(*) AS n
       FROM e WHERE child LIKE 's%' GROUP BY parent),
-- A nation without suppliers is a tip itself.
l2 AS (SELECT e.parent, sum(coalesce(p / (1 + length * p), 1 / length)) AS p,
              sum(coalesce(ld + ln(1 + length * p), ln(length))) AS ld, sum(coalesce(n, 1)) AS n
       FROM e LEFT JOIN l3 ON e.child = l3.parent WHERE e.child LIKE 'n%' GROUP BY e.parent),
ldet AS (SELECT sum(ld + ln(1 + length * p)) AS log_det, sum(n) AS n_tips FROM e JOIN l2 ON e.child = l2.parent)"""

# Regression ----------------------------------------------------------------

LINE = """
line AS (SELECT regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS b0, avg(x1) AS mx, count(*) AS n,
                var_pop(x1) * count(*) AS sxx,
                var_pop(y) * count(*) - regr_slope(y, x1) * covar_pop(y, x1) * count(*) AS rss FROM obs)"""
LINE_TERMS = f"""
SELECT 'b_Intercept' AS terms, {r('b0', 'estimate')},
       {r('sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx))', 'std_error')} FROM line
UNION ALL
SELECT 'b_x1', {nearest('b1', 6)}, {nearest('sqrt(rss / (n - 2) / sxx)', 6)} FROM line"""


def binary_fit(response: str, predictor: str, source: str, weight: str = "1.0") -> str:
    """A logistic fit on one binary predictor is the two group shares."""
    return f"""
    g AS (SELECT {predictor} AS b, sum({weight}) AS n, sum({weight} * {response}) / sum({weight}) AS mu
          FROM {source} GROUP BY 1),
    two AS (SELECT max(CASE WHEN b = 0 THEN ln(mu / (1 - mu)) END) AS l0,
                   max(CASE WHEN b = 1 THEN ln(mu / (1 - mu)) END) AS l1,
                   sum(CASE WHEN b = 0 THEN 1 / (n * mu * (1 - mu)) END) AS v0,
                   sum(CASE WHEN b = 1 THEN 1 / (n * mu * (1 - mu)) END) AS v1 FROM g)"""


def kfold_sql(predictor: str) -> str:
    return f"""
    SELECT o.row_id, CAST(o.row_id % 10 AS INT) AS fold,
           -0.5 * ln(2 * pi()) - ln(sd) - 0.5 * power((ln(y) - b0 - b1 * {predictor}) / sd, 2) - ln(y) AS elpd
    FROM obs o JOIN (
      SELECT fold, regr_intercept(ln(y), {predictor}) AS b0, regr_slope(ln(y), {predictor}) AS b1,
             sqrt((var_pop(ln(y)) - regr_slope(ln(y), {predictor}) * covar_pop(ln(y), {predictor}))
                  * count(*) / (count(*) - 2)) AS sd
      FROM obs, (SELECT unnest(range(10)) AS fold) f WHERE row_id % 10 <> fold GROUP BY fold) m
    ON o.row_id % 10 = m.fold"""


def intercepts_sql(level: str, response: str = "y") -> str:
    """One factor: variance components from mean squares, then shrunken level means."""
    return f"""
    {OBS}, {LINE.replace('y', response)},
    res AS (SELECT {level} AS level, {response} - b0 - b1 * x1 AS e FROM obs, line),
    lev AS (SELECT level, CAST(count(*) AS DOUBLE) AS n, avg(e) AS m, sum(power(e, 2)) - count(*) * power(avg(e), 2) AS ssw
            FROM res GROUP BY level),
    tot AS (SELECT sum(n) AS big_n, count(*) AS levels, sum(n * m) / sum(n) AS grand, sum(n * n) AS n2,
                   sum(ssw) / (sum(n) - count(*)) AS within FROM lev),
    bet AS (SELECT max(within) AS within, max(grand) AS grand,
                   greatest(0.0, (sum(n * power(m - grand, 2)) - (max(levels) - 1) * max(within))
                                 / (max(big_n) - max(n2) / max(big_n))) AS between
            FROM lev, tot),
    eff AS (SELECT level, n, CASE WHEN n * between + within > 0
                                  THEN n * between / (n * between + within) * (m - grand) ELSE 0 END AS estimate,
                   CASE WHEN n * between + within > 0
                        THEN sqrt(between * within / (n * between + within)) ELSE 0 END AS est_error
            FROM lev, bet)"""


def mixed_sql(folds: int | None = None) -> str:
    """y on x1 and x2 with plots as levels, by generalised least squares: one row of ``sol`` for all rows, or for all but each fold.

    With one factor the inverse covariance takes n / (n + ratio) of a level's mean out of it.
    """
    left_out = "(SELECT -1 AS f)" if folds is None else f"(SELECT unnest(range({folds})) AS f)"
    return f"""
    {OBS},
    raw AS (SELECT f, PlotID AS level, x1, x2, y FROM obs, {left_out} WHERE row_id % {folds or 1} <> f),
    mean AS (SELECT f, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM raw GROUP BY f),
    c AS (SELECT f, level, x1 - m1 AS a, x2 - m2 AS b, y - my AS v FROM raw JOIN mean USING (f)),
    lev AS (SELECT f, level, CAST(count(*) AS DOUBLE) AS n, sum(a) AS ta, sum(b) AS tb, sum(v) AS tv FROM c GROUP BY ALL),
    gram AS (SELECT f, CAST(count(*) AS DOUBLE) AS big_n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * v) AS av, sum(b * v) AS bv,
                    sum(v * v) AS vv FROM c GROUP BY f),
    ols AS (SELECT *, (av * bb - bv * ab) / (aa * bb - ab * ab) AS pa, (bv * aa - av * ab) / (aa * bb - ab * ab) AS pb FROM gram),
    sq AS (SELECT f, sum(power(tv - pa * ta - pb * tb, 2) / n) AS q, count(*) AS levels, sum(n * n) AS n2 FROM lev JOIN ols USING (f) GROUP BY f),
    within AS (SELECT *, (vv - pa * av - pb * bv - q) / (big_n - levels - 2) AS w FROM ols JOIN sq USING (f)),
    var AS (SELECT *, greatest(0.0, (q - (levels - 1) * w) / (big_n - n2 / big_n)) AS between FROM within),
    ratio AS (SELECT *, w / between AS k FROM var),
    taken AS (SELECT f, sum(n * n / (n + k)) AS n00, sum(n * ta / (n + k)) AS n0a, sum(n * tb / (n + k)) AS n0b, sum(n * tv / (n + k)) AS n0v,
                     sum(ta * ta / (n + k)) AS naa, sum(ta * tb / (n + k)) AS nab, sum(tb * tb / (n + k)) AS nbb,
                     sum(ta * tv / (n + k)) AS nav, sum(tb * tv / (n + k)) AS nbv FROM lev JOIN ratio USING (f) GROUP BY f),
    red AS (SELECT *, big_n - n00 AS g0, -n0a AS ga, -n0b AS gb, -n0v AS r0 FROM ratio JOIN taken USING (f)),
    inner_part AS (SELECT *, aa - naa - ga * ga / g0 AS saa, ab - nab - ga * gb / g0 AS sab, bb - nbb - gb * gb / g0 AS sbb,
                          av - nav - ga * r0 / g0 AS ra, bv - nbv - gb * r0 / g0 AS rb FROM red),
    slopes AS (SELECT *, saa * sbb - sab * sab AS det, (ra * sbb - rb * sab) / (saa * sbb - sab * sab) AS ba,
                      (rb * saa - ra * sab) / (saa * sbb - sab * sab) AS bb_ FROM inner_part),
    sol AS (SELECT slopes.*, m1, m2, my, (r0 - ga * ba - gb * bb_) / g0 AS bc, -m1 - ga / g0 AS wa, -m2 - gb / g0 AS wb FROM slopes JOIN mean USING (f)),
    eff AS (SELECT f, level, n, (tv - n * bc - ta * ba - tb * bb_) / (n + k) AS estimate, sqrt(w / (n + k)) AS est_error FROM lev JOIN sol USING (f))"""


# Root, regions, nations, suppliers: up and down the tree by its levels.
TREE_EFFECTS = f"""
e AS ({view_sql('tree_edges')}),
raw AS (SELECT tip, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s, sum(y * y) AS ss FROM ({view_sql('tip_rows')}) GROUP BY tip),
tot AS (SELECT sum(n) AS big_n, sum(s) / sum(n) AS mean, sum(ss) AS ss, count(*) AS k, sum(s * s / n) AS q FROM raw),
own AS (SELECT tip, n, s - n * mean AS s FROM raw, tot),
b3 AS (SELECT e.parent, e.child, e.length, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM e LEFT JOIN own ON own.tip = e.child WHERE e.child LIKE 's%'),
b2 AS (SELECT e.parent, e.child, e.length, coalesce(sum(b3.n), 0) AS n FROM e LEFT JOIN b3 ON b3.parent = e.child WHERE e.child LIKE 'n%' GROUP BY ALL),
b1 AS (SELECT e.parent, e.child, e.length, coalesce(sum(b2.n), 0) AS n FROM e LEFT JOIN b2 ON b2.parent = e.child WHERE e.child LIKE 'r%' GROUP BY ALL),
br AS (SELECT sum(length * n) AS own, sum(length * n * n) AS shared FROM (SELECT length, n FROM b1 UNION ALL SELECT length, n FROM b2 UNION ALL SELECT length, n FROM b3)),
w AS (SELECT (ss - q) / (big_n - k) AS w, big_n, mean, q, k FROM tot),
var AS (SELECT w, greatest(0.0, (q - big_n * mean * mean - (k - 1) * w) / (own - shared / big_n)) AS b FROM w, br),
u3 AS (SELECT parent, child, b * length AS v, n, n / w AS p, s / w AS h FROM b3, var),
u2 AS (SELECT b2.parent, b2.child, any_value(b * length) AS v, coalesce(sum(u3.p / (1 + u3.v * u3.p)), 0) AS p, coalesce(sum(u3.h / (1 + u3.v * u3.p)), 0) AS h
       FROM b2 CROSS JOIN var LEFT JOIN u3 ON u3.parent = b2.child GROUP BY b2.parent, b2.child),
u1 AS (SELECT b1.parent, b1.child, any_value(b * length) AS v, coalesce(sum(u2.p / (1 + u2.v * u2.p)), 0) AS p, coalesce(sum(u2.h / (1 + u2.v * u2.p)), 0) AS h
       FROM b1 CROSS JOIN var LEFT JOIN u2 ON u2.parent = b1.child GROUP BY b1.parent, b1.child),
d1 AS (SELECT child, v * h / (1 + v * p) AS m, v / (1 + v * p) AS var FROM u1),
d2 AS (SELECT u2.child, (m + v * h) / (1 + v * p) AS m, v / (1 + v * p) + var / power(1 + v * p, 2) AS var FROM u2 JOIN d1 ON d1.child = u2.parent),
d3 AS (SELECT u3.child, n, (m + v * h) / (1 + v * p) AS m, v / (1 + v * p) + var / power(1 + v * p, 2) AS var FROM u3 JOIN d2 ON d2.child = u3.parent),
ends AS (SELECT child, n, m, var FROM d3 UNION ALL SELECT child, 0.0, m, var FROM d2 WHERE child NOT IN (SELECT parent FROM e)
         UNION ALL SELECT child, 0.0, m, var FROM d1 WHERE child NOT IN (SELECT parent FROM e))"""
DRAWS = 8000
# Draws of a line's two coefficients: the Cholesky root of their covariance times two normal deviates.
LINE_DRAWS = f"""
par AS (SELECT b0, b1, sqrt(rss / (n - 2)) AS sd, sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)) AS s0,
               sqrt(rss / (n - 2) / sxx) AS s1, -mx * rss / (n - 2) / sxx AS c01 FROM line),
dr AS (SELECT draw, b0 + s0 * z0 AS d0, b1 + c01 / s0 * z0 + sqrt(s1 * s1 - c01 * c01 / (s0 * s0)) * z1 AS d1, {mix64_sql('draw::UBIGINT')} AS h
       FROM par, (SELECT draw, {normal_sql('1::BIGINT', 'draw', 1)} AS z0, {normal_sql('2::BIGINT', 'draw', 1)} AS z1
                  FROM (SELECT unnest(range(1, {DRAWS} + 1)) AS draw) k) z)"""
# Rows with their own part of the noise; every area's effect in every draw.
LINE_ROWS = f"""
rw AS (SELECT row_id, Plot_Area2, x1, y, {salted_sql(row_key_sql("row_id"), 0, 1)} AS h0, {salted_sql(row_key_sql("row_id"), 1, 1)} AS h1 FROM obs),
lk AS (SELECT level, estimate, est_error, {salted_sql(row_key_sql("'Plot_Area2|' || level"), LEVEL, 1)} AS h0,
              {salted_sql(row_key_sql("'Plot_Area2|' || level"), LEVEL + 1, 1)} AS h1 FROM eff),
el AS (SELECT dr.*, lk.level, estimate + est_error * {deviate_sql('lk.h0', 'lk.h1', 'dr.h')} AS lev FROM lk, dr)"""


def line_model(response: str) -> str:
    """Line on x1 with area effects, its draws and its rows."""
    return f"{intercepts_sql('Plot_Area2', response)}, {LINE_DRAWS}, {LINE_ROWS}"


SIMULATED = f"exp(d0 + d1 * x1 + lev + sd * {deviate_sql('rw.h0', 'rw.h1', 'el.h')})"
# Every row with every draw of the effect of its area.
ROWS_BY_DRAWS = "rw JOIN el ON rw.Plot_Area2 = el.level"
SUMMARY_4 = (
    r("avg(v)", "estimate", 4) + ", " + r("stddev_samp(v)", "est_error", 4) + ", "
    + r("quantile_cont(v, 0.025)", "q2_5", 4) + ", " + r("quantile_cont(v, 0.975)", "q97_5", 4)
)
# What the simulated outcomes of every row average to; only the mean is needed.
DRAWN_ACCURACY = f"""
pred AS (SELECT rw.Plot_Area2, (avg({SIMULATED}) - any_value(y)) / any_value(y) AS a FROM {ROWS_BY_DRAWS}, par GROUP BY row_id, rw.Plot_Area2)"""


# Expansion of the 97.5 % t quantile in 1/df; exact to six places above 100 df.
T_CRIT = (
    f"({Z_95} * (1 + ({Z_95**2} + 1) / (4.0 * (n - 1)) "
    f"+ ({5 * Z_95**4 + 16 * Z_95**2 + 3}) / (96.0 * power(n - 1, 2)) "
    f"+ ({3 * Z_95**6 + 19 * Z_95**4 + 17 * Z_95**2 - 15}) / (384.0 * power(n - 1, 3))))"
)


def accuracy_sql(value: str, source: str) -> str:
    return f"""
    acc AS (SELECT Plot_Area2, avg({value}) AS xbar, stddev_samp({value}) AS s, count(*) AS n
            FROM {source} GROUP BY 1),
    accuracy AS (SELECT Plot_Area2, xbar AS accuracy_xbar, xbar - {T_CRIT} * s / sqrt(n) AS accuracy_lwr,
                        xbar + {T_CRIT} * s / sqrt(n) AS accuracy_upr FROM acc)"""


PRESENCE_ACCURACY = f"""
gp AS (SELECT urgent, avg(PresAbs) AS mu FROM obs GROUP BY 1),
pred AS (SELECT Plot_Area2, mu AS estimate FROM obs JOIN gp ON obs.urgent = gp.urgent),
{accuracy_sql('(estimate - 0.5) / 0.5', 'pred')}"""
ABUNDANCE_ACCURACY = f"""
ln1 AS (SELECT regr_intercept(ln(y), x1) AS b0, regr_slope(ln(y), x1) AS b1,
               (var_pop(ln(y)) - regr_slope(ln(y), x1) * covar_pop(ln(y), x1)) * count(*) / (count(*) - 2) AS s2
        FROM obs),
pred AS (SELECT Plot_Area2, (exp(b0 + b1 * x1 + s2 / 2) - y) / y AS a FROM obs, ln1),
{accuracy_sql('a', 'pred')}"""
PRECISION = f"""
prec AS (SELECT level AS Plot_Area2, estimate, estimate - {Z_95} * est_error AS q2_5,
                estimate + {Z_95} * est_error AS q97_5, 1 / nullif(est_error, 0) AS precision,
                CAST(n AS BIGINT) AS N FROM eff)"""
ACC_NAMES = ("accuracy_xbar", "accuracy_lwr", "accuracy_upr")
PREC_NAMES = ("estimate", "q2_5", "q97_5", "precision")


def oracle_sql() -> dict[str, str]:
    plots, env, obs = view_sql("plot_species"), view_sql("env_raw"), view_sql("obs")
    raw_env = (
        "PlotIDn, "
        + rs(["Long_Dec", "Lat_Dec", "newMAT", "newMAP", "newElev", "newVPD", "newPET", "newAridInd",
              "HFP", "HII", "SubstrateAge_range"])
        + ", SubstrateAge_code"
    )
    local_flip = (
        "flip AS (SELECT * REPLACE (-AridInd AS AridInd), "
        "CASE WHEN SubstrateAge_range > 0 THEN ln(SubstrateAge_range) END AS SubstrateAge_range_lg FROM {})"
    )
    products = ", ".join(r(f"{c} * {t}", f"{c}:{t}") for t in RAW_MAIN[4:] for c in RAW_MAIN[:4])
    first_25 = ["b_Intercept", *[f"b_{c}" for c in RAW_MAIN]] + [
        f"b_{c}:{t}" for t in RAW_MAIN[4:] for c in RAW_MAIN[:4]
    ]
    vif_parts = []
    for x, (a, b) in {"x1": ("x2", "x3"), "x2": ("x1", "x3"), "x3": ("x1", "x2")}.items():
        vif_parts.append(
            f"SELECT '{x}' AS term, "
            + r(
                f"(1 - power(corr({a}, {b}), 2)) / (1 + 2 * corr(x1, x2) * corr(x1, x3) * corr(x2, x3) "
                "- power(corr(x1, x2), 2) - power(corr(x1, x3), 2) - power(corr(x2, x3), 2))",
                "vif",
            )
            + " FROM obs"
        )
    kfold = f"WITH {OBS}, k AS ({kfold_sql('x1')}) SELECT row_id, fold, {r('elpd')} FROM k"
    return {
        "alien_native": ALIEN_NATIVE_SQL,
        "alien_native_stepwise": ALIEN_NATIVE_SQL,
        "csv_roundtrip": plots,
        "parquet_roundtrip": f"SELECT {raw_env} FROM ({env}) e",
        "tree_roundtrip": f"SELECT parent, child, {r('length')} FROM ({view_sql('tree_edges')}) e",
        "environment": f"WITH {ENV} SELECT PlotID, {rs(ENV_DOUBLES)}, SubstrateAge_code FROM env",
        "native_plot_select": f"WITH {PLOTS}, {SELECTED} SELECT * FROM p",
        "native_totals": (
            f"WITH {PLOTS} SELECT PlotID, sum(Abundance_ha) AS Abund_Tot FROM ps WHERE Native_Status = 'native' "
            "GROUP BY PlotID HAVING count(*) = count(Abundance_ha) AND sum(Abundance_ha) > 0"
        ),
        "plot_sizes": f"WITH {PLOTS} SELECT DISTINCT PlotID, Plot_Area FROM ps",
        "status_abundance": (
            f"WITH {PLOTS} SELECT Island, PlotID, Native_Status, "
            "CASE WHEN count(*) = count(Abundance_ha) THEN sum(Abundance_ha) END AS Abundance "
            "FROM ps GROUP BY 1, 2, 3"
        ),
        "status_abundance_pivot": f"WITH {PLOTS}, {shares_sql('ps')} SELECT {ABUND_OUT} FROM abund",
        "status_richness": (
            f"WITH {PLOTS} SELECT Island, PlotID, Native_Status, count(DISTINCT SPP_CODE3A) + "
            "max(CASE WHEN SPP_CODE3A IS NULL THEN 1 ELSE 0 END) AS SppN "
            "FROM ps WHERE Abundance_ha > 0 GROUP BY 1, 2, 3"
        ),
        "richness_sketch": (
            f"WITH {PLOTS} SELECT Island, Native_Status, count(DISTINCT SPP_CODE3A) + "
            "max(CASE WHEN SPP_CODE3A IS NULL THEN 1 ELSE 0 END) AS SppN, true AS within FROM ps WHERE Abundance_ha > 0 GROUP BY 1, 2"
        ),
        "quantile_sketch": f"WITH {LONG} SELECT terms, count(*) AS n, true AS q2_5, true AS q50, true AS q97_5 FROM lng GROUP BY terms",
        "richness_pivot": f"WITH {PLOTS}, {richness_sql('ps')} SELECT Island, PlotID, {RICH_OUT} FROM rich",
        "complete_cases": f"SELECT {raw_env} FROM ({env}) e WHERE newMAT IS NOT NULL",
        "qc_counts": (
            f"WITH {PLOTS} SELECT count(DISTINCT PlotID) AS \"n_PlotID\", "
            "count(DISTINCT SPP_CODE3A) + max(CASE WHEN SPP_CODE3A IS NULL THEN 1 ELSE 0 END) AS \"n_SPP_CODE3A\", "
            "count(DISTINCT Plot_Area) AS \"n_Plot_Area\" FROM ps"
        ),
        "species_and_tips": f"""
            WITH {PLOTS}, {LOCAL}, a AS (SELECT DISTINCT SPP_CODE3A AS x FROM ps WHERE SPP_CODE3A IS NOT NULL),
            b AS (SELECT DISTINCT tip_label AS x FROM loc WHERE tip_label IS NOT NULL),
            c AS (SELECT (SELECT count(*) FROM a WHERE x NOT IN (SELECT x FROM b)) AS only_a,
                         (SELECT count(*) FROM b WHERE x NOT IN (SELECT x FROM a)) AS only_b,
                         (SELECT count(*) FROM a WHERE x IN (SELECT x FROM b)) AS shared)
            SELECT only_a, only_b, shared, only_a = 0 AND only_b = 0 AS equal FROM c""",
        "rows_per_area": f"SELECT Plot_Area2, count(*) AS N FROM ({obs}) o GROUP BY 1",
        "model_frame": (
            f"SELECT draw AS row_id, {rs(['b_AridInds', 'b_MATs'])} FROM ({view_sql('draws_wide')}) w "
            "WHERE \"b_AridInds\" IS NOT NULL AND \"b_MATs\" IS NOT NULL"
        ),
        "zscore_then_filter": (
            f"WITH {ALIEN_NATIVE}, {local_flip.format('an')}, "
            + scores(SCORES, "flip", "PlotID, CAST(Plot_Area AS STRING) AS Plot_Area",
                     tail="WHERE Alien_abundance > 0")
        ),
        "species_zscores": (
            f"WITH {LOCAL}, one AS (SELECT * FROM loc WHERE PDmeasure = 'MDWNC'), {local_flip.format('one')}, "
            + scores(
                {**SCORES, **TRAITS}, "flip",
                "row_id, tip_label AS phylo, tip_label AS species, CAST(Plot_Area AS STRING) AS Plot_Area2", 5,
            )
        ),
        "rel_abundance": (
            f"WITH {LOCAL} SELECT row_id, PDmeasure, "
            f"{r('Abundance_ha / nullif(Total_Abundance_ha, 0)', 'RelAbund')} FROM loc"
        ),
        "flipped_and_logged": (
            f"WITH {LOCAL}, {local_flip.format('loc')} SELECT row_id, {rs(['AridInd', 'SubstrateAge_range_lg'])} FROM flip"
        ),
        "interaction_terms": (
            f"WITH {LOCAL} SELECT row_id, concat(CAST(Plot_Area AS STRING), ':', PlotID) AS \"Plot_Area:PlotID\", "
            f"{products} FROM loc"
        ),
        "corr_pairs": (
            f"WITH {LOCAL}, c AS ({corr_sql('loc', RAW_MAIN, True)}) SELECT term_a, term_b, n, {r('r')}, "
            f"{r('r * sqrt((n - 2) / (1 - r * r))', 't')}, abs(r) >= 0.7 AS high FROM c"
        ),
        "vif3": f"WITH {OBS} " + " UNION ALL ".join(vif_parts),
        "draws_long": (
            f"WITH {LONG} SELECT chain, iteration, draw, terms, {r('value')} FROM lng WHERE terms <> 'b_Intercept'"
        ),
        "draws_spread": (
            f"WITH wide AS ({view_sql('draws_wide')}) SELECT chain, iteration, draw, "
            f"{rs(['b_AridInds', 'b_MATs', 'b_MATs:PD_stands'])} FROM wide"
        ),
        "hdi_terms": f"WITH {LONG}, {INTERVALS} SELECT terms, width, {rs(['median', 'lower', 'upper'])} FROM ivl",
        "interval_figure": (
            f"WITH {LONG}, {INTERVALS} SELECT terms, {r('max(median)', 'median')}, "
            + ", ".join(
                r(f"max({side}) FILTER (WHERE width = CAST({w} AS DOUBLE))", f"{side}_{tag}")
                for w, tag in (("0.68", "68"), ("0.95", "95")) for side in ("lower", "upper")
            )
            + " FROM ivl GROUP BY terms"
        ),
        "select_terms": (
            f"WITH {LONG}, {INTERVALS} SELECT terms, width, {rs(['median', 'lower', 'upper'])} FROM ivl "
            "WHERE width > 0.9 AND (lower > 0 OR upper < 0 OR terms NOT LIKE '%:%')"
        ),
        "split_rhat": f"WITH {LONG}, {RHAT} SELECT terms, {r('rhat')} FROM rh",
        "rhat_summary": f"WITH {LONG}, {RHAT} SELECT {six('rhat')} FROM rh",
        "six_number": f"WITH {LONG} SELECT terms, {six('value')} FROM lng GROUP BY terms",
        "term_summary": (
            f"WITH {LONG}, {RHAT}, s AS (SELECT terms, avg(value) AS estimate, stddev_samp(value) AS est_error, "
            "quantile_cont(value, 0.025) AS q2_5, quantile_cont(value, 0.975) AS q97_5 FROM lng GROUP BY terms) "
            f"SELECT s.terms, {rs(['estimate', 'est_error', 'q2_5', 'q97_5', 'rhat'])} "
            "FROM s JOIN rh ON s.terms = rh.terms"
        ),
        "draw_corr": (
            f"WITH wide AS ({view_sql('draws_wide')}), c AS ({corr_sql('wide', DRAW_TERMS, False)}) "
            f"SELECT term_a, term_b, {r('r')} FROM c"
        ),
        "divergences": (
            f"SELECT CAST(sum(Value) AS BIGINT) AS divergent FROM ({view_sql('diagnostics')}) d WHERE Parameter = 'divergent__'"
        ),
        "divergences_by_chain": (
            f"SELECT chain, CAST(sum(Value) AS BIGINT) AS divergent FROM ({view_sql('diagnostics')}) d "
            "WHERE Parameter = 'divergent__' GROUP BY chain"
        ),
        "waic_points": WAIC,
        "loo_points": LOO,
        "great_circle": (
            f"WITH {OBS} SELECT row_id, {r(km('Long_Dec', 'Lat_Dec', '-157.85', '21.3'), 'km')} FROM obs"
        ),
        "neighbour_stats": (
            f"WITH {NEAR} SELECT row_id, CAST(coalesce(neighbours, 0) AS BIGINT) AS neighbours, {r('nearest_km')} "
            "FROM obs LEFT JOIN near ON Long_Dec = lon AND Lat_Dec = lat"
        ),
        "autocovariate": (
            f"WITH {NEAR} SELECT row_id, {r('coalesce(rac, 0)', 'rac')} "
            "FROM obs LEFT JOIN near ON Long_Dec = lon AND Lat_Dec = lat"
        ),
        "autocovariate_columns": (
            f"WITH {NEAR_COLUMNS} SELECT row_id, {r('coalesce(rac_y, 0)', 'rac_y')}, {r('coalesce(rac_x1, 0)', 'rac_x1')}, "
            f"{r('coalesce(rac_x2, 0)', 'rac_x2')} FROM obs LEFT JOIN near ON Long_Dec = lon AND Lat_Dec = lat"
        ),
        "tree_vcv": f"WITH {PATHS} SELECT tip_i, tip_j, {r('shared')} FROM cov",
        "tree_log_det": f"WITH {LOG_DET} SELECT {r('log_det')}, CAST(n_tips AS BIGINT) AS n_tips FROM ldet",
        "tree_effects": f"""
            WITH {TREE_EFFECTS} SELECT child AS tip, {r('CAST(n AS DOUBLE)', 'n', 5)}, {r('m', 'estimate', 5)}, {r('sqrt(ends.var)', 'est_error', 5)},
            {r('sqrt(b)', 'group_sd', 5)}, {r('sqrt(w)', 'residual_sd', 5)} FROM ends, var""",
        "tree_times": f"WITH {PATHS} SELECT tip_i AS tip, {r('sum(shared)', 'y')} FROM cov GROUP BY tip_i",
        "scaled_vcv": (
            f"WITH {PATHS}, {LOG_DET} SELECT tip_i, tip_j, {r('shared * exp(-log_det / n_tips)', 'shared')} "
            "FROM cov, ldet"
        ),
        "ols_lognormal": f"""
            WITH {OBS}, s AS (SELECT avg(ln(y)) AS my, avg(x1) AS m1, avg(x2) AS m2,
                covar_pop(x1, ln(y)) AS c1, covar_pop(x2, ln(y)) AS c2, var_pop(x1) AS v1, var_pop(x2) AS v2,
                covar_pop(x1, x2) AS v12 FROM obs),
            b AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1,
                            (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM s)
            SELECT 'b_Intercept' AS terms, {r('my - b1 * m1 - b2 * m2', 'estimate')} FROM b
            UNION ALL SELECT 'b_x1', {nearest('b1', 6)} FROM b UNION ALL SELECT 'b_x2', {nearest('b2', 6)} FROM b""",
        "ols_gaussian": f"WITH {OBS}, {LINE} {LINE_TERMS}",
        "glm_logit": f"""
            WITH {OBS}, {binary_fit('PresAbs', 'urgent', 'obs')}
            SELECT 'b_Intercept' AS terms, {r('l0', 'estimate')}, {r('sqrt(v0)', 'std_error')} FROM two
            UNION ALL SELECT 'b_urgent', {nearest('l1 - l0', 6)}, {nearest('sqrt(v0 + v1)', 6)} FROM two""",
        "fractional_logit": f"""
            WITH {OBS}, {binary_fit('y', 'urgent', 'obs')},
            d AS (SELECT sum(power(y - mu, 2) / (mu * (1 - mu))) / (count(*) - 2) AS phi
                  FROM obs JOIN g ON obs.urgent = g.b)
            SELECT 'b_Intercept' AS terms, {r('l0', 'estimate', 5)}, {r('sqrt(v0 * phi)', 'std_error', 5)},
                   {r('1 / phi - 1', 'precision', 5)} FROM two, d
            UNION ALL SELECT 'b_urgent', {nearest('l1 - l0', 5)}, {nearest('sqrt((v0 + v1) * phi)', 5)},
                   {nearest('1 / phi - 1', 5)} FROM two, d""",
        "binomial_trials": f"""
            WITH {PLOTS}, {richness_sql('ps')}, fr AS (SELECT *, CASE WHEN Island = '0' THEN 1.0 ELSE 0.0 END AS isl
                FROM rich WHERE SppN_both > 0),
            {binary_fit('AlienSppN_Prop', 'isl', 'fr', 'SppN_both')}
            SELECT 'b_Intercept' AS terms, {r('l0', 'estimate')}, {r('sqrt(v0)', 'std_error')} FROM two
            UNION ALL SELECT 'b_first_island', {nearest('l1 - l0', 6)}, {nearest('sqrt(v0 + v1)', 6)} FROM two""",
        "zoib_mass": f"""
            WITH {OBS} SELECT {r("avg(CASE WHEN y01 IN (0, 1) THEN 1.0 ELSE 0.0 END)", "zoi")},
            {r("avg(CASE WHEN y01 = 1 THEN 1.0 WHEN y01 = 0 THEN 0.0 END)", "coi")} FROM obs""",
        "fit_roundtrip": (
            f"WITH {OBS}, {LINE}, {LINE_DRAWS}, t AS ({LINE_TERMS}), k AS (SELECT count(*) AS draws, {r('avg(d0 * draw)', 'drawn_b0', 4)}, "
            f"{r('avg(d1 * draw)', 'drawn_b1', 4)} FROM dr) SELECT t.*, line.n AS frame_rows, k.* FROM t, line, k"
        ),
        "first_terms": "SELECT * FROM (VALUES "
        + ", ".join(f"({i + 1}, '{t}')" for i, t in enumerate(first_25[:25]))
        + ") t(pos, terms)",
        "kfold_points": kfold,
        "elpd_compare": f"""
            WITH {OBS}, a AS ({kfold_sql('x1')}), b AS ({kfold_sql('x2')}),
            d AS (SELECT a.elpd AS ea, b.elpd AS eb, a.elpd - b.elpd AS d FROM a JOIN b ON a.row_id = b.row_id)
            SELECT {r('sum(ea)', 'elpd_a', 4)}, {r('sum(eb)', 'elpd_b', 4)}, {r('sum(d)', 'elpd_diff', 4)},
                   {r('sqrt(count(*)) * stddev_samp(d)', 'se_diff', 4)} FROM d""",
        "beta_density": f"""
            WITH {OBS} SELECT row_id, {r(
                "lgamma(4.0) - lgamma(4 * x1 / 10) - lgamma(4 * (1 - x1 / 10)) "
                "+ (4 * x1 / 10 - 1) * ln(y) + (4 * (1 - x1 / 10) - 1) * ln(1 - y)", "ll")} FROM obs""",
        "inverse_links": f"""
            WITH {OBS} SELECT row_id, {r('1 / (1 + exp(2 - x1))', 'logit')}, {r('exp(x2 + 0.125)', 'lognormal')},
            {r('CASE WHEN x2 - 0.5 > 0 THEN ln(x2 - 0.5) END', 'ln')} FROM obs""",
        "shrunk_intercepts": f"""
            WITH {intercepts_sql('PlotID')} SELECT level, {rs(['n', 'estimate', 'est_error'], 5)},
            {r(f'estimate - {Z_95} * est_error', 'q2_5', 5)}, {r(f'estimate + {Z_95} * est_error', 'q97_5', 5)}
            FROM eff""",
        "mixed_line": f"""
            WITH {mixed_sql()}
            SELECT 'b_Intercept' AS terms, {r('my + bc - ba * m1 - bb_ * m2', 'estimate', 5)},
                   {r('sqrt(w * (1 / g0 + (wa * wa * sbb - 2 * wa * wb * sab + wb * wb * saa) / det))', 'std_error', 5)},
                   {r('sqrt(between)', 'group_sd', 5)}, {r('sqrt(w)', 'residual_sd', 5)} FROM sol
            UNION ALL SELECT 'b_x1', {nearest('ba', 5)}, {nearest('sqrt(w * sbb / det)', 5)}, {nearest('sqrt(between)', 5)}, {nearest('sqrt(w)', 5)} FROM sol
            UNION ALL SELECT 'b_x2', {nearest('bb_', 5)}, {nearest('sqrt(w * saa / det)', 5)}, {nearest('sqrt(between)', 5)}, {nearest('sqrt(w)', 5)} FROM sol""",
        "mixed_levels": f"WITH {mixed_sql()} SELECT level, {rs(['n', 'estimate', 'est_error'], 5)} FROM eff",
        "vif_grouped": f"""
            WITH {mixed_sql()} SELECT unnest(['x1', 'x2']) AS term, {r('1 / (1 - sab * sab / (saa * sbb))', 'vif', 5)} FROM sol""",
        "kfold_levels": f"""
            WITH {mixed_sql(5)},
            p AS (SELECT row_id, CAST(row_id % 5 AS INT) AS fold, y - my - bc - ba * (x1 - m1) - bb_ * (x2 - m2) - coalesce(estimate, 0) AS e,
                         w + coalesce(power(est_error, 2), between) AS s2
                  FROM obs JOIN sol ON obs.row_id % 5 = sol.f LEFT JOIN eff ON eff.f = sol.f AND eff.level = obs.PlotID)
            SELECT row_id, fold, {r('-0.5 * (e * e / s2 + ln(s2) + ln(2 * pi()))', 'elpd', 5)} FROM p""",
        "approx_draws": f"""
            WITH {OBS}, {LINE.replace('y', 'ln(y)')}, {LINE_DRAWS}
            SELECT CAST(floor((draw - 1) / 2000.0) + 1 AS INT) AS chain, CAST((draw - 1) % 2000 + 1 AS INT) AS iteration,
                   CAST(draw AS INT) AS draw, {r('d0', 'b_Intercept')}, {r('d1', 'b_x1')} FROM dr""",
        "predict_rows": f"""
            WITH {line_model('ln(y)')}, v AS (SELECT row_id, {SIMULATED} AS v FROM {ROWS_BY_DRAWS}, par)
            SELECT row_id, {SUMMARY_4} FROM v GROUP BY row_id""",
        "residual_summary": f"""
            WITH {line_model('y')}, v AS (SELECT row_id, y - (d0 + d1 * x1 + lev) AS v FROM {ROWS_BY_DRAWS})
            SELECT row_id, {SUMMARY_4} FROM v GROUP BY row_id""",
        "bayes_r2": f"""
            WITH {line_model('y')}, m AS (SELECT draw, d0 + d1 * x1 + lev AS mu, y FROM {ROWS_BY_DRAWS}),
            v AS (SELECT var_pop(mu) / (var_pop(mu) + var_pop(y - mu)) AS v FROM m GROUP BY draw)
            SELECT {SUMMARY_4} FROM v""",
        "conditional_grid": f"""
            WITH {OBS}, {LINE.replace('y', 'ln(y)')}, {LINE_DRAWS},
            g AS (SELECT low + k * (high - low) / 99 AS x1 FROM (SELECT min(x1) AS low, max(x1) AS high FROM obs) s,
                  (SELECT unnest(range(100)) AS k) n),
            v AS (SELECT x1, exp(d0 + d1 * x1 + sd * sd / 2) AS v FROM g, dr, par)
            SELECT {r('x1')}, {SUMMARY_4} FROM v GROUP BY v.x1""",
        "ppc_bins": f"""
            WITH {line_model('ln(y)')},
            few AS (SELECT draw, row_number() OVER (ORDER BY draw) AS k FROM (
                    SELECT * FROM dr ORDER BY {mix_sql(f'xor(draw, {salt(9, 1)}::BIGINT)')}, draw LIMIT 100) c),
            sp AS (SELECT ln(min(y)) AS low, ln(max(y)) AS high FROM obs),
            vals AS (SELECT 0 AS draw, ln(y) AS v FROM obs UNION ALL
                     SELECT k, ln({SIMULATED}) FROM {ROWS_BY_DRAWS} JOIN few ON el.draw = few.draw, par),
            cnt AS (SELECT draw, CASE WHEN v < low THEN 0 WHEN v > high THEN 31
                                      ELSE least(30, CAST(floor((v - low) / (high - low) * 30) AS INT) + 1) END AS bin, count(*) AS n
                    FROM vals, sp GROUP BY 1, 2),
            every AS (SELECT draw, bin FROM (SELECT unnest(range(101)) AS draw) a, (SELECT unnest(range(32)) AS bin) b)
            SELECT CAST(e.draw AS INT) AS draw, CAST(e.bin AS INT) AS bin, coalesce(n, 0) AS rows,
                   {r('CASE WHEN e.bin > 0 THEN low + (e.bin - 1) * (high - low) / 30 END', 'lower')},
                   {r('CASE WHEN e.bin < 31 THEN low + e.bin * (high - low) / 30 END', 'upper')}
            FROM every e LEFT JOIN cnt ON e.draw = cnt.draw AND e.bin = cnt.bin, sp""",
        "accuracy_from_draws": f"""
            WITH {line_model('ln(y)')}, {DRAWN_ACCURACY}, {accuracy_sql('a', 'pred')}
            SELECT Plot_Area2, {rs(ACC_NAMES, 4)} FROM accuracy""",
        "fit_predictive": f"""
            WITH {line_model('ln(y)')},
            ll AS (SELECT row_id, -0.5 * power((ln(y) - d0 - d1 * x1 - lev) / sd, 2) - ln(sd) - 0.5 * ln(2 * pi()) - ln(y) AS ll FROM {ROWS_BY_DRAWS}, par),
            q AS (SELECT row_id, ln(avg(exp(ll))) AS lppd, var_samp(ll) AS p_waic, avg(exp(-ll)) AS mw FROM ll GROUP BY row_id),
            t AS (SELECT ll.row_id, ll, least(exp(-ll), sqrt({DRAWS}) * mw) AS w FROM ll JOIN q ON ll.row_id = q.row_id),
            loo AS (SELECT row_id, ln(sum(w * exp(ll)) / sum(w)) AS elpd_loo FROM t GROUP BY row_id)
            SELECT q.row_id, {rs(['lppd', 'p_waic'], 5)}, {r('lppd - p_waic', 'elpd', 5)}, {r('-2 * (lppd - p_waic)', 'waic', 5)},
                   {r('elpd_loo', None, 5)} FROM q JOIN loo ON q.row_id = loo.row_id""",
        "residual_mean": f"WITH {OBS}, {LINE} SELECT row_id, {r('y - b0 - b1 * x1', 'residual')} FROM obs, line",
        "accuracy_by_area": f"WITH {OBS}, {PRESENCE_ACCURACY} SELECT Plot_Area2, {rs(ACC_NAMES)} FROM accuracy",
        "relative_error_by_area": (
            f"WITH {OBS}, {ABUNDANCE_ACCURACY} SELECT Plot_Area2, {rs(ACC_NAMES, 5)} FROM accuracy"
        ),
        "precision_by_area": (
            f"WITH {intercepts_sql('Plot_Area2')}, {PRECISION} SELECT Plot_Area2, {rs(PREC_NAMES, 5)}, N FROM prec"
        ),
        "scale_table": (
            f"WITH {intercepts_sql('Plot_Area2')}, {PRECISION}, {PRESENCE_ACCURACY} "
            f"SELECT CAST(accuracy.Plot_Area2 AS DOUBLE) AS Plot_Area2, {rs(ACC_NAMES + PREC_NAMES, 5)}, "
            f"N, {r('ln(N)', 'log_n', 5)} FROM accuracy LEFT JOIN prec ON accuracy.Plot_Area2 = prec.Plot_Area2"
        ),
    }
