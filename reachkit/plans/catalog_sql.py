"""DuckDB SQL for the registered queries: the independent cross-check.

Each text computes, with plain SQL over the raw test tables, what the matching
entry of ``catalog.QUERIES`` computes with the operators: the reference
semantics written the direct way (row windows per id, range joins, a recursive
CTE for the VID chain).  Spark's string hash (Murmur3 x86_32, seed 42, over the
UTF-8 bytes; ASCII inputs here) is spelled out with DuckDB list lambdas.
"""

from __future__ import annotations

import calendar
import time

from reachkit.operators.datagen import LOMAX_ALPHA, LOMAX_M
from reachkit.plans import catalog as C

M32 = "4294967295::UBIGINT"
# Murmur3 x86_32 constants.
MURMUR_C1 = 3432918353
MURMUR_C2 = 461845907
MURMUR_N = 3864292196
MURMUR_F1 = 2246822507
MURMUR_F2 = 3266489909


def _bind(expr: str, var: str, body: str) -> str:
    return f"(list_transform([{expr}], lambda {var}: {body})[1])"


def _rotl(v: str, r: int) -> str:
    return f"((({v}) << {r}) | (({v}) >> {32 - r})) & {M32}"


def spark_hash(x: str) -> str:
    """Spark ``hash(CAST(x AS STRING))`` as a BIGINT-valued DuckDB expression."""
    byte = "ascii(substr(s, ({p})::INTEGER, 1))::UBIGINT"
    word = " | ".join(
        f"({byte.format(p=f'i*4+{j + 1}')} << {8 * j})" for j in range(4))
    blocks = (f"list_concat(list_transform(range(0, length(s) // 4), lambda i: {word}), "
              f"list_transform(range((length(s) // 4) * 4, length(s)), lambda i: {byte.format(p='i+1')}))")
    k1 = f"((({_rotl(f'(w * {MURMUR_C1}::UBIGINT) & {M32}', 15)}) * {MURMUR_C2}::UBIGINT) & {M32})"
    ks = f"list_transform({blocks}, lambda w: {k1})"
    h = (f"list_reduce({ks}, lambda acc, k: ((({_rotl('xor(acc, k)', 13)}) * 5::UBIGINT) "
         f"+ {MURMUR_N}::UBIGINT) & {M32}, 42::UBIGINT)")
    f1 = _bind(f"xor({h}, length(s)::UBIGINT)", "a", f"xor(a, a >> 16)")
    f2 = _bind(f"({f1} * {MURMUR_F1}::UBIGINT) & {M32}", "b", "xor(b, b >> 13)")
    f3 = _bind(f"({f2} * {MURMUR_F2}::UBIGINT) & {M32}", "c", "xor(c, c >> 16)")
    signed = _bind(f3, "u", "CASE WHEN u >= 2147483648 THEN u::BIGINT - 4294967296 ELSE u::BIGINT END")
    return _bind(f"({x})::VARCHAR", "s", f"CASE WHEN s IS NULL THEN 42::BIGINT ELSE {signed} END")


def uniform(x: str) -> str:
    return f"(({spark_hash(x)})::DOUBLE / 4294967296.0::DOUBLE + 0.5::DOUBLE)"


def _dl(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def _q(c: str) -> str:
    return f'"{c}"'


# --- views -------------------------------------------------------------------------

def events_sql(hourly: bool = False) -> str:
    ts = "CAST(date_trunc('hour', e.ts) AS TIMESTAMP)" if hourly else "e.ts"
    return f"""SELECT CAST(e.user_id AS VARCHAR) AS user_id, e.event_type AS device_type,
  {ts} AS "timestamp", CAST(1 + e.user_id % 5 AS INTEGER) AS weight, n.n_name AS geolocation,
  c.c_mktsegment AS age_range,
  CASE WHEN e.user_id % 3 = 0 THEN 'male' WHEN e.user_id % 3 = 1 THEN 'female' END AS gender,
  CAST(e.user_id % 2 AS INTEGER) AS interest
FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""


LINES_SQL = """SELECT CAST(o.o_custkey AS VARCHAR) AS user_id, l.l_returnflag AS device_type,
  l.l_shipdate AS "timestamp", CAST(trunc(l.l_quantity) AS INTEGER) AS weight, c.c_mktsegment AS age_range
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey"""

CENSUS_SQL = "SELECT c_mktsegment AS age_range, CAST(count(*) AS BIGINT) AS population FROM customer GROUP BY 1"

POPULATION_SQL = f"SELECT CAST(sum(population) AS BIGINT) AS population FROM ({CENSUS_SQL})"

CENSUS_TWO_SQL = """SELECT c_mktsegment AS age_range,
  CASE WHEN c_custkey % 3 = 0 THEN 'male' WHEN c_custkey % 3 = 1 THEN 'female' END AS gender,
  CAST(count(*) AS BIGINT) AS population FROM customer GROUP BY ALL"""

TWO_DEMO_MIXTURE_SQL = (f"SELECT age_range, gender, population, {_dl(C.ALPHAS)} AS alphas, {_dl(C.RATES)} AS rates "
                        f"FROM ({CENSUS_TWO_SQL})")

# what a fit of the known curve must return: pools in ascending rate order
_KNOWN = sorted(zip(C.RATES, C.ALPHAS))
KNOWN_ALPHAS, KNOWN_RATES = [a for _, a in _KNOWN], [x for x, _ in _KNOWN]

SEGMENT_MIXTURE_SQL = (f"SELECT age_range, CAST(sum(population) AS BIGINT) AS population, "
                       f"{_dl(C.ALPHAS)} AS alphas, {_dl(C.RATES)} AS rates FROM ({CENSUS_SQL}) GROUP BY 1")

TOTAL_MIXTURE_SQL = f"SELECT population, {_dl(C.ALPHAS)} AS alphas, {_dl(C.RATES)} AS rates FROM ({POPULATION_SQL})"


# --- operators written directly ----------------------------------------------------

def reach_sql(view: str, id_col: str = "user_id", demos=(), weighted: bool = False) -> str:
    demos = list(demos)
    d = "".join(f"{_q(c)}, " for c in demos)
    order = ", ".join(['"timestamp" ASC NULLS FIRST'] + [f"{_q(c)} ASC NULLS FIRST" for c in demos]
                      + (["weight ASC NULLS FIRST"] if weighted else []))
    w = "coalesce(weight, 0)" if weighted else "1"
    part = ("PARTITION BY " + ", ".join(_q(c) for c in demos)) if demos else ""
    return f"""WITH v AS ({view}),
r AS (SELECT *, row_number() OVER (PARTITION BY {_q(id_col)} ORDER BY {order}) AS rn__ FROM v),
s AS (SELECT {d}"timestamp", CAST(sum(CASE WHEN rn__ = 1 THEN {w} ELSE 0 END) AS BIGINT) AS reach_inc,
        CAST(sum({w}) AS BIGINT) AS impression_inc FROM r GROUP BY {d}"timestamp")
SELECT {d}"timestamp", reach_inc, impression_inc,
  CAST(sum(reach_inc) OVER w AS BIGINT) AS reach, CAST(sum(impression_inc) OVER w AS BIGINT) AS impression
FROM s WINDOW w AS ({part} ORDER BY "timestamp" ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def frequency_sql(view: str, id_col: str = "user_id", demos=()) -> str:
    demos = list(demos)
    cnt = _q(f"{id_col} counts")
    if not demos:
        return f"""WITH v AS ({view}), p AS (SELECT {_q(id_col)}, count(*) AS frequency_total FROM v GROUP BY 1)
SELECT CAST(frequency_total AS BIGINT) AS frequency_total, CAST(count(*) AS BIGINT) AS {cnt} FROM p GROUP BY 1"""
    d = ", ".join(_q(c) for c in demos)
    return f"""WITH v AS ({view}),
p AS (SELECT {_q(id_col)}, {d}, count(*) AS n FROM v GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY {_q(id_col)}) AS frequency_total FROM p)
SELECT {d}, CAST(frequency_total AS BIGINT) AS frequency_total, CAST(count(*) AS BIGINT) AS {cnt} FROM q GROUP BY ALL"""


def _reduce(lst: str, zero: str = "0.0::DOUBLE") -> str:
    return f"list_reduce({lst}, lambda acc, x: acc + x, {zero})"


def vid_table_sql(mixture: str, demos=(), normalize: bool = False, packed: bool = False) -> str:
    demos = list(demos)
    d = "".join(f"{_q(c)}, " for c in demos)
    order = ", ".join(f"{_q(c)} ASC NULLS FIRST" for c in demos) or "1"
    lo = _reduce("ak[1:i-1]")
    hi = _reduce("ak[1:i]")
    if normalize or packed:
        lo, hi = f"({lo}) / kappa", f"({hi}) / kappa"
    base = f"""WITH m AS ({mixture}),
c1 AS (SELECT *, list_transform(range(1, len(alphas) + 1), lambda i: alphas[i] * rates[i]) AS ak,
         list_transform(alphas, lambda a: CAST(ceil(a * population::DOUBLE) AS BIGINT)) AS tot FROM m),
c2 AS (SELECT *, {_reduce('ak')} AS kappa, {_reduce('tot', '0::BIGINT')} AS used FROM c1),
c3 AS (SELECT *, coalesce(sum(used) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
       FROM c2),
ix AS (SELECT *, unnest(range(1, len(alphas) + 1)) AS i FROM c3)"""
    start = f"CAST(1 + off + {_reduce('tot[1:i-1]', '0::BIGINT')} AS BIGINT)"
    if packed:
        return f"""{base}
SELECT {d}CAST(i AS INTEGER) AS pool, {lo} AS prob_lower, {hi} AS prob_upper, alphas[i] AS alpha, rates[i] AS rate,
  {start} AS start_VID, tot[i] AS total_VID FROM ix"""
    pools = (f"SELECT {d}{lo} AS \"prob_>=\", {hi} AS \"prob_<\", alphas[i] AS alpha, rates[i] AS rate, "
             f"{start} AS start_VID, tot[i] AS total_VID FROM ix")
    if normalize:
        return f"{base}\n{pools}"
    return (f"{base}\n{pools}\nUNION ALL\nSELECT {d}kappa AS \"prob_>=\", 1.0::DOUBLE AS \"prob_<\", 0.0::DOUBLE AS alpha, "
            f"0.0::DOUBLE AS rate, 0::BIGINT AS start_VID, 1::BIGINT AS total_VID FROM c3")


def assign_sql(view: str, table: str, mode: str, demos=()) -> str:
    demos = list(demos)
    d = "".join(f"b.{_q(c)}, " for c in demos)
    on = "".join(f"b.{_q(c)} = t.{_q(c)} AND " for c in demos)
    ts = '"timestamp"::VARCHAR'
    h1 = spark_hash(f"user_id || {ts}") if mode == "uid_time" else spark_hash("user_id")
    head = f"""v AS ({view}), t AS ({table}),
a AS (SELECT *, {h1} AS h1 FROM v),
b AS (SELECT *, h1::DOUBLE / 4294967296.0::DOUBLE + 0.5::DOUBLE AS p1 FROM a),
j AS (SELECT {d}b."timestamp", b.user_id, b.weight, b.h1, b.p1, t.start_VID, t.total_VID
      FROM b JOIN t ON {on}b.p1 >= t."prob_>=" AND b.p1 < t."prob_<")"""
    dj = "".join(f"{_q(c)}, " for c in demos)
    if mode == "weighted":
        step = "((({h}) % total_VID) + total_VID) % total_VID + start_VID"
        return f"""WITH RECURSIVE {head},
n AS (SELECT *, CAST(round(weight) AS BIGINT) AS n, row_number() OVER () AS rid FROM j),
chain AS (
  SELECT rid, 1 AS k, n, start_VID, total_VID, {dj}"timestamp", h1, p1,
         {step.format(h=spark_hash('h1::VARCHAR'))} AS vid FROM n WHERE n >= 1
  UNION ALL
  SELECT rid, k + 1, n, start_VID, total_VID, {dj}"timestamp", h1, p1,
         {step.format(h=spark_hash('vid::VARCHAR'))} FROM chain WHERE k < n)
SELECT {dj}CAST(vid AS BIGINT) AS vid, "timestamp", CAST(h1 AS INTEGER) AS h1, p1 FROM chain"""
    if mode == "uid":
        p2 = uniform("h1::VARCHAR")
    else:
        p2 = uniform(f"h1::VARCHAR || {ts}")
    return f"""WITH {head},
p AS (SELECT *, {p2} AS p2 FROM j)
SELECT {dj}CAST(floor(p2 * total_VID) AS BIGINT) + start_VID AS vid, "timestamp", CAST(h1 AS INTEGER) AS h1,
  p1, p2, user_id FROM p"""


def pool_info_sql(assigned: str, table: str, demos=()) -> str:
    on = "".join(f"a.{_q(c)} = t.{_q(c)} AND " for c in demos)
    return f"""WITH a AS ({assigned}), t AS ({table}),
g AS (SELECT t."prob_>=", t."prob_<", t.alpha, t.rate, t.start_VID, t.total_VID, CAST(count(*) AS BIGINT) AS impressions,
        CAST(count(DISTINCT a.vid) AS BIGINT) AS VID_reach, CAST(count(DISTINCT a.user_id) AS BIGINT) AS distinct_users
      FROM a JOIN t ON {on}a.vid >= t.start_VID AND a.vid < t.start_VID + t.total_VID GROUP BY ALL)
SELECT alpha, rate, alpha * rate AS "alpha * rate", total_VID AS VID_pool_size, impressions, VID_reach, distinct_users
FROM g"""


def _share(alphas: str, rates: str, g: str) -> str:
    return (f"list_reduce(list_transform(range(1, len({alphas}) + 1), "
            f"lambda i: {alphas}[i] * (1.0::DOUBLE - exp(-{rates}[i] * ({g})))), lambda acc, x: acc + x, 0.0::DOUBLE)")


def people_sql(census: str = CENSUS_SQL, demos=("age_range",)) -> str:
    expo = repr(-1.0 / float(LOMAX_ALPHA))
    d, order = ", ".join(demos), ", ".join(f"{c} ASC NULLS FIRST" for c in demos)
    return f"""WITH s AS (SELECT {d}, CAST(sum(population) AS BIGINT) AS population FROM ({census}) GROUP BY ALL),
o AS (SELECT *, coalesce(sum(population) OVER (ORDER BY {order}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
        population::DOUBLE / (sum(population) OVER ())::DOUBLE AS ratio FROM s),
x AS (SELECT *, unnest(range(0, population)) AS i FROM o)
SELECT CAST(off + i + 1 AS BIGINT) AS user_id, {d}, population, ratio,
  {float(LOMAX_M)!r}::DOUBLE * (pow(1.0::DOUBLE - i::DOUBLE / population::DOUBLE, {expo}::DOUBLE) - 1.0::DOUBLE) AS rate
FROM x"""


def people_n_sql() -> str:
    u = uniform(f"concat_ws('|', '{C.GEN_SEED}', user_id::VARCHAR)")
    return f"""WITH p AS ({people_sql()}),
st AS (SELECT sum(rate) AS sr, count(*) AS np FROM p),
r AS (SELECT p.user_id, p.age_range, p.population, p.ratio, (p.rate * st.np::DOUBLE) / st.sr AS rate FROM p, st),
ri AS (SELECT *, rate * {C.GEN_IMPRESSIONS_PER_PERSON!r}::DOUBLE AS rate_impressions FROM r)
SELECT * FROM (SELECT *, CAST(floor(rate_impressions) + CASE WHEN {u} <= rate_impressions - floor(rate_impressions)
  THEN 1 ELSE 0 END AS BIGINT) AS n_impressions FROM ri) WHERE n_impressions > 0"""


def _epoch(ts: str) -> int:
    return calendar.timegm(time.strptime(ts, "%Y-%m-%d %H:%M:%S"))


def generated_sql() -> str:
    start, end = _epoch(C.GEN_START), _epoch(C.GEN_END)
    u = uniform(f"concat_ws('|', '{C.GEN_SEED}', user_id::VARCHAR, k::VARCHAR)")
    return f"""WITH pn AS ({people_n_sql()}),
x AS (SELECT user_id, age_range, unnest(range(0, n_impressions)) AS k FROM pn),
y AS (SELECT user_id, age_range, CAST({start} + floor({u} * {end - start}) AS BIGINT) AS timestamp_int FROM x)
SELECT user_id, age_range, timestamp_int, make_timestamp(timestamp_int * 1000000) AS "timestamp" FROM y"""


def one_delta_sql(view: str, curve: str | None = None) -> str:
    """Least squares of one delta by golden section on the log of the rate: the best amplitude of a rate
    is linear.  ``curve``: the reach table, else that of ``view``."""
    shrink = (5 ** 0.5 - 1) / 2

    def error(at: str) -> str:  # squared error up to the constant sum of r * r
        phi = f"(1.0::DOUBLE - exp(-exp({at}) * g))"
        return f"(SELECT -(sum(r * {phi}) * sum(r * {phi})) / sum({phi} * {phi}) FROM pts)"

    return f"""WITH RECURSIVE c AS ({curve or reach_sql(view)}), p AS ({POPULATION_SQL}),
pts AS (SELECT c.impression::DOUBLE / p.population::DOUBLE AS g, c.reach::DOUBLE / p.population::DOUBLE AS r FROM c, p),
search AS (
  SELECT 0 AS step, ln(0.01::DOUBLE) AS a, ln(30.0::DOUBLE) AS b
  UNION ALL
  SELECT step + 1, CASE WHEN f1 <= f2 THEN a ELSE x1 END, CASE WHEN f1 <= f2 THEN x2 ELSE b END
  FROM (SELECT *, {error('x1')} AS f1, {error('x2')} AS f2
        FROM (SELECT *, b - {shrink!r}::DOUBLE * (b - a) AS x1, a + {shrink!r}::DOUBLE * (b - a) AS x2
              FROM search WHERE step < 60))),
best AS (SELECT exp((a + b) / 2) AS rate FROM search WHERE step = 60),
amp AS (SELECT rate, (SELECT sum(r * (1 - exp(-rate * g))) / sum((1 - exp(-rate * g)) * (1 - exp(-rate * g))) FROM pts) AS alpha
        FROM best)
SELECT p.population, round(alpha, {C.KNOWN_DIGITS}) AS alpha, round(rate, {C.KNOWN_DIGITS}) AS rate,
  round((SELECT sqrt(avg((alpha * (1 - exp(-rate * g)) - r) * (alpha * (1 - exp(-rate * g)) - r))) FROM pts)
        * p.population::DOUBLE, {C.KNOWN_DIGITS}) AS rmse FROM amp, p"""


def two_delta_sql(view: str, population: str = POPULATION_SQL, steps: int = 160, wide: int = 3) -> str:
    """Least squares of two deltas by a profile search: a net of pairs of log rates whose middle moves to
    its best pair, and narrows where the middle is best; the amplitudes of a pair are linear (at a bound if
    one would be negative), its error is summed from the residuals.  Columns ``population, a1, x1, a2, x2,
    err`` (x1 <= x2, summed squared error of shares, ``n`` points)."""
    net = f"SELECT i, j FROM range(-{wide}, {wide + 1}) a(i), range(-{wide}, {wide + 1}) b(j)"
    return f"""WITH RECURSIVE c AS ({reach_sql(view)}), p AS ({population}),
pts AS MATERIALIZED (SELECT c.impression::DOUBLE / p.population::DOUBLE AS g, c.reach::DOUBLE / p.population::DOUBLE AS r FROM c, p),
search AS (
  SELECT 0 AS step, ln(0.5::DOUBLE) AS u, ln(2.0::DOUBLE) AS v, 0.5::DOUBLE AS w, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2, 0.0::DOUBLE AS err
  UNION ALL
  SELECT step + 1, best.u, best.v, CASE WHEN best.mid THEN w * 0.5 ELSE w END, best.a1, best.a2, best.err
  FROM (SELECT step, w, arg_min(struct_pack(u := u1, v := v1, a1 := a1, a2 := a2, err := err, mid := i = 0 AND j = 0), err) AS best
        FROM (SELECT step, w, u1, v1, i, j, a1, a2,
                     sum(pow(a1 * (1 - exp(-exp(u1) * g)) + a2 * (1 - exp(-exp(v1) * g)) - r, 2)) AS err
              FROM (SELECT step, w, u1, v1, i, j,
                           CASE WHEN b1 < 0 THEN 0 WHEN b2 < 0 THEN h1 / q11 ELSE b1 END AS a1,
                           CASE WHEN b2 < 0 THEN 0 WHEN b1 < 0 THEN h2 / q22 ELSE b2 END AS a2
                    FROM (SELECT *, (h1 * q22 - h2 * q12) / (q11 * q22 - q12 * q12) AS b1,
                                 (h2 * q11 - h1 * q12) / (q11 * q22 - q12 * q12) AS b2
                          FROM (SELECT step, w, u1, v1, i, j, sum(f1 * f1) AS q11, sum(f1 * f2) AS q12, sum(f2 * f2) AS q22,
                                       sum(f1 * r) AS h1, sum(f2 * r) AS h2
                                FROM (SELECT *, 1 - exp(-exp(u1) * g) AS f1, 1 - exp(-exp(v1) * g) AS f2
                                      FROM (SELECT step, w, i, j, u + i * w AS u1, v + j * w AS v1 FROM search, ({net}) WHERE step < {steps}), pts
                                      WHERE u1 < v1)
                                GROUP BY ALL))), pts
              GROUP BY ALL)
        GROUP BY step, w)),
last AS (SELECT * FROM search WHERE step = {steps})
SELECT p.population, a1, exp(u) AS x1, a2, exp(v) AS x2, err, (SELECT count(*) FROM pts) AS n FROM last, p"""


# --- the registered texts ------------------------------------------------------------

def fraction_reach_sql() -> str:
    text = reach_sql(f"SELECT * REPLACE (weight / 2.0::DOUBLE AS weight) FROM ({LINES_SQL})", weighted=True)
    return text.replace("AS BIGINT) AS reach", "AS DOUBLE) AS reach").replace("AS BIGINT) AS impression", "AS DOUBLE) AS impression")


def _known_sql() -> dict[str, str]:
    params = f"{_dl(KNOWN_ALPHAS)} AS alphas, {_dl(KNOWN_RATES)} AS rates"
    total = f"SELECT population, {params} FROM ({POPULATION_SQL})"
    segment = f"SELECT age_range, population, {params} FROM ({CENSUS_SQL})"

    def long(mixture: str, d: str) -> str:
        return f"""SELECT {d}population, CAST(i AS INTEGER) AS delta, alphas[i] AS alpha, rates[i] AS rate
FROM (SELECT *, unnest(range(1, len(alphas) + 1)) AS i FROM ({mixture}))"""

    ev = events_sql()
    digits = C.KNOWN_DIGITS
    slow = f"""SELECT c.impression, p.population::DOUBLE * ({_share(_dl(C.SLOW_ALPHAS), _dl(C.SLOW_RATES),
        'c.impression::DOUBLE / p.population::DOUBLE')}) AS reach FROM ({reach_sql(LINES_SQL)}) c, ({POPULATION_SQL}) p"""
    fitted = two_delta_sql(LINES_SQL)
    mixture = f"SELECT population, [a1, a2] AS alphas, [x1, x2] AS rates FROM ({fitted})"
    steep = f"""SELECT axis, top, population, {_dl([a for _, a in sorted(zip(C.STEEP_RATES, C.STEEP_ALPHAS))])} AS alphas,
  {_dl(sorted(C.STEEP_RATES))} AS rates FROM ({POPULATION_SQL}), (SELECT unnest(['even', 'geometric']) AS axis),
  (SELECT unnest({_dl(C.STEEP_TOPS)}) AS top)"""
    return {
        "fit_recovery_steep": long(steep, "axis, top, "),
        "fit_drops_delta": f"""SELECT population, 1 AS n_fitted, 2 AS n_deltas, 0.0::DOUBLE AS dropped, alpha, rate, rmse
FROM ({one_delta_sql('', slow)})""",
        "fit_total": f"""SELECT population, [round(a1, {digits}), round(a2, {digits})] AS alphas, [round(x1, {digits}), round(x2, {digits})] AS rates,
  2 AS n_fitted, round(sqrt(err / n) * population, {digits}) AS rmse FROM ({fitted})""",
        "flow_total": reach_sql(assign_sql(LINES_SQL, vid_table_sql(mixture), "uid_time"), id_col="vid"),
        "fit_recovery_total": long(total, ""),
        "fit_recovery_segment": long(segment, "age_range, "),
        "fit_one_delta": one_delta_sql(LINES_SQL),
        "flow_recovered_total": reach_sql(assign_sql(ev, vid_table_sql(total), "uid_time"), id_col="vid"),
        "flow_recovered_segment": reach_sql(
            assign_sql(ev, vid_table_sql(segment, ["age_range"]), "uid_time", ["age_range"]), id_col="vid", demos=["age_range"]),
    }


def _two_demo_sql(ev: str, ev_h: str) -> dict[str, str]:
    table = vid_table_sql(TWO_DEMO_MIXTURE_SQL, C.TWO)
    assigned = assign_sql(ev, table, "uid_time", C.TWO)
    same = " AND ".join(f"r.{c} IS NOT DISTINCT FROM m.{c}" for c in C.TWO)
    return {
        "vid_table_two_demos": table,
        "assign_uid_time_two_demos": assigned,
        "pool_info_two_demos": pool_info_sql(assigned, table, C.TWO),
        "fit_overlay_two_demos": f"""WITH c AS ({reach_sql(ev_h, demos=C.TWO)}), m AS ({TWO_DEMO_MIXTURE_SQL}),
r AS (SELECT age_range, gender, "timestamp", impression, reach FROM c
      UNION ALL SELECT DISTINCT age_range, gender, NULL, 0, 0 FROM c)
SELECT r.*, round({_share('m.alphas', 'm.rates', 'r.impression::DOUBLE / m.population::DOUBLE')} * m.population::DOUBLE,
  {C.FIT_DIGITS}) AS fit FROM r JOIN m ON {same}""",
        "gen_people_two_demos": f"SELECT * REPLACE (round(rate, {C.DIGITS}) AS rate) FROM ({people_sql(CENSUS_TWO_SQL, C.TWO)})",
    }


def _sql() -> dict[str, str]:
    ev = events_sql()
    ev_h = events_sql(hourly=True)
    seg_vt = vid_table_sql(SEGMENT_MIXTURE_SQL, ["age_range"])
    tot_vt = vid_table_sql(TOTAL_MIXTURE_SQL)
    reach_seg = reach_sql(LINES_SQL, demos=["age_range"])
    exploded = f"""SELECT user_id || CAST(i AS VARCHAR) AS user_id, device_type, "timestamp", weight, geolocation,
  age_range, gender, interest FROM (SELECT *, unnest(range(1, CAST(round(weight) AS BIGINT) + 1)) AS i
  FROM ({ev}) WHERE round(weight) >= 1)"""
    exploded_h = exploded.replace(ev, ev_h)
    a = {
        mode + ("_segment" if seg else ""): assign_sql(ev, seg_vt if seg else tot_vt, mode, ["age_range"] if seg else [])
        for mode in ("uid", "uid_time", "weighted") for seg in (False, True)
    }
    sqls = {
        "population_total": POPULATION_SQL,
        "penetrate_uniform": f"""SELECT age_range, population, CAST(i AS INTEGER) AS delta, alphas[i] AS alpha,
  rates[i] AS rate FROM (SELECT *, unnest(range(1, len(alphas) + 1)) AS i FROM ({SEGMENT_MIXTURE_SQL}))""",
        "exposure_index": f"""SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" ASC NULLS FIRST)
  AS exposure_index FROM ({ev})""",
        "frequency_total": f"""SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" ASC NULLS FIRST)
  AS exposure_index, count(*) OVER (PARTITION BY user_id) AS frequency_total FROM ({ev})""",
        "first_exposure": f"""SELECT *, CASE WHEN exposure_index = 1 THEN 1 ELSE 0 END AS is_first FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" ASC NULLS FIRST) AS exposure_index
  FROM ({ev}))""",
        "reach_count": reach_sql(LINES_SQL),
        "reach_weighted": reach_sql(LINES_SQL, weighted=True),
        "reach_segment_count": reach_seg,
        "reach_segment_weighted": reach_sql(LINES_SQL, demos=["age_range"], weighted=True),
        "reach_hourly_segments": reach_sql(ev_h, demos=["age_range", "gender"]),
        "frequency_table": frequency_sql(LINES_SQL),
        "frequency_segment_table": frequency_sql(LINES_SQL, demos=["device_type"]),
        "explode_weights": exploded,
        "exploded_reach": reach_sql(exploded_h),
        "mixture_eval": f"""WITH r AS ({reach_sql(LINES_SQL)}), p AS ({POPULATION_SQL}),
g AS (SELECT r."timestamp", r.impression::DOUBLE / p.population::DOUBLE AS g, p.population::DOUBLE AS pop FROM r, p),
s AS (SELECT *, {_share(_dl(C.ALPHAS), _dl(C.RATES), 'g')} AS share FROM g)
SELECT "timestamp", g, round(share, {C.DIGITS}) AS share, round(share * pop, {C.DIGITS}) AS fit FROM s""",
        "fit_overlay": f"""WITH r AS ({reach_seg}), m AS ({SEGMENT_MIXTURE_SQL})
SELECT r.age_range, r."timestamp", r.impression, r.reach,
  round({_share('m.alphas', 'm.rates', 'r.impression::DOUBLE / m.population::DOUBLE')} * m.population::DOUBLE,
        {C.FIT_DIGITS}) AS fit
FROM r JOIN m ON r.age_range = m.age_range""",
        "fit_summary": f"""WITH r AS ({reach_seg}), m AS ({SEGMENT_MIXTURE_SQL}),
f AS (SELECT r.age_range, r.reach,
  {_share('m.alphas', 'm.rates', 'r.impression::DOUBLE / m.population::DOUBLE')} * m.population::DOUBLE AS fit
  FROM r JOIN m ON r.age_range = m.age_range),
st AS (SELECT age_range, CAST(count(*) AS BIGINT) AS points, round(sqrt(avg((fit - reach) * (fit - reach))), {C.FIT_DIGITS}) AS rmse
  FROM f GROUP BY 1)
SELECT st.*, round(100.0::DOUBLE * {_reduce('m.alphas')}, {C.DIGITS}) AS reached_pct FROM st JOIN m USING (age_range)""",
        "reach_points": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY age_range ORDER BY "timestamp" ASC NULLS FIRST)
  AS point FROM ({reach_seg})) WHERE (point - 1) % 100 = 0""",
        "frequency_head": f"""SELECT * EXCLUDE (rn__) FROM (SELECT *, row_number() OVER (PARTITION BY device_type
  ORDER BY frequency_total) AS rn__ FROM ({frequency_sql(LINES_SQL, demos=['device_type'])})) WHERE rn__ <= 20""",
        "delta_points": f"""SELECT age_range, CAST(i AS INTEGER) AS delta, rates[i] AS rate,
  alphas[i] * (population::DOUBLE / total) AS amplitude
FROM (SELECT *, unnest(range(1, len(alphas) + 1)) AS i
      FROM (SELECT *, (sum(population) OVER ())::DOUBLE AS total FROM ({SEGMENT_MIXTURE_SQL})))""",
        "vid_table": tot_vt,
        "vid_table_segment": seg_vt,
        "vid_table_normalized": vid_table_sql(SEGMENT_MIXTURE_SQL, ["age_range"], normalize=True),
        "vid_table_packed": vid_table_sql(SEGMENT_MIXTURE_SQL, ["age_range"], packed=True),
        "hash_uniform": f"""SELECT user_id, "timestamp", {uniform('user_id')} AS p_uid,
  {uniform('user_id || "timestamp"::VARCHAR')} AS p_uid_time FROM ({ev})""",
        "assign_uid": a["uid"],
        "assign_uid_segment": a["uid_segment"],
        "assign_uid_time": a["uid_time"],
        "assign_uid_time_segment": a["uid_time_segment"],
        "assign_weighted": a["weighted"],
        "assign_weighted_segment": a["weighted_segment"],
        "vid_reach_count": reach_sql(a["uid_time"], id_col="vid"),
        "vid_reach_segment": reach_sql(a["uid_time_segment"], id_col="vid", demos=["age_range"]),
        "vid_frequency": frequency_sql(a["uid_time"], id_col="vid"),
        "vid_frequency_segment": frequency_sql(a["uid_time_segment"], id_col="vid", demos=["age_range"]),
        "pool_info": pool_info_sql(a["uid_time"], tot_vt),
        "pool_info_segment": pool_info_sql(a["uid_time_segment"], seg_vt),
        **_known_sql(),
        **_two_demo_sql(ev, ev_h),
        "assign_uid_segment_cells": a["uid_segment"],
        "assign_uid_time_hot_segment": assign_sql(
            f"SELECT * REPLACE (CASE WHEN user_id::BIGINT % 10 <> 0 THEN '{C.HOT_SEGMENT}' ELSE age_range END AS age_range) FROM ({ev})",
            seg_vt, "uid_time", ["age_range"]),
        "assign_uid_literal_model": assign_sql(ev, vid_table_sql(
            f"SELECT {C.ASSUMED_POPULATION}::BIGINT AS population, {_dl(C.ALPHAS)} AS alphas, {_dl(C.RATES)} AS rates"), "uid"),
        "reach_weighted_fractions": fraction_reach_sql(),
        "exposure_index_ties": f"""SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" ASC NULLS FIRST,
  device_type ASC NULLS FIRST, weight ASC NULLS FIRST) AS exposure_index FROM ({LINES_SQL})""",
        "frequency_total_hot_id": f"""SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" ASC NULLS FIRST)
  AS exposure_index, count(*) OVER (PARTITION BY user_id) AS frequency_total
  FROM (SELECT * REPLACE (CASE WHEN user_id::BIGINT % 3 <> 0 THEN user_id END AS user_id) FROM ({ev}))""",
        "flow_generated": reach_sql(assign_sql(
            f"""SELECT user_id::VARCHAR AS user_id, "timestamp", 1 AS weight FROM ({generated_sql()})""", tot_vt, "uid_time"),
            id_col="vid"),
        "gen_people": f"SELECT * REPLACE (round(rate, {C.DIGITS}) AS rate) FROM ({people_sql()})",
        "gen_n_impressions": f"""SELECT * REPLACE (round(rate, {C.DIGITS}) AS rate,
  round(rate_impressions, {C.DIGITS}) AS rate_impressions) FROM ({people_n_sql()})""",
        "gen_impressions": generated_sql(),
        "gen_reach": reach_sql(generated_sql(), demos=["age_range"]),
    }
    return sqls


ORACLE_SQL: dict[str, str] = _sql()
