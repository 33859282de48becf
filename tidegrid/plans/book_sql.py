"""The portfolio rules as DuckDB SQL: a recursive step a date over lists with an entry for each name.

Expects px(ticker, date, c, o, adv), books(scenario, k, even, flat, first, last) with nulls where a rule is the
default, and sc(scenario, date, ticker, score) as common table expressions before these.
"""

from __future__ import annotations

HOLD = 21


def _sum(expression: str) -> str:
    return f"coalesce(list_sum(list_transform(js, lambda j: {expression})), 0)"


def _each(expression: str) -> str:
    return f"list_transform(js, lambda j: {expression})"


_RATE = "CASE WHEN flat IS NOT NULL THEN flat ELSE 5 + (10 / 2.0 + 5) * CASE WHEN vs[j] > 0 THEN least(greatest(1e8 / vs[j], 1), 10) ELSE 10 END END / 10000"

SETTING = f"""
nm AS (SELECT ticker, row_number() OVER (ORDER BY ticker) AS j FROM (SELECT DISTINCT ticker FROM px)),
fl AS (SELECT date, j, c, o, last_value(c IGNORE NULLS) OVER w AS m, last_value(adv IGNORE NULLS) OVER w AS v
  FROM (SELECT DISTINCT date FROM px) CROSS JOIN nm LEFT JOIN px USING (date, ticker) WINDOW w AS (PARTITION BY j ORDER BY date ROWS UNBOUNDED PRECEDING)),
dy AS MATERIALIZED (SELECT row_number() OVER (ORDER BY date) AS n, date AS day, list(j ORDER BY j) AS js, list(c ORDER BY j) AS cs, list(o ORDER BY j) AS os, list(m ORDER BY j) AS ms, list(v ORDER BY j) AS vs FROM fl GROUP BY date),
fr AS MATERIALIZED (SELECT b.scenario, k, even, flat, (SELECT min(n) FROM dy WHERE day >= coalesce(b.first, s.lo)) AS n0, (SELECT max(n) FROM dy WHERE b.last IS NULL OR day <= b.last) AS n1
  FROM books b JOIN (SELECT scenario, min(date) AS lo FROM sc WHERE score IS NOT NULL GROUP BY 1) s USING (scenario)),
dc AS MATERIALIZED (SELECT scenario, n, day FROM fr JOIN dy ON n BETWEEN n0 AND n1 AND (n - n0) % {HOLD} = 0),
sl AS MATERIALIZED (SELECT dc.scenario, n, list(score ORDER BY j) AS ss FROM dc CROSS JOIN nm LEFT JOIN sc ON sc.scenario = dc.scenario AND sc.date = dc.day AND sc.ticker = nm.ticker GROUP BY 1, 2),
sim AS (
  SELECT scenario, n0 - 1 AS n, n0, n1, k, even, flat, NULL::DATE AS date, 100000.0::DOUBLE AS cash, z AS sh, z AS sell, z AS spend, z AS rate, NULL::DATE AS decided, z AS qty, z AS paid_at, z AS mark,
    z AS paid_rate, NULL::DATE AS paid_for, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS equity, false AS rebalance FROM fr CROSS JOIN (SELECT list(0.0::DOUBLE) AS z FROM nm)
  UNION ALL
  SELECT scenario, n, n0, n1, k, even, flat, day, cash2, sh1, CASE WHEN decides THEN sell2 ELSE sell1 END, CASE WHEN decides THEN {_each("want[j] * share")} ELSE spend1 END, CASE WHEN decides THEN rs ELSE rate END,
    CASE WHEN decides THEN day ELSE decided END, qty, os, ms, rate, decided, cost, cash2 + {_sum("CASE WHEN sh1[j] > 0 THEN sh1[j] * ms[j] END")}, decides
  FROM (SELECT *, CASE WHEN abs(cash1) < 1e-4 THEN 0.0 ELSE cash1 END AS cash2,
      CASE WHEN money > 0 AND {_sum("want[j]")} > 0 THEN CASE WHEN even THEN least(1.0, money / {_sum("want[j]")}) ELSE money / {_sum("want[j]")} END ELSE 0.0 END AS share
    FROM (SELECT *, cash1 + {_sum("CASE WHEN sell2[j] > 0 THEN sell2[j] * ms[j] * (1 - rs[j]) END")} AS money FROM (
      SELECT *, {_each("CASE WHEN NOT stay[j] THEN sh1[j] WHEN even AND worth[j] > part THEN (worth[j] - part) / ms[j] ELSE 0.0 END")} AS sell2,
        {_each("CASE WHEN NOT stay[j] THEN 0.0 WHEN even THEN greatest(part - worth[j], 0.0) WHEN sh1[j] > 0 THEN 0.0 ELSE 1.0 END")} AS want
      FROM (SELECT *, (cash1 + {_sum("worth[j]")}) / greatest(1, {_sum("CASE WHEN stay[j] THEN 1 ELSE 0 END")}) AS part FROM (
        SELECT *, {_each("(sh1[j] > 0 AND ss[j] IS NULL) OR list_contains(pick, j)")} AS stay, {_each("CASE WHEN sh1[j] > 0 THEN sh1[j] * coalesce(ms[j], 0) ELSE 0.0 END")} AS worth
        FROM (SELECT *, CASE WHEN decides THEN list_transform(list_sort(list_transform(list_filter(js, lambda j: ss[j] IS NOT NULL AND (cs[j] IS NOT NULL OR (sh1[j] > 0 AND ms[j] IS NOT NULL))), lambda j: {{'s': -ss[j], 'j': j}}))
            [1:greatest(0, k - {_sum("CASE WHEN sh1[j] > 0 AND ss[j] IS NULL THEN 1 ELSE 0 END")})], lambda x: x.j) ELSE [] END AS pick
          FROM (SELECT *, {_each("CASE WHEN os[j] IS NOT NULL AND sell[j] > 0 AND sell[j] >= sh[j] THEN 0.0 ELSE sh[j] + qty[j] END")} AS sh1,
              cash - {_sum("qty[j] * coalesce(os[j], 0) + abs(qty[j]) * coalesce(os[j], 0) * rate[j]")} AS cash1, {_sum("abs(qty[j]) * coalesce(os[j], 0) * rate[j]")} AS cost,
              {_each("CASE WHEN os[j] IS NULL THEN sell[j] ELSE 0.0 END")} AS sell1, {_each("CASE WHEN os[j] IS NULL THEN spend[j] ELSE 0.0 END")} AS spend1, {_each(_RATE)} AS rs
            FROM (SELECT sim.scenario, dy.n, n0, n1, k, even, flat, day, js, cs, os, ms, vs, ss, (dy.n - n0) % {HOLD} = 0 AS decides, cash, sh, sell, spend, rate, decided,
                list_transform(js, lambda j: CASE WHEN os[j] IS NULL THEN 0.0 WHEN sell[j] > 0 THEN -least(sell[j], sh[j]) WHEN spend[j] > 0 THEN spend[j] / (os[j] * (1 + rate[j])) ELSE 0.0 END) AS qty
              FROM sim JOIN dy ON dy.n = sim.n + 1 AND sim.n < n1 LEFT JOIN sl ON sl.scenario = sim.scenario AND sl.n = dy.n))))))))
)"""

EQUITY = "SELECT scenario, date, equity AS equity_eur, cash AS cash_eur, CAST(len(list_filter(sh, lambda x: x > 0)) AS INTEGER) AS n_names, rebalance, cost AS cost_eur FROM sim WHERE n >= n0"
POSITIONS = """SELECT scenario, date, ticker, x.s AS shares, x.p AS price_eur, x.s * x.p AS value_eur, x.s * x.p / equity AS weight
  FROM (SELECT scenario, date, equity, unnest(list_transform(range(1, len(sh) + 1), lambda j: {'j': j, 's': sh[j], 'p': mark[j]})) AS x FROM sim WHERE n >= n0) JOIN nm ON nm.j = x.j WHERE x.s > 0"""
TRADES = """SELECT scenario, date, ticker, CASE WHEN x.q < 0 THEN 'sell' ELSE 'buy' END AS side, abs(x.q) AS shares, x.p AS price_eur, abs(x.q) * x.p AS value_eur, abs(x.q) * x.p * x.r AS cost_eur, paid_for AS decided
  FROM (SELECT scenario, date, paid_for, unnest(list_transform(range(1, len(sh) + 1), lambda j: {'j': j, 'q': qty[j], 'p': paid_at[j], 'r': paid_rate[j]})) AS x FROM sim WHERE n >= n0) JOIN nm ON nm.j = x.j WHERE x.q <> 0"""
