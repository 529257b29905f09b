"""Star-schema queries: 13 fixed ones, and random ones from a generator.

The star is built from the given tables: lineorder is lineitem with its order, date the
days of the orders, customer and supplier have their nation and region, and part's brand is
its category's brand. Supply cost is six tenths of the price.
"""

from __future__ import annotations

import datetime
import random

from tidemark.plans.sqltext import dsum

STAR = """
WITH dates AS (SELECT DISTINCT CAST(EXTRACT(YEAR FROM o_orderdate) * 10000 + EXTRACT(MONTH FROM o_orderdate) * 100 + EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d_datekey,
                      CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS d_year, CAST(EXTRACT(YEAR FROM o_orderdate) * 100 + EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS d_yearmonthnum,
                      CAST(EXTRACT(WEEK FROM o_orderdate) AS BIGINT) AS d_weeknuminyear FROM orders),
lineorder AS (SELECT l_orderkey AS lo_orderkey, l_linenumber AS lo_linenumber, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey,
                     CAST(EXTRACT(YEAR FROM o_orderdate) * 10000 + EXTRACT(MONTH FROM o_orderdate) * 100 + EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS lo_orderdate,
                     l_quantity AS lo_quantity, l_extendedprice AS lo_extendedprice, CAST(ROUND(l_discount * 100) AS BIGINT) AS lo_discount,
                     l_extendedprice * (1 - l_discount) AS lo_revenue, l_extendedprice * 0.6 AS lo_supplycost FROM lineitem, orders WHERE l_orderkey = o_orderkey),
cust AS (SELECT c_custkey, n_name AS c_nation, r_name AS c_region, n_name || '-' || CAST(c_custkey % 10 AS VARCHAR(4)) AS c_city FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey),
supp AS (SELECT s_suppkey, n_name AS s_nation, r_name AS s_region, n_name || '-' || CAST(s_suppkey % 10 AS VARCHAR(4)) AS s_city FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey),
parts AS (SELECT p_partkey, p_type AS p_mfgr, p_brand AS p_category, p_brand || '-' || CAST(p_size AS VARCHAR(4)) AS p_brand1 FROM part)
"""

_JOIN_2 = "FROM lineorder, dates, parts, supp WHERE lo_orderdate = d_datekey AND lo_partkey = p_partkey AND lo_suppkey = s_suppkey"
_JOIN_3 = "FROM cust, lineorder, supp, dates WHERE lo_custkey = c_custkey AND lo_suppkey = s_suppkey AND lo_orderdate = d_datekey"
_JOIN_4 = "FROM dates, cust, supp, parts, lineorder WHERE lo_custkey = c_custkey AND lo_suppkey = s_suppkey AND lo_partkey = p_partkey AND lo_orderdate = d_datekey"
_PROFIT = dsum("lo_revenue - lo_supplycost")


def _flight1(where: str) -> str:
    return STAR + f"SELECT {dsum('lo_extendedprice * lo_discount')} AS revenue FROM lineorder, dates WHERE lo_orderdate = d_datekey AND {where}"


def _flight2(where: str) -> str:
    return STAR + f"SELECT {dsum('lo_revenue')} AS revenue, d_year, p_brand1 {_JOIN_2} AND {where} GROUP BY d_year, p_brand1 ORDER BY d_year, p_brand1"


def _flight3(a: str, b: str, where: str) -> str:
    return STAR + f"SELECT {a}, {b}, d_year, {dsum('lo_revenue')} AS revenue {_JOIN_3} AND {where} GROUP BY {a}, {b}, d_year ORDER BY d_year, revenue DESC, {a}, {b}"


def _flight4(keys: str, where: str) -> str:
    return STAR + f"SELECT {keys}, {_PROFIT} AS profit {_JOIN_4} AND {where} GROUP BY {keys} ORDER BY {keys}"


_CITIES = "c_city IN ('NATION_3-1', 'NATION_3-5') AND s_city IN ('NATION_3-1', 'NATION_3-5')"
QUERIES: dict[str, str] = {
    "ssb_q1_1": _flight1("d_year = 1996 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25"),
    "ssb_q1_2": _flight1("d_yearmonthnum = 199601 AND lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35"),
    "ssb_q1_3": _flight1("d_weeknuminyear = 6 AND d_year = 1996 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35"),
    "ssb_q2_1": _flight2("p_category = 'Brand#12' AND s_region = 'AMERICA'"),
    "ssb_q2_2": _flight2("p_brand1 BETWEEN 'Brand#22-1' AND 'Brand#22-4' AND s_region = 'ASIA'"),
    "ssb_q2_3": _flight2("p_brand1 = 'Brand#22-9' AND s_region = 'EUROPE'"),
    "ssb_q3_1": _flight3("c_nation", "s_nation", "c_region = 'ASIA' AND s_region = 'ASIA' AND d_year >= 1995 AND d_year <= 1998"),
    "ssb_q3_2": _flight3("c_city", "s_city", "c_nation = 'NATION_3' AND s_nation = 'NATION_3' AND d_year >= 1995 AND d_year <= 1998"),
    "ssb_q3_3": _flight3("c_city", "s_city", f"{_CITIES} AND d_year >= 1995 AND d_year <= 1998"),
    "ssb_q3_4": _flight3("c_city", "s_city", f"{_CITIES} AND d_yearmonthnum = 199712"),
    "ssb_q4_1": _flight4("d_year, c_nation", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND (p_mfgr = 'PROMO' OR p_mfgr = 'SMALL')"),
    "ssb_q4_2": _flight4("d_year, s_nation, p_category", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND (d_year = 1997 OR d_year = 1998) AND (p_mfgr = 'PROMO' OR p_mfgr = 'SMALL')"),
    "ssb_q4_3": _flight4("d_year, s_city, p_brand1", "c_region = 'AMERICA' AND s_nation = 'NATION_1' AND (d_year = 1997 OR d_year = 1998) AND p_category = 'Brand#14'"),
}


class Generator:
    """Random queries of the flights' shapes. skew: a Zipf exponent for the year that is
    asked for, the latest years most (0: uniform)."""

    YEARS = tuple(range(1995, 2001))
    REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    COLUMNS = ("lo_orderkey", "lo_linenumber", "lo_custkey", "lo_partkey", "lo_suppkey", "lo_orderdate", "lo_quantity", "lo_extendedprice", "lo_discount")
    TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

    def __init__(self, seed: int, skew: float = 0.0):
        self.rng, self.skew = random.Random(seed), skew

    def _year(self) -> int:
        n = len(self.YEARS)
        return self.rng.choices(self.YEARS, [1 / (n - k) ** self.skew for k in range(n)])[0]

    def query(self, flight: int | None = None, year: int | None = None) -> str:
        rng, y = self.rng, year or self._year()
        flight = flight or rng.randint(1, 4)
        low = rng.randint(0, 8)
        discount, days = f"lo_discount BETWEEN {low} AND {low + 2}", f"lo_orderdate BETWEEN {y}0101 AND {y}1231"
        region, q = rng.choice(self.REGIONS), rng.randint(1, 40)
        if flight == 1:
            return _flight1(f"d_year = {y} AND {discount} AND lo_quantity < {q + 10}")
        if flight == 2:
            return _flight2(f"p_category = 'Brand#{rng.randint(1, 25)}' AND s_region = '{region}' AND {discount} AND {days}")
        if flight == 3:
            nation = f"NATION_{rng.randint(0, 24)}"
            return _flight3("c_city", "s_city", f"c_nation = '{nation}' AND s_nation = '{nation}' AND lo_quantity BETWEEN {q} AND {q + 10} AND {days}")
        a, b = rng.sample(self.TYPES, 2)
        return _flight4("d_yearmonthnum, s_nation, p_category", f"c_region = '{region}' AND s_region = '{region}' AND (p_mfgr = '{a}' OR p_mfgr = '{b}') AND {discount} AND {days}")

    def batch(self, n: int, recurring: float = 0.0) -> list[str]:
        """n queries; each repeats an earlier one with the given chance."""
        out: list[str] = []
        for _ in range(n):
            out.append(self.rng.choice(out) if out and self.rng.random() < recurring else self.query())
        return out


    def weighted_batch(self, n: int) -> list[str]:
        """About n queries in which each year has its share by the skew, rounded, not drawn."""
        years = self.YEARS[::-1]
        total = sum(1 / (k + 1) ** self.skew for k in range(len(years)))
        out = [self.query(year=y) for k, y in enumerate(years) for _ in range(round(n / (k + 1) ** self.skew / total))]
        self.rng.shuffle(out)
        return out

    def hot_batch(self, n: int, share: float) -> list[str]:
        """One query again and again for a share of the batch, then others whose years take turns."""
        hot = int(n * share)
        return [self.query()] * hot + [self.query(year=self.YEARS[k % len(self.YEARS)]) for k in range(n - hot)]

    def model(self, hit_ratio: float, row_share: float, n_columns: int) -> tuple[str, str]:
        """Two queries for a model of caching: the first reads a share (hit_ratio) of the days and
        warms the cache, the second all of them. Both return the first n_columns of lineorder
        for about row_share of the rows."""
        first = datetime.date(self.YEARS[0], 1, 1)
        days = (datetime.date(self.YEARS[-1] + 1, 1, 1) - first).days
        until = lambda share: (first + datetime.timedelta(int(days * share))).strftime("%Y%m%d")
        text = f"SELECT {', '.join(self.COLUMNS[:n_columns])} FROM lineorder WHERE lo_quantity <= {int(50 * row_share)} AND lo_orderdate < "
        return STAR + text + until(hit_ratio), STAR + text + until(1.0)


QUERIES |= dict(zip(("ssb_gen_warm", "ssb_gen_model"), Generator(6).model(0.5, 0.2, 6)))
QUERIES |= {"ssb_gen_hot": Generator(7).hot_batch(4, 0.5)[0], "ssb_gen_weighted": Generator(8, 1.0).weighted_batch(5)[0]}
QUERIES |= {f"ssb_gen_{k}": Generator(k, skew).query(flight) for k, flight, skew in ((1, 2, 0.0), (2, 3, 0.0), (3, 4, 0.0), (4, 2, 1.0), (5, 1, 2.0))}
