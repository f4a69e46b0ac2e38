"""Damage operators, replayed in SQL with the same integer arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import as_doubles, r, rounded, table, union
from dqspark.operators import corrupt as D, features as X

ID = "o_orderkey"
DATA = ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
NUMBERS, TEXTS = DATA[:2], DATA[2:]
BASE = f"SELECT {ID}, {', '.join(DATA)} FROM orders"


def base(spark, folder):
    return table(spark, folder, "orders").select(ID, *DATA)


def draw(salt: int | str, k: str = ID) -> str:
    return f"((((({k}) % 1000003) * 48271 + ({salt}) * 7919) % 2147483647) * 16807 % 2147483647)"


def pick(pct: float, salt: int, k: str = ID) -> str:
    return f"{draw(salt, k)} % 1000 < {int(round(pct * 10))}"


def choose(salt: int, values: list, k: str = ID) -> str:
    return f"([{', '.join(str(v) for v in values)}])[{draw(salt, k)} // 1000 % {len(values)} + 1]"


def column_order(names: list[str], seed: int) -> list[str]:
    def number(i: int) -> int:
        return (i * 48271 + seed * 7919) % 2147483647 * 16807 % 2147483647
    return [n for _, n in sorted((number(i), n) for i, n in enumerate(names, 1))]


def project(changes: dict[str, str], source: str = BASE, names: list[str] = DATA, key: str = ID) -> str:
    """Output form: whole numbers with gaps as doubles."""
    return f"SELECT {key}, " + ", ".join(f"{changes.get(n, n)} AS {n}" for n in names) + f" FROM ({source}) b"


def out(sql: str) -> str:
    return f"SELECT {ID}, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM ({sql}) z"


def shown(df):
    return as_doubles(df, "o_custkey")


def nulls_sql(pct, seed, source=BASE, names=DATA, key=ID, only=None) -> str:
    chosen = only or names
    return project({n: f"CASE WHEN NOT ({pick(pct, seed + i, key)}) THEN {n} END"
                    for i, n in enumerate(chosen, 1)}, source, names, key)


def copies_sql(pct, seed, source=BASE, names=DATA, key=ID) -> str:
    listed = ", ".join(names)
    return (f"SELECT {key}, {listed} FROM ({source}) b UNION ALL "
            f"SELECT -1 - {key}, {listed} FROM ({source}) b WHERE {pick(pct, seed + 1, key)}")


def outliers_sql(pct, seed, source=BASE, names=DATA, numbers=NUMBERS, key=ID, factors=(10, -10, 100)) -> str:
    return project({
        n: f"CASE WHEN {pick(pct, seed + i, key)} THEN CAST({n} AS DOUBLE) * {choose(seed + i, list(factors), key)} ELSE CAST({n} AS DOUBLE) END"
        for i, n in enumerate(numbers, 1)}, source, names, key)


def column_nulls_sql(pct, seed, source=BASE, names=DATA, key=ID, row_pct=None) -> str:
    count = max(1, int(len(names) * pct / 100.0))
    share = pct if row_pct is None else row_pct
    return project({
        n: "NULL" if share >= 100 else f"CASE WHEN NOT ({pick(share, seed + i, key)}) THEN {n} END"
        for i, n in enumerate(column_order(names, seed)[:count], 1)}, source, names, key)


def mixed_sql(pct, seed, source=BASE, names=DATA, numbers=NUMBERS, key=ID) -> str:
    step = nulls_sql(pct, seed, source, names, key)
    step = outliers_sql(pct, seed + 20, step, names, numbers, key)
    return copies_sql(pct, seed + 40, step, names, key)


@query(out(nulls_sql(12, 3)))
def corrupt_nulls(spark, folder):
    return shown(D.nulls(base(spark, folder), 12, ID, 3))


@query(out(nulls_sql(20, 5, only=NUMBERS)))
def corrupt_numeric_nulls(spark, folder):
    return shown(D.numeric_nulls(base(spark, folder), 20, ID, 5))


_WIDE = ["w0", "w1", "w2", "w3", "w4", "w5", "w6"]
_WIDE_SQL = f"SELECT {ID}, " + ", ".join(f"CAST(o_custkey + {i} AS DOUBLE) AS w{i}" for i in range(7)) + " FROM orders"


def _wide(spark, folder):
    return table(spark, folder, "orders").select(
        ID, *[(F.col("o_custkey") + i).cast("double").alias(f"w{i}") for i in range(7)])


@query(project({n: f"CASE WHEN NOT ({pick(15, 5)}) THEN {n} END" for n in column_order(_WIDE, 4)[:2]}, _WIDE_SQL, _WIDE))
def corrupt_clustered_nulls(spark, folder):
    return D.clustered_nulls(_wide(spark, folder), 15, ID, 4)


@query(column_nulls_sql(30, 2, _WIDE_SQL, _WIDE))
def corrupt_column_nulls(spark, folder):
    return D.column_nulls(_wide(spark, folder), 30, ID, 2)


@query(out(copies_sql(10, 6)))
def corrupt_duplicates(spark, folder):
    return shown(D.duplicates(base(spark, folder), 10, ID, 6))


@query(outliers_sql(5, 8))
def corrupt_outliers(spark, folder):
    return D.outliers(base(spark, folder), 5, ID, 8)


@query(outliers_sql(5, 9, factors=(-100, 50, 100)))
def corrupt_strong_outliers(spark, folder):
    return D.outliers(base(spark, folder), 5, ID, 9, D.STRONG_FACTORS)


def _cluster(i: int, n: str, seed: int) -> str:
    first = f"{draw(seed + 2)} % 7"
    joins = f"({first} = {i} OR ({first} + 1) % 7 = {i} OR {pick(50, seed + 3 + i)})"
    return f"CASE WHEN {pick(8, seed + 1)} AND {joins} THEN {n} * {choose(seed + 3 + i, [-50, 50, 100])} ELSE {n} END"


@query(project({n: _cluster(i, n, 1) for i, n in enumerate(_WIDE)}, _WIDE_SQL, _WIDE))
def corrupt_outlier_clusters(spark, folder):
    return D.outlier_clusters(_wide(spark, folder), 8, ID, 1)


@query(out(f"""{BASE} UNION ALL SELECT -1 - {ID}, o_custkey, o_totalprice, {", ".join(
    f"CASE WHEN {pick(30, 13 + i)} THEN substr({n}, 1, length({n}) // 2) ELSE {n} END" for i, n in enumerate(TEXTS, 1))}
FROM orders WHERE {pick(10, 13)}"""))
def corrupt_near_duplicates(spark, folder):
    return shown(D.near_duplicates(base(spark, folder), 10, ID, 12))


@query(out(project({n: f"""CASE WHEN {pick(20, 7 + i)} AND length({n}) > 0 THEN CASE WHEN {pick(50, 107 + i)}
  THEN substr({n}, 1, length({n}) // 2) ELSE {n} || '###' END ELSE {n} END""" for i, n in enumerate(TEXTS, 1)})))
def corrupt_text(spark, folder):
    return shown(D.text_damage(base(spark, folder), 20, ID, 7))


@query(f"""SELECT {ID}, {", ".join(f"CASE WHEN {pick(10, 4 + i)} THEN 'INVALID' ELSE CAST({n} AS VARCHAR) END AS {n}"
  for i, n in enumerate(["o_custkey", "o_cents"], 1))} FROM (SELECT {ID}, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS o_cents FROM orders) b""")
def corrupt_types(spark, folder):
    df = base(spark, folder).select(ID, "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("o_cents"))
    return D.type_mismatch(df, 10, ID, 4)


@query(project({n: f"CASE WHEN {pick(9, 2 + i)} AND {n} <> 0 THEN -{n} ELSE {n} END" for i, n in enumerate(NUMBERS, 1)}))
def corrupt_signs(spark, folder):
    return D.sign_flips(base(spark, folder), 9, ID, 2)


@query(project({n: f"CASE WHEN {pick(12, 6)} THEN CAST({choose(6 + i, [999999, -999999])} AS DOUBLE) ELSE CAST({n} AS DOUBLE) END"
                for i, n in enumerate(NUMBERS, 1)}))
def corrupt_extremes(spark, folder):
    return D.extremes(base(spark, folder), 12, ID, 5)


@query(project({n: r(f"CASE WHEN {pick(10, 4 + i)} THEN (SELECT CAST(max({n}) AS DOUBLE) FROM orders) * (2.0 + 3.0 * ({draw(53 + i)} / 2147483647.0)) ELSE CAST({n} AS DOUBLE) END", 4)
                for i, n in enumerate(NUMBERS)}))
def corrupt_beyond_max(spark, folder):
    return rounded(D.beyond_max(base(spark, folder), 10, ID, 3), 4)


@query(f"SELECT {ID}, {', '.join(DATA)} FROM ({BASE}) b WHERE NOT ({pick(30, 12)})")
def corrupt_row_drop(spark, folder):
    return D.drop_rows(base(spark, folder), 30, ID, 11)


def _case_of(n: str, i: int, seed: int) -> str:
    kind = (i * 48271 + seed * 7919) % 2147483647 * 16807 % 2147483647 % 3
    return (n.lower(), n.upper(), n.replace("_", " "))[kind]


@query("SELECT " + ", ".join(f'{n} AS "{_case_of(n, i, 3)}"' for i, n in enumerate([ID, *DATA], 1)) + " FROM orders")
def corrupt_column_names(spark, folder):
    return D.damaged_names(base(spark, folder), 3)


@query(f"""SELECT {ID}, CASE WHEN {pick(6, 2)} THEN 'XXX' ELSE o_orderstatus END AS o_orderstatus,
CASE WHEN {pick(4, 3)} THEN CAST(o_custkey AS VARCHAR) || 'X' ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey FROM orders""")
def corrupt_codes(spark, folder):
    one = D.scrambled_codes(base(spark, folder), 6, ID, "o_orderstatus", seed=1)
    return D.scrambled_codes(one, 4, ID, "o_orderpriority", "o_custkey", seed=1).select(ID, "o_orderstatus", "o_custkey")


_BLANK = ["o_orderstatus", "o_orderpriority", "o_day", "o_totalprice"]
_BLANK_SQL = f"SELECT {ID}, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_day, o_totalprice FROM orders"


def _blank(n: str, i: int) -> str:
    hit, kind = pick(30, 3), choose(4, [0, 1, 2, 3])
    cases = f"WHEN {hit} AND {kind} = 2 AND {pick(60, 4 + i)} THEN NULL "
    if n != "o_totalprice":
        cases += f"WHEN {hit} AND {kind} = 0 AND {pick(40, 4 + i)} THEN '' WHEN {hit} AND {kind} = 1 AND {pick(40, 4 + i)} THEN '   ' "
    if n == "o_day":
        cases += rf"WHEN {hit} AND {kind} = 3 THEN regexp_replace({n}, '^(\d{{4}})-(\d{{2}})-(\d{{2}})$', '\2/\3/\1') "
    return f"CASE {cases} ELSE {n} END"


@query(project({n: _blank(n, i) for i, n in enumerate(_BLANK, 1)}, _BLANK_SQL, _BLANK))
def corrupt_blanks(spark, folder):
    df = table(spark, folder, "orders").select(
        ID, "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day"), "o_totalprice")
    return D.blanks(df, 30, ID, 2, date="o_day")


@query(out(mixed_sql(8, 2)))
def corrupt_mixed(spark, folder):
    return shown(D.mixed(base(spark, folder), 8, ID, 2))


# -- grid --------------------------------------------------------------------

CUSTOMER = ["c_nationkey", "c_acctbal", "c_name", "c_mktsegment"]
CUSTOMER_SQL = "SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal, c_name, c_mktsegment FROM customer"
GRID_SQL = {
    "missing": lambda p, s: nulls_sql(p, s, CUSTOMER_SQL, CUSTOMER, "c_custkey"),
    "duplicates": lambda p, s: copies_sql(p, s, CUSTOMER_SQL, CUSTOMER, "c_custkey"),
    "outliers": lambda p, s: outliers_sql(p, s, CUSTOMER_SQL, CUSTOMER, CUSTOMER[:2], "c_custkey"),
    "inconsistency": lambda p, s: column_nulls_sql(p, s, CUSTOMER_SQL, CUSTOMER, "c_custkey"),
    "mixed": lambda p, s: mixed_sql(p, s, CUSTOMER_SQL, CUSTOMER, CUSTOMER[:2], "c_custkey"),
}
LEVELS = {"light": 5.0, "medium": 12.0, "severe": 25.0}


def grid_sql() -> str:
    parts = [f"SELECT 'original' AS dataset_id, 1 AS label, 'none' AS severity, * FROM ({CUSTOMER_SQL}) c"]
    for k, (kind, make) in enumerate(GRID_SQL.items()):
        for level, pct in LEVELS.items():
            parts.append(f"SELECT '{kind}_{level}' AS dataset_id, 0 AS label, '{level}' AS severity, * FROM ({make(pct, 1000 * k)}) c")
    return union(parts)


def grid(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", *CUSTOMER)
    return D.severity_grid(df, "c_custkey")


def features_sql(source: str, numbers: list[str], texts: list[str]) -> str:
    """CTEs ``t, num, dis, dup, tot`` for rows with a ``dataset_id``."""
    data = numbers + texts
    cells = union([f"SELECT dataset_id, '{n}' AS c, CAST({n} AS DOUBLE) AS v FROM t WHERE {n} IS NOT NULL" for n in numbers])
    distinct = union([f"SELECT dataset_id, '{n}' AS c, count(DISTINCT {n}) AS d FROM t GROUP BY dataset_id" for n in data])
    return f"""t AS ({source}), mom AS (SELECT dataset_id, c, count(*) AS n, avg(v) AS m, stddev_samp(v) AS s, var_samp(v) AS va,
  skewness(v) AS sk, kurtosis(v) AS ku FROM ({cells}) x GROUP BY dataset_id, c),
num AS (SELECT dataset_id, avg(CASE WHEN abs(m) > 1e-10 THEN least(abs(s / m), 100) END) AS nv,
  avg(CASE WHEN n >= 3 THEN coalesce(abs(sk), 0) END) AS sk, var_pop(CASE WHEN n >= 3 THEN coalesce(abs(sk), 0) END) AS vsk,
  avg(coalesce(abs(sk) * (n - 2) / sqrt(CAST(n AS DOUBLE) * (n - 1)), 0)) AS g1, avg(va) AS va,
  avg(CASE WHEN n >= 4 THEN coalesce(abs(ku), 0) END) AS ku FROM mom GROUP BY dataset_id),
dis AS (SELECT dataset_id, sum(d) AS total, count(*) FILTER (WHERE d <= 1) AS constants FROM ({distinct}) x GROUP BY dataset_id),
dup AS (SELECT dataset_id, sum(n - 1) AS copies FROM (SELECT dataset_id, count(*) AS n FROM t GROUP BY dataset_id, {", ".join(data)}) x GROUP BY dataset_id),
tot AS (SELECT dataset_id, count(*) AS num_rows, {" + ".join(f"count(*) - count({n})" for n in data)} AS missing FROM t GROUP BY dataset_id),
f AS (SELECT dataset_id, num_rows, {len(data)} AS num_columns, missing * 1.0 / (num_rows * {len(data)}) AS missing_ratio,
  copies * 1.0 / num_rows AS duplicate_ratio, {len(numbers)} * 1.0 / {len(data)} AS numeric_ratio, CAST(constants AS DOUBLE) AS constant_cols,
  coalesce(nv, 0) AS norm_variance, coalesce(sk, 0) AS skewness, least(total * 1.0 / {len(data)} / num_rows, 1.0) AS cardinality_ratio,
  least(coalesce(ku, 0) / 10, 1.0) AS mean_kurtosis, coalesce(va, 0) AS avg_variance, coalesce(g1, 0) AS avg_skewness,
  coalesce(vsk, 0) AS skewness_variance, coalesce(ku, 0) AS raw_kurtosis
  FROM tot JOIN dup USING (dataset_id) JOIN dis USING (dataset_id) LEFT JOIN num USING (dataset_id))"""


EIGHT = ["missing_ratio", "duplicate_ratio", "numeric_ratio", "constant_cols", "norm_variance", "skewness",
         "cardinality_ratio", "mean_kurtosis"]


def picked_features(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


@query(f"WITH {features_sql(grid_sql(), CUSTOMER[:2], CUSTOMER[2:])} SELECT dataset_id, num_rows, {picked_features(EIGHT, 5)} FROM f")
def severity_grid_features(spark, folder):
    m = X.measures(grid(spark, folder), "dataset_id", "c_custkey", ["label", "severity"])
    return rounded(X.features8(m).select("dataset_id", "num_rows", *EIGHT), 5)


@query(f"""SELECT label, severity, count(*) AS datasets FROM (SELECT DISTINCT dataset_id, label, severity FROM ({grid_sql()}) g) x
GROUP BY label, severity""")
def class_balance(spark, folder):
    return X.class_balance(grid(spark, folder).select("dataset_id", "label", "severity").distinct())


def normal(salt: int | str, k: str = ID) -> str:
    size, turn = (f"(0.5 + {draw(f'{salt} + {i}', k)})" for i in (0, 4001))
    return f"(sqrt(-2.0 * ln({size} / 2147483647)) * cos({turn} / 2147483647 * 2 * pi()))"


def drawn_at(salt: int) -> str:
    return f"({draw(salt, 'f.at')} * 2147483647 + {draw(salt + 4001, 'f.at')}) % (SELECT count(*) FROM orders)"


_PLACED = f"SELECT *, row_number() OVER (ORDER BY {ID}) - 1 AS at FROM ({BASE}) b"


def _deviation(n: str) -> str:
    return f"(SELECT stddev_samp(CAST({n} AS DOUBLE)) FROM orders)"


@query(project({n: r(f"CAST({n} AS DOUBLE) + CASE WHEN {pick(10, 3 + i)} THEN {normal(103 + i)} * {_deviation(n)} "
                     "ELSE 0 END", 4) for i, n in enumerate(NUMBERS, 1)}))
def corrupt_noise(spark, folder):
    return rounded(D.noise(base(spark, folder), 10, ID, 3), 4)


def _realistic_sql(pct: float, seed: int) -> str:
    step = project({n: f"CASE WHEN NOT ({pick(pct * 0.6, seed + 1)}) THEN {n} END"
                    for n in column_order(DATA, seed)[:max(1, int(len(DATA) * 0.3))]})
    first = f"{draw(seed + 22)} % {len(NUMBERS)}"
    step = project({
        n: f"CAST({n} AS DOUBLE) * CASE WHEN {pick(pct * 0.4, seed + 21)} AND ({first} = {i} OR ({first} + 1) % {len(NUMBERS)} = {i} "
           f"OR {pick(50, seed + 23 + i)}) THEN {choose(seed + 23 + i, [-50, 50, 100])} ELSE 1 END"
        for i, n in enumerate(NUMBERS)}, step)
    step = project({n: f"CASE WHEN {pick(pct * 0.3, seed + 40 + i)} AND {n} <> 0 THEN -{n} ELSE {n} END"
                    for i, n in enumerate(NUMBERS, 1)}, step)
    halves = {n: f"CASE WHEN {pick(30, seed + 61 + i)} THEN substr({n}, 1, length({n}) // 2) ELSE {n} END" for i, n in enumerate(TEXTS, 1)}
    copied = project(halves | {ID: f"-1 - {ID}"}, f"SELECT * FROM ({step}) s WHERE {pick(pct * 0.3, seed + 61)}", [ID, *DATA], f"{ID} AS known")
    return f"{step} UNION ALL SELECT * EXCLUDE (known) FROM ({copied}) y"


@query(_realistic_sql(12, 3))
def corrupt_mixed_realistic(spark, folder):
    return D.mixed_realistic(base(spark, folder), 12, ID, 3)


def _noise_sql(pct: float, seed: int, source: str) -> str:
    return project({
        n: f"CAST({n} AS DOUBLE) + CASE WHEN {pick(pct, seed + i, 'c_custkey')} THEN {normal(seed + 100 + i, 'c_custkey')} "
           f"* (SELECT stddev_samp(CAST({n} AS DOUBLE)) FROM ({source}) d) ELSE 0 END"
        for i, n in enumerate(CUSTOMER[:2], 1)}, source, CUSTOMER, "c_custkey")


def ladder_sql(steps: int = 15, good: int = 8) -> str:
    parts = []
    for i in range(steps):
        pct = 100 * (0.15 + (i / steps) * 0.35)
        step = nulls_sql(pct * 0.3, 100 * i, CUSTOMER_SQL, CUSTOMER, "c_custkey")
        step = copies_sql(pct * 0.2, 100 * i + 40, _noise_sql(pct * 0.2, 100 * i + 20, step), CUSTOMER, "c_custkey")
        parts.append(f"SELECT 'bad_{i}' AS dataset_id, 0 AS label, * FROM ({step}) z")
    for i in range(good):
        step = nulls_sql(1.0, 7000 + i, CUSTOMER_SQL, CUSTOMER, "c_custkey") if i % 2 == 0 else CUSTOMER_SQL
        parts.append(f"SELECT 'good_{i}' AS dataset_id, 1 AS label, * FROM ({step}) z")
    return union(parts)


@query(f"WITH {features_sql(ladder_sql(), CUSTOMER[:2], CUSTOMER[2:])} SELECT dataset_id, num_rows, {picked_features(EIGHT, 5)} FROM f")
def intensity_ladder_features(spark, folder):
    """All fifteen bad and eight good variants."""
    df = table(spark, folder, "customer").select("c_custkey", *CUSTOMER)
    m = X.measures(D.intensity_ladder(df, "c_custkey"), "dataset_id", "c_custkey", ["label"])
    return rounded(X.features8(m).select("dataset_id", "num_rows", *EIGHT), 5)


@query(f"""
WITH p AS ({_PLACED})
SELECT f.at AS {ID}, {", ".join(r(f"a.{n} + {normal(105 + i, 'f.at')} * {_deviation(n)} * 0.05", 4) + f" AS {n}"
                                for i, n in enumerate(NUMBERS))}, {", ".join(f"a.{n}" for n in TEXTS)}
FROM p f JOIN p a ON a.at = {drawn_at(9005)}
""")
def bootstrap_good(spark, folder):
    return rounded(D.bootstrap_good(base(spark, folder), ID, 5), 4)


def _share(i: int) -> str:
    return f"({draw(206 + i, 'f.at')} / 2147483647.0::DOUBLE)"


@query(f"""
WITH p AS ({_PLACED})
SELECT f.at AS {ID}, {", ".join(r(f"a.{n} * {_share(i)} + b.{n} * (1 - {_share(i)})", 4) + f" AS {n}"
                                for i, n in enumerate(NUMBERS))},
  {", ".join(f"CASE WHEN {_share(2 + i)} < 0.5 THEN a.{n} ELSE b.{n} END AS {n}" for i, n in enumerate(TEXTS))}
FROM p f JOIN p a ON a.at = {drawn_at(9005)} JOIN p b ON b.at = {drawn_at(9105)}
""")
def interpolated_good(spark, folder):
    return rounded(D.interpolated_good(base(spark, folder), ID, 5), 4)
