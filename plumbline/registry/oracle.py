"""The registered queries as ANSI SQL over the test tables."""

from __future__ import annotations

from collections.abc import Sequence

_DIRTY = """
    SELECT o_orderkey, nullif(o_custkey % 100, 7) AS custbucket, nullif(o_orderstatus, 'P') AS status,
           CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderpriority AS prio
    FROM orders
"""

ORACLE_SQL: dict[str, str] = {}


def _mean(column: str) -> str:
    """The mean from an exact sum: every value in the test tables is a whole number of 2**-62, and
    texts are read as the nearest double."""
    units = f"sum(CAST(CAST({column} AS DOUBLE) * 4611686018427387904 AS HUGEINT))"
    return f"CAST(CAST({units} AS VARCHAR) AS DOUBLE) / 4611686018427387904 / count({column})"


# -- sources ------------------------------------------------------------------

ORACLE_SQL["scan_csv"] = """
    SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM customer
"""
ORACLE_SQL["scan_parquet"] = "SELECT * FROM lineitem"
ORACLE_SQL["scan_json"] = """
    SELECT event_id, event_type, props, CAST(ts AS VARCHAR) AS ts, user_id, value FROM events
"""
_TABLES = (
    "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier"
).split()
ORACLE_SQL["file_inventory"] = " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS name, 'parquet' AS ext, TRUE AS has_size, {t == 'orders'} AS active, CAST(NULL AS VARCHAR) AS bucket"
    for t in _TABLES
)
ORACLE_SQL["sql_source"] = """
    SELECT c_mktsegment, o_orderstatus, count(*) AS orders,
           min(o_totalprice) AS lowest, max(o_totalprice) AS highest
    FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY c_mktsegment, o_orderstatus
"""


# -- preview and profile ------------------------------------------------------


def _profile(source: str, columns: Sequence[tuple[str, str]]) -> str:
    """One SELECT per (column, type name)."""
    parts = []
    for pos, (name, kind) in enumerate(columns):
        numeric = kind in ("int", "bigint", "float", "double")
        stats = (
            f"CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max, "
            f"{_mean(name)} AS mean"
            if numeric
            else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean"
        )
        parts.append(
            f"SELECT CAST({pos} AS INTEGER) AS pos, '{name}' AS \"column\", '{kind}' AS type, "
            f"count(*) - count({name}) AS nulls, "
            f"count(DISTINCT {name}) + CASE WHEN count(*) > count({name}) THEN 1 ELSE 0 END AS \"unique\", "
            f"count(*) AS total, {stats} FROM d"
        )
    return f"WITH d AS ({source}) " + " UNION ALL ".join(parts)


_DIRTY_COLUMNS = [
    ("o_orderkey", "bigint"),
    ("custbucket", "bigint"),
    ("status", "string"),
    ("price", "double"),
    ("prio", "string"),
]
_LINEITEM_COLUMNS = [
    ("l_orderkey", "bigint"),
    ("l_partkey", "bigint"),
    ("l_suppkey", "bigint"),
    ("l_linenumber", "int"),
    ("l_quantity", "double"),
    ("l_extendedprice", "double"),
    ("l_discount", "double"),
    ("l_tax", "double"),
    ("l_returnflag", "string"),
    ("l_linestatus", "string"),
    ("l_shipdate", "timestamp_ntz"),
]
_DOCUMENT_COLUMNS = [
    ("doc_id", "bigint"),
    ("text", "string"),
    ("lang", "string"),
    ("source", "string"),
    ("n_chars", "bigint"),
]

ORACLE_SQL["sql_source_profile"] = _profile(
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
              c_name, c_nationkey, c_acctbal, c_mktsegment
       FROM orders JOIN customer ON o_custkey = c_custkey""",
    [
        ("o_orderkey", "bigint"),
        ("o_custkey", "bigint"),
        ("o_orderstatus", "string"),
        ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"),
        ("o_orderpriority", "string"),
        ("c_name", "string"),
        ("c_nationkey", "int"),
        ("c_acctbal", "double"),
        ("c_mktsegment", "string"),
    ],
)
ORACLE_SQL["columns"] = """
    SELECT CAST(pos AS INTEGER) AS pos, name, type
    FROM (VALUES (0, 'p_brand', 'string'), (1, 'p_name', 'string'), (2, 'p_partkey', 'bigint'),
                 (3, 'p_retailprice', 'double'), (4, 'p_size', 'bigint'), (5, 'p_type', 'string'))
         AS t(pos, name, type)
"""
ORACLE_SQL["preview_topk"] = """
    SELECT *, (SELECT count(*) FROM orders) AS total_rows
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
"""
ORACLE_SQL["row_count"] = "SELECT count(*) AS total_rows FROM lineitem"
ORACLE_SQL["null_counts"] = f"SELECT pos, \"column\", nulls FROM ({_profile(_DIRTY, _DIRTY_COLUMNS)}) p"
ORACLE_SQL["distinct_counts"] = (
    f"SELECT pos, \"column\", \"unique\" FROM ({_profile('SELECT * FROM documents', _DOCUMENT_COLUMNS)}) p"
)
ORACLE_SQL["numeric_stats"] = f"""
    SELECT pos, "column", min, max, mean FROM ({_profile(_DIRTY, _DIRTY_COLUMNS)}) p
    WHERE type IN ('bigint', 'double')
"""
ORACLE_SQL["profile"] = _profile(_DIRTY, _DIRTY_COLUMNS)
ORACLE_SQL["profile_lineitem"] = _profile("SELECT * FROM lineitem", _LINEITEM_COLUMNS)
ORACLE_SQL["profile_approx"] = ORACLE_SQL["profile_states"] = f"""
    SELECT * EXCLUDE ("unique"), TRUE AS within_3_percent FROM ({ORACLE_SQL['profile_lineitem']}) p
"""
ORACLE_SQL["profile_embeddings"] = _profile(
    "SELECT * FROM embeddings",
    [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
)
ORACLE_SQL["profile_pct"] = f"""
    SELECT "column",
           CAST(floor(nulls::DOUBLE / total * 100 + 0.5) AS BIGINT) AS null_pct,
           CAST(floor("unique"::DOUBLE / total * 100 + 0.5) AS BIGINT) AS unique_pct,
           floor(nulls::DOUBLE / total * 100 + 0.5) > 20 AS null_alert
    FROM ({_profile(_DIRTY, _DIRTY_COLUMNS)}) p
"""
ORACLE_SQL["dataset_summary"] = f"""
    SELECT CAST(max(total) AS BIGINT) AS rows, CAST(count(*) AS INTEGER) AS columns,
           CAST(sum(nulls) AS BIGINT) AS total_nulls, 'PARQUET' AS format
    FROM ({_profile(_DIRTY, _DIRTY_COLUMNS)}) p
"""


# -- rules --------------------------------------------------------------------


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def _row(
    pos: int,
    column: str | None,
    success: str,
    error: str | None = None,
    observed: str = "NULL",
    elements: str = "NULL",
    unexpected: str = "NULL",
    **more: str,
) -> str:
    """A result row over the aggregates of CTE ``a``."""
    extra = "".join(f", {_text(v)} AS {k}" for k, v in more.items())
    return (
        f"SELECT CAST({pos} AS INTEGER) AS pos, {_text(column)} AS \"column\", "
        f"CAST({success} AS BOOLEAN) AS success, {_text(error)} AS error, "
        f"CAST({observed} AS DOUBLE) AS observed, CAST({elements} AS BIGINT) AS element_count, "
        f"CAST({unexpected} AS BIGINT) AS unexpected_count{extra} FROM a"
    )


def _repeated(column: str, source: str = "d") -> str:
    """Rows whose value occurs more than once."""
    return (
        f"(SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM {source} "
        f"WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1) g)"
    )


def _rules(aggregates: str, rows: Sequence[str], source: str = _DIRTY) -> str:
    return f"WITH d AS ({source}), a AS (SELECT {aggregates} FROM d) " + " UNION ALL ".join(rows)


_NO_COST = "no such column: cost"

ORACLE_SQL["rule_column_exists"] = _rules(
    "count(*) AS n, count(*) - count(price) AS nulls",
    [
        _row(0, "price", "TRUE"),
        _row(1, "price", "TRUE"),
        _row(2, "cost", "FALSE"),
        _row(3, None, "FALSE", "missing parameter: column"),
        _row(4, "price", "nulls = 0", elements="n", unexpected="nulls"),
    ],
)
ORACLE_SQL["rule_not_null"] = _rules(
    "count(*) AS n, count(*) - count(o_orderkey) AS k, count(*) - count(status) AS s",
    [
        _row(0, "o_orderkey", "k = 0", elements="n", unexpected="k"),
        _row(1, "status", "s = 0", elements="n", unexpected="s"),
        _row(2, "status", "(n - s)::DOUBLE / n >= 0.5", elements="n", unexpected="s"),
        _row(3, "cost", "FALSE", _NO_COST),
    ],
)
ORACLE_SQL["rule_unique"] = _rules(
    f"count(o_orderkey) AS nk, {_repeated('o_orderkey')} AS k, "
    f"count(custbucket) AS nb, {_repeated('custbucket')} AS b, "
    f"count(price) AS np, {_repeated('price')} AS p",
    [
        _row(0, "o_orderkey", "k = 0", elements="nk", unexpected="k"),
        _row(1, "custbucket", "b = 0", elements="nb", unexpected="b"),
        _row(2, "price", "(np - p)::DOUBLE / np >= 0.9", elements="np", unexpected="p"),
        _row(3, "cost", "FALSE", _NO_COST),
    ],
)
ORACLE_SQL["rule_between"] = _rules(
    "count(price) AS np, count(custbucket) AS nb, "
    "count(*) FILTER (price NOT BETWEEN 0 AND 1000000) AS wide, "
    "count(*) FILTER (price NOT BETWEEN 1000 AND 400000) AS narrow, "
    "count(*) FILTER (custbucket <= 0) AS zero",
    [
        _row(0, "price", "wide = 0", elements="np", unexpected="wide"),
        _row(1, "price", "narrow = 0", elements="np", unexpected="narrow"),
        _row(2, "custbucket", "zero = 0", elements="nb", unexpected="zero"),
        _row(3, "status", "FALSE", "not a numeric column: status (string)"),
        _row(4, "price", "FALSE", "min_value 2.0 is greater than max_value 1.0"),
        _row(5, "price", "FALSE", "min_value and max_value are both absent"),
        _row(6, "price", "FALSE", "min_value is not a number: 'low'"),
    ],
)
ORACLE_SQL["rule_regex"] = _rules(
    "count(prio) AS n, count(custbucket) AS nb, "
    "count(*) FILTER (NOT regexp_matches(prio, '^[1-5]-')) AS five, "
    "count(*) FILTER (NOT regexp_matches(prio, '^[1-3]-')) AS three, "
    "count(*) FILTER (NOT regexp_matches(CAST(custbucket AS VARCHAR), '9')) AS nine",
    [
        _row(0, "prio", "five = 0", elements="n", unexpected="five"),
        _row(1, "prio", "three = 0", elements="n", unexpected="three"),
        _row(2, "prio", "(n - three)::DOUBLE / n >= 0.5", elements="n", unexpected="three"),
        _row(3, "custbucket", "nine = 0", elements="nb", unexpected="nine"),
        _row(4, "prio", "FALSE", "invalid regular expression: ["),
    ],
)
ORACLE_SQL["rule_in_set"] = _rules(
    "count(status) AS n, count(custbucket) AS nb, "
    "count(*) FILTER (status NOT IN ('O', 'F')) AS two, "
    "count(*) FILTER (status NOT IN ('O')) AS one, "
    "count(*) FILTER (custbucket NOT IN (1)) AS single, "
    "count(*) FILTER (custbucket NOT BETWEEN 0 AND 49) AS half",
    [
        _row(0, "status", "two = 0", elements="n", unexpected="two"),
        _row(1, "status", "one = 0", elements="n", unexpected="one"),
        _row(2, "custbucket", "single = 0", elements="nb", unexpected="single"),
        _row(3, "custbucket", "(nb - half)::DOUBLE / nb >= 0.25", elements="nb", unexpected="half"),
        _row(4, "status", "FALSE", "missing parameter: value_set"),
    ],
)
ORACLE_SQL["rule_row_count"] = _rules(
    "count(*) AS n",
    [
        _row(0, None, "n BETWEEN 1 AND 1e15", observed="n", elements="n"),
        _row(1, None, "n <= 10", observed="n", elements="n"),
        _row(2, None, "FALSE", "min_value and max_value are both absent"),
    ],
)
ORACLE_SQL["rule_mean"] = _rules(
    f"count(price) AS np, {_mean('price')} AS p, count(custbucket) AS nb, {_mean('custbucket')} AS b",
    [
        _row(0, "price", "p BETWEEN 200000 AND 300000", observed="p", elements="np"),
        _row(1, "price", "p BETWEEN 0 AND 1000", observed="p", elements="np"),
        _row(2, "custbucket", "b >= 10", observed="b", elements="nb"),
        _row(3, "prio", "FALSE", "not a numeric column: prio (string)"),
    ],
)


# -- suites -------------------------------------------------------------------

_NOT_NULL = "expect_column_values_to_not_be_null"
_UNIQUE = "expect_column_values_to_be_unique"
_BETWEEN = "expect_column_values_to_be_between"
_REGEX = "expect_column_values_to_match_regex"
_IN_SET = "expect_column_values_to_be_in_set"
_ROWS = "expect_table_row_count_to_be_between"
_MEAN = "expect_column_mean_to_be_between"
_EXISTS = "expect_column_to_exist"


def _with_status(sql: str) -> str:
    return f"SELECT *, CASE WHEN success THEN 'passed' ELSE 'failed' END AS status FROM ({sql}) r"


ORACLE_SQL["validate_suite"] = _with_status(
    _rules(
        "count(*) AS n, count(*) - count(status) AS s, count(price) AS np, "
        "count(*) FILTER (price NOT BETWEEN 1000 AND 400000) AS narrow, "
        f"count(o_orderkey) AS nk, {_repeated('o_orderkey')} AS k, count(prio) AS nr, "
        "count(*) FILTER (NOT regexp_matches(prio, '^[1-5]-')) AS five, count(status) AS ns, "
        f"count(*) FILTER (status NOT IN ('O', 'F')) AS two, {_mean('price')} AS p, "
        f"count(custbucket) AS nb, {_repeated('custbucket')} AS b, "
        "count(*) FILTER (NOT regexp_matches(prio, '^[1-3]-')) AS three",
        [
            _row(0, "status", "s = 0", elements="n", unexpected="s",
                 expectation_type=_NOT_NULL, kwargs='{"column": "status"}'),
            _row(1, "price", "narrow = 0", elements="np", unexpected="narrow",
                 expectation_type=_BETWEEN,
                 kwargs='{"column": "price", "min_value": 1000.0, "max_value": 400000.0}'),
            _row(2, None, "n BETWEEN 1 AND 1e15", observed="n", elements="n",
                 expectation_type=_ROWS, kwargs='{"min_value": 1.0, "max_value": 1000000000000000.0}'),
            _row(3, "o_orderkey", "k = 0", elements="nk", unexpected="k",
                 expectation_type=_UNIQUE, kwargs='{"column": "o_orderkey"}'),
            _row(4, "price", "TRUE", expectation_type=_EXISTS, kwargs='{"column": "price"}'),
            _row(5, "prio", "five = 0", elements="nr", unexpected="five",
                 expectation_type=_REGEX, kwargs='{"column": "prio", "regex": "^[1-5]-"}'),
            _row(6, "status", "two = 0", elements="ns", unexpected="two",
                 expectation_type=_IN_SET, kwargs='{"column": "status", "value_set": ["O", "F"]}'),
            _row(7, "price", "p BETWEEN 200000 AND 300000", observed="p", elements="np",
                 expectation_type=_MEAN,
                 kwargs='{"column": "price", "min_value": 200000.0, "max_value": 300000.0}'),
            _row(8, "custbucket", "b = 0", elements="nb", unexpected="b",
                 expectation_type=_UNIQUE, kwargs='{"column": "custbucket"}'),
            _row(9, "prio", "(nr - three)::DOUBLE / nr >= 0.5", elements="nr", unexpected="three",
                 expectation_type=_REGEX, kwargs='{"column": "prio", "regex": "^[1-3]-", "mostly": 0.5}'),
        ],
    )
)
ORACLE_SQL["validate_lineitem"] = _with_status(
    _rules(
        "count(*) AS n, count(*) - count(l_orderkey) AS ok, count(*) - count(l_shipdate) AS sd, "
        "count(*) FILTER (l_quantity NOT BETWEEN 1 AND 50) AS q, "
        "count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05::DOUBLE) AS disc, "
        "count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) AS rf, "
        "count(*) FILTER (l_linestatus NOT IN ('O')) AS ls, "
        "count(*) FILTER (NOT regexp_matches(CAST(l_shipdate AS VARCHAR), '^19[0-9]{2}-')) AS re, "
        f"{_mean('l_quantity')} AS mq, {_repeated('l_extendedprice')} AS ep, {_repeated('l_linenumber')} AS ln",
        [
            _row(0, None, "n >= 1", observed="n", elements="n",
                 expectation_type=_ROWS, kwargs='{"min_value": 1.0, "max_value": null}'),
            _row(1, "l_orderkey", "ok = 0", elements="n", unexpected="ok",
                 expectation_type=_NOT_NULL, kwargs='{"column": "l_orderkey"}'),
            _row(2, "l_shipdate", "sd = 0", elements="n", unexpected="sd",
                 expectation_type=_NOT_NULL, kwargs='{"column": "l_shipdate"}'),
            _row(3, "l_quantity", "q = 0", elements="n", unexpected="q", expectation_type=_BETWEEN,
                 kwargs='{"column": "l_quantity", "min_value": 1.0, "max_value": 50.0}'),
            _row(4, "l_discount", "disc = 0", elements="n", unexpected="disc", expectation_type=_BETWEEN,
                 kwargs='{"column": "l_discount", "min_value": 0.0, "max_value": 0.05}'),
            _row(5, "l_returnflag", "rf = 0", elements="n", unexpected="rf", expectation_type=_IN_SET,
                 kwargs='{"column": "l_returnflag", "value_set": ["A", "N", "R"]}'),
            _row(6, "l_linestatus", "ls = 0", elements="n", unexpected="ls", expectation_type=_IN_SET,
                 kwargs='{"column": "l_linestatus", "value_set": ["O"]}'),
            _row(7, "l_shipdate", "re = 0", elements="n", unexpected="re", expectation_type=_REGEX,
                 kwargs='{"column": "l_shipdate", "regex": "^19[0-9]{2}-"}'),
            _row(8, "l_quantity", "mq BETWEEN 20 AND 30", observed="mq", elements="n",
                 expectation_type=_MEAN,
                 kwargs='{"column": "l_quantity", "min_value": 20.0, "max_value": 30.0}'),
            _row(9, "l_extendedprice", "ep = 0", elements="n", unexpected="ep",
                 expectation_type=_UNIQUE, kwargs='{"column": "l_extendedprice"}'),
            _row(10, "l_linenumber", "ln = 0", elements="n", unexpected="ln",
                 expectation_type=_UNIQUE, kwargs='{"column": "l_linenumber"}'),
        ],
        "SELECT * FROM lineitem",
    )
)
ORACLE_SQL["validate_observed"] = ORACLE_SQL["stream_validate"] = ORACLE_SQL["validate_lineitem"]
ORACLE_SQL["validate_documents"] = _with_status(
    _rules(
        f"count(*) AS n, {_repeated('doc_id')} AS id, {_repeated('text')} AS tx, "
        "count(*) FILTER (NOT regexp_matches(text, '[a-z]@[a-z]')) AS re, "
        "count(*) FILTER (lang NOT IN ('en', 'fr', 'de', 'es')) AS la, "
        f"count(*) FILTER (n_chars < 20) AS nc, {_mean('n_chars')} AS mc",
        [
            _row(0, "doc_id", "id = 0", elements="n", unexpected="id",
                 expectation_type=_UNIQUE, kwargs='{"column": "doc_id"}'),
            _row(1, "text", "tx = 0", elements="n", unexpected="tx",
                 expectation_type=_UNIQUE, kwargs='{"column": "text"}'),
            _row(2, "text", "(n - re)::DOUBLE / n >= 0.01", elements="n", unexpected="re",
                 expectation_type=_REGEX,
                 kwargs='{"column": "text", "regex": "[a-z]@[a-z]", "mostly": 0.01}'),
            _row(3, "lang", "la = 0", elements="n", unexpected="la", expectation_type=_IN_SET,
                 kwargs='{"column": "lang", "value_set": ["en", "fr", "de", "es"]}'),
            _row(4, "n_chars", "nc = 0", elements="n", unexpected="nc", expectation_type=_BETWEEN,
                 kwargs='{"column": "n_chars", "min_value": 20.0, "max_value": null}'),
            _row(5, "n_chars", "mc BETWEEN 1 AND 1e6", observed="mc", elements="n",
                 expectation_type=_MEAN,
                 kwargs='{"column": "n_chars", "min_value": 1.0, "max_value": 1000000.0}'),
        ],
        "SELECT * FROM documents",
    )
)
ORACLE_SQL["validate_with_errors"] = (
    "SELECT * EXCLUDE (observed) FROM ("
    + _with_status(
        _rules(
            "count(*) AS n, count(*) - count(o_orderkey) AS nk, count(o_totalprice) AS np, "
            f"count(*) FILTER (o_totalprice < 1000) AS low, {_repeated('o_orderkey')} AS rk",
            [
                _row(0, "o_orderkey", "nk = 0", elements="n", unexpected="nk", expectation_type=_NOT_NULL),
                _row(1, "rank", "FALSE", "USER_RAISED_EXCEPTION", expectation_type=_BETWEEN),
                _row(2, "o_totalprice", "low = 0", elements="np", unexpected="low", expectation_type=_BETWEEN),
                _row(3, "o_orderkey", "FALSE", "unsupported rule type: expect_column_values_to_be_sorted",
                     expectation_type="expect_column_values_to_be_sorted"),
                _row(4, "o_orderkey", "rk = 0", elements="n", unexpected="rk", expectation_type=_UNIQUE),
                _row(5, "o_orderkey", "FALSE", "unknown parameter: severity", expectation_type=_NOT_NULL),
            ],
            "SELECT * FROM orders",
        )
    )
    + ") e"
)


def _many(label: str, table: str) -> str:
    unique = (
        _row(1, "c_custkey", "u = 0", elements="n", unexpected="u",
             expectation_type=_UNIQUE, source_label=label)
        if table == "customer"
        else _row(1, "C_Custkey", "FALSE", "no such column: C_Custkey",
                  expectation_type=_UNIQUE, source_label=label)
    )
    mean = (
        _row(2, "s_acctbal", "m BETWEEN 0 AND 9000", observed="m", elements="n",
             expectation_type=_MEAN, source_label=label)
        if table == "supplier"
        else _row(2, "s_acctbal", "FALSE", "no such column: s_acctbal",
                  expectation_type=_MEAN, source_label=label)
    )
    aggregates = (
        "count(*) AS n"
        + (f", {_repeated('c_custkey')} AS u" if table == "customer" else "")
        + (f", {_mean('s_acctbal')} AS m" if table == "supplier" else "")
    )
    rows = [
        _row(0, None, "n >= 100", observed="n", elements="n", expectation_type=_ROWS, source_label=label),
        unique,
        mean,
    ]
    return f"SELECT * FROM ({_rules(aggregates, rows, f'SELECT * FROM {table}')}) {table}_results"


ORACLE_SQL["validate_many"] = _with_status(
    " UNION ALL ".join(_many(f"{t}.parquet", t) for t in ("customer", "supplier", "nation"))
)
ORACLE_SQL["run_summary"] = f"""
    SELECT count(*) AS total, count(*) FILTER (success) AS passed, count(*) FILTER (NOT success) AS failed,
           round_even(count(*) FILTER (success)::DOUBLE / count(*) * 100, 1) AS success_rate
    FROM ({ORACLE_SQL["validate_suite"]}) v
"""
_HISTORY = """
    SELECT 'run_' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id, o_orderpriority AS suite_name,
           'customer_' || CAST(o_custkey AS VARCHAR) AS source_label, o_orderdate AS run_time,
           o_totalprice < 250000 AS r0, o_orderstatus = 'O' AS r1,
           regexp_matches(o_orderpriority, '^[1-4]') AS r2
    FROM orders
"""
_RATED = f"""
    SELECT *, CAST(r0 AS BIGINT) + CAST(r1 AS BIGINT) + CAST(r2 AS BIGINT) AS passed FROM ({_HISTORY}) h
"""
ORACLE_SQL["run_status"] = f"""
    SELECT source_label, total, passed, total - passed AS failed, success_rate,
           CASE WHEN success_rate = 100 THEN 'success' WHEN success_rate >= 80 THEN 'warn' ELSE 'danger' END AS band
    FROM (SELECT source_label, 3 * count(*) AS total, CAST(sum(passed) AS BIGINT) AS passed,
                 round_even(sum(passed)::DOUBLE / (3 * count(*)) * 100, 1) AS success_rate
          FROM ({_RATED}) r GROUP BY source_label) s
"""
ORACLE_SQL["run_report"] = f"""
    SELECT 'run_1' AS run_id, 'orders_quality' AS suite_name, 'local' AS source_type,
           'orders.parquet' AS source_label, 'custbucket,o_orderkey,price,prio,status' AS available_columns,
           'column ''Price'' not found; did you mean ''price''?' AS warnings,
           count(*) AS total, count(*) FILTER (success) AS passed, count(*) FILTER (NOT success) AS failed,
           round_even(count(*) FILTER (success)::DOUBLE / count(*) * 100, 1) AS success_rate,
           string_agg(status, ',' ORDER BY pos) AS statuses
    FROM ({ORACLE_SQL["validate_suite"]}) v
"""

_SUITE_RULES = f"""
    SELECT 'suite_' || CAST(p_partkey AS VARCHAR) AS suite, 0 AS pos, '{_BETWEEN}' AS expectation_type,
           CASE p_size % 4 WHEN 0 THEN 'o_totalprice' WHEN 1 THEN 'O_TotalPrice' ELSE 'price' END AS "column"
    FROM part WHERE p_partkey % 3 <> 0
    UNION ALL
    SELECT 'suite_' || CAST(p_partkey AS VARCHAR), 1, '{_IN_SET}', p_brand FROM part WHERE p_partkey % 3 = 2
"""
ORACLE_SQL["suite_rules"] = _SUITE_RULES
ORACLE_SQL["suite_sizes"] = """
    SELECT 'suite_' || CAST(p_partkey AS VARCHAR) AS suite, CAST(p_partkey % 3 AS INTEGER) AS rules FROM part
"""
ORACLE_SQL["suite_params"] = f"""
    SELECT suite, pos, 'column' AS key, "column" AS text, CAST(NULL AS DOUBLE) AS number,
           CAST(NULL AS VARCHAR) AS items
    FROM ({_SUITE_RULES}) r
    UNION ALL
    SELECT 'suite_' || CAST(p_partkey AS VARCHAR), 0, 'min_value',
           CASE p_size % 4 WHEN 0 THEN ' ' || CAST(p_size AS VARCHAR) || '.5 ' WHEN 1 THEN ''
                           WHEN 2 THEN 'low' ELSE '1e3' END,
           CASE p_size % 4 WHEN 0 THEN p_size + 0.5 WHEN 3 THEN 1000 END, NULL
    FROM part WHERE p_partkey % 3 <> 0
    UNION ALL
    SELECT 'suite_' || CAST(p_partkey AS VARCHAR), 1, 'value_set',
           CASE WHEN p_size % 4 = 3 THEN '["SMALL","LARGE"]' ELSE ' SMALL ,' || p_type END, NULL,
           CASE WHEN p_size % 4 = 3 THEN 'SMALL|LARGE' ELSE 'SMALL|' || p_type END
    FROM part WHERE p_partkey % 3 = 2
"""
ORACLE_SQL["suite_warnings"] = f"""
    SELECT suite, pos, "column",
           CASE WHEN "column" = 'O_TotalPrice' THEN 'o_totalprice' END AS suggestion,
           'column ''' || "column" || ''' not found'
           || CASE WHEN "column" = 'O_TotalPrice' THEN '; did you mean ''o_totalprice''?' ELSE '' END AS message
    FROM ({_SUITE_RULES}) r
    WHERE "column" <> 'o_totalprice'
"""
ORACLE_SQL["suite_edit"] = f"""
    WITH existing AS (SELECT DISTINCT 'suite_' || CAST(p_partkey AS VARCHAR) AS suite, p_size, p_partkey, p_name FROM part),
    all_suites AS (
        SELECT suite FROM existing
        UNION SELECT 'new_' || suite FROM existing WHERE p_size = 7 AND p_partkey % 2 = 1
    ),
    with_added AS (
        SELECT suite, pos, expectation_type, "column" FROM ({_SUITE_RULES}) r
        UNION ALL
        SELECT suite, CAST(p_partkey % 3 AS INTEGER), '{_EXISTS}', p_name FROM existing WHERE p_partkey % 2 = 0
    ),
    left_over AS (
        SELECT suite, pos - 1 AS pos, expectation_type, "column" FROM with_added
        WHERE pos > 0 AND suite NOT IN (SELECT suite FROM existing WHERE p_size = 9)
    )
    SELECT suite, pos, expectation_type, "column" FROM left_over
    UNION ALL
    SELECT suite, NULL, NULL, NULL FROM all_suites
    WHERE suite NOT IN (SELECT suite FROM existing WHERE p_size = 9)
      AND suite NOT IN (SELECT suite FROM left_over)
"""


# -- history ------------------------------------------------------------------


def _history_part(pos: int, kind: str) -> str:
    return f"""
        SELECT run_id, suite_name, source_label, round_even(passed::DOUBLE / 3 * 100, 1) AS success_rate,
               CAST({pos} AS INTEGER) AS pos, '{kind}' AS expectation_type, r{pos} AS success,
               CASE WHEN r{pos} THEN 'passed' ELSE 'failed' END AS status
        FROM ({_RATED}) h{pos}
    """


ORACLE_SQL["history_results"] = " UNION ALL ".join(
    _history_part(i, kind) for i, kind in enumerate((_BETWEEN, _IN_SET, _REGEX))
)
ORACLE_SQL["history_latest"] = f"""
    SELECT run_id, suite_name, source_label, CAST(3 AS BIGINT) AS total, passed, 3 - passed AS failed,
           round_even(passed::DOUBLE / 3 * 100, 1) AS success_rate
    FROM ({_RATED}) h ORDER BY run_time DESC, run_id DESC LIMIT 50
"""


# -- catalog ------------------------------------------------------------------

_ENTRIES = """
    SELECT p_partkey, p_size, 'part_' || CAST(p_partkey AS VARCHAR) AS name, p_name AS alias,
           '100% of type ' || p_type AS description,
           CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS owner,
           lower(p_type) || '|Size ' || CAST(p_size AS VARCHAR) AS tags, 'local' AS source_type,
           'part.parquet' AS source_ref,
           CAST(CASE WHEN p_partkey % 3 <> 0 THEN 2 ELSE -1 END AS INTEGER) AS n_fields,
           '2024-01-01 08:00:00.250' AS created_at, '2024-01-02 09:30:00.000' AS updated_at
    FROM part
"""
ORACLE_SQL["history_newest"] = ORACLE_SQL["history_latest"]
ORACLE_SQL["catalog_rows"] = f"SELECT * EXCLUDE (p_partkey, p_size) FROM ({_ENTRIES}) e"
ORACLE_SQL["catalog_search"] = f"""
    SELECT name, alias, owner, description FROM ({_ENTRIES}) e
    WHERE contains(lower(name), 'red') OR contains(lower(alias), 'red')
       OR contains(lower(coalesce(owner, '')), 'red') OR contains(lower(description), 'red')
"""
ORACLE_SQL["catalog_search_literal"] = f"""
    SELECT name, description FROM ({_ENTRIES}) e WHERE contains(lower(description), '0% of type ec')
"""
ORACLE_SQL["catalog_tag_filter"] = f"""
    SELECT name, owner, tags FROM ({_ENTRIES}) e
    WHERE contains(lower(coalesce(owner, '')), 'brand#1') AND contains('size ' || CAST(p_size AS VARCHAR), 'size 1')
"""
# The index changes how entries are found, not which.
ORACLE_SQL["catalog_search_postings"] = ORACLE_SQL["catalog_search"]
ORACLE_SQL["catalog_tag_postings"] = ORACLE_SQL["catalog_tag_filter"]
ORACLE_SQL["catalog_normalize"] = f"""
    SELECT name, alias, description, coalesce(owner, '') AS owner, 'a b|' || tags AS tags,
           source_type, source_ref, CAST(greatest(n_fields, 0) AS INTEGER) AS n_fields, created_at, updated_at
    FROM ({_ENTRIES}) e WHERE p_partkey % 2 = 1
"""
ORACLE_SQL["catalog_create"] = """
    WITH first AS (
        SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn
        FROM part WHERE p_size <> 1
    )
    SELECT p_brand AS name, 'part ' || CAST(p_partkey AS VARCHAR) AS alias, '' AS description, p_name AS owner,
           p_type AS tags, 'local' AS source_type, '' AS source_ref, CAST(0 AS INTEGER) AS n_fields,
           strftime(make_timestamp(p_partkey * 1000000), '%Y-%m-%d %H:%M:%S') || '.000' AS created_at,
           strftime(make_timestamp(p_partkey * 1000000), '%Y-%m-%d %H:%M:%S') || '.000' AS updated_at
    FROM first WHERE rn = 1
"""
ORACLE_SQL["catalog_merge"] = f"""
    SELECT name, CASE WHEN hit THEN 'late' ELSE alias END AS alias, description,
           CASE WHEN hit AND p_size % 3 = 0 THEN 'Ops' ELSE owner END AS owner,
           CASE WHEN hit THEN 'x' ELSE tags END AS tags, source_type, source_ref,
           CASE WHEN n_fields < 0 THEN NULL ELSE n_fields END AS n_fields, created_at,
           CASE WHEN hit THEN '2024-03-02 00:00:00.000' ELSE updated_at END AS updated_at
    FROM (SELECT *, p_partkey % 2 = 0 AS hit FROM ({_ENTRIES}) e) m
"""
ORACLE_SQL["catalog_delete"] = f"SELECT name, alias FROM ({_ENTRIES}) e WHERE p_size <= 10"


def _field(pos: int, field: str, kind: str, description: str, where: str) -> str:
    return (
        f"SELECT 'part_' || CAST(p_partkey AS VARCHAR) AS name, CAST({pos} AS INTEGER) AS pos, "
        f"{field} AS field, '{kind}' AS type, {description} AS description, TRUE AS nullable "
        f"FROM part WHERE {where}"
    )


_DESCRIBED = [
    _field(0, "'id'", "bigint", "'key'", "p_partkey % 3 <> 0"),
    _field(1, "p_brand", "string", "p_name", "p_partkey % 3 <> 0"),
]
_PART_SCHEMA = (
    ("p_partkey", "bigint"),
    ("p_name", "string"),
    ("p_brand", "string"),
    ("p_type", "string"),
    ("p_size", "int"),
    ("p_retailprice", "double"),
)
ORACLE_SQL["catalog_fields"] = " UNION ALL ".join(_DESCRIBED)
ORACLE_SQL["catalog_autofill"] = " UNION ALL ".join(
    [
        *_DESCRIBED,
        *[_field(i, f"'{n}'", t, "''", "p_partkey % 3 = 0") for i, (n, t) in enumerate(_PART_SCHEMA)],
    ]
)
