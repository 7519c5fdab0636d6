"""DuckDB twins of the Spark expressions, generated from the same fixed values.

Used only to build the oracle SQL that checks the Spark plans.
"""

from __future__ import annotations

from umbra.functions.countries import FUZZY_MIN_SCORE, SPECIAL_CASES, country_rows
from umbra.functions.similarity import scored_sql
from umbra.operators.cleaning import CRITICAL_COLUMNS, INCOME_CODES
from umbra.sources.fixtures import people_sql


def q(name: str) -> str:
    return '"' + name + '"'


def lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{n} AS (\n{sql}\n)" for n, sql in ctes)
    return f"WITH {body}\n{final}"


PEOPLE_COLS = ["person_id", "age", "workclass", "education-num", "marital-status", "occupation", "race", "sex",
               "native-country", "capital-gain", "income"]
STRING_COLS = {"workclass", "marital-status", "occupation", "race", "sex", "native-country", "income"}
SENTINEL = {"workclass", "occupation", "native-country"}


def trimmed_sql(src: str = "people") -> str:
    parts = []
    for c in PEOPLE_COLS:
        e = q(c)
        if c in STRING_COLS:
            e = f"trim({e})"
        if c in SENTINEL:
            e = f"nullif({e}, '?')"
        parts.append(f"{e} AS {q(c)}")
    return "SELECT " + ", ".join(parts) + f" FROM {src}"


def income_code_sql(expr: str, strip_all: bool = False) -> str:
    pattern = r"\.+$" if strip_all else r"\.$"
    stripped = f"regexp_replace(trim({expr}), '{pattern}', '')"
    if strip_all:
        stripped = f"trim({stripped})"
    whens = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in INCOME_CODES.items())
    return f"CAST(CASE {stripped} {whens} ELSE NULL END AS INTEGER)"


def encoded_sql(src: str = "trimmed") -> str:
    cols = [f"{income_code_sql(q(c))} AS {q(c)}" if c == "income" else q(c) for c in PEOPLE_COLS]
    return "SELECT " + ", ".join(cols) + f" FROM {src}"


def critical_sql(src: str = "encoded") -> str:
    cond = " AND ".join(f"{q(c)} IS NOT NULL" for c in CRITICAL_COLUMNS if c in PEOPLE_COLS)
    return f"SELECT * FROM {src} WHERE {cond}"


def bin_sql(expr: str, width: int = 10) -> str:
    lo = f"CAST(floor({expr} / {width}) * {width} AS BIGINT)"
    return f"concat(CAST({lo} AS VARCHAR), '-', CAST({lo} + {width} AS VARCHAR))"


def normalize_sql(expr: str) -> str:
    e = f"replace(replace(trim({expr}), '-', ' '), '&', 'and')"
    e = f"regexp_replace({e}, '\\(.*\\)', '')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def dict_values_sql() -> str:
    rows = [f"({lit(n)}, {lit(c)}, {lit(common or '')}, {lit(a2)}, {lit(a3)}, {i})"
            for i, (n, a2, a3, c, common) in enumerate(country_rows())]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(name, cont, common, a2, a3, pos)"


def alias_values_sql() -> str:
    rows = [f"({lit(k)}, {lit(v)})" for k, v in SPECIAL_CASES.items()]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(frm, dst)"


def continent_ctes(src: str, col: str = "native-country") -> list[tuple[str, str]]:
    """CTEs ending in ``country_map(raw, continent_code)`` for the distinct values of ``src.col``."""
    return [
        ("cdict", dict_values_sql()),
        ("calias", alias_values_sql()),
        ("craw", f"SELECT DISTINCT {q(col)} AS raw FROM {src} WHERE {q(col)} IS NOT NULL"),
        ("cnorm", f"SELECT raw, {normalize_sql('raw')} AS norm FROM craw"),
        ("cname", "SELECT raw, coalesce(calias.dst, norm) AS name FROM cnorm LEFT JOIN calias ON calias.frm = cnorm.norm"),
        ("cexact", "SELECT n.raw, arg_min(d.cont, d.pos) AS cont FROM cname n JOIN cdict d ON lower(d.name) = lower(n.name) "
                   "OR lower(d.common) = lower(n.name) OR lower(d.a2) = lower(n.name) OR lower(d.a3) = lower(n.name) GROUP BY n.raw"),
        ("cscore", scored_sql("SELECT n.raw, d.cont, d.pos, lower(n.name) AS a, lower(d.name) AS b FROM cname n, cdict d")),
        ("cbest", "SELECT raw, arg_max(cont, score * 1000000 - pos) AS cont, max(score) AS score FROM cscore GROUP BY raw"),
        ("country_map", "SELECT n.raw, CASE WHEN trim(n.raw) = '' THEN 'Other' WHEN n.name = 'Other' THEN 'Other' "
                        "WHEN e.cont IS NOT NULL THEN e.cont "
                        f"WHEN b.score >= {float(FUZZY_MIN_SCORE)} THEN b.cont ELSE 'Other' END AS continent_code "
                        "FROM cname n LEFT JOIN cexact e ON e.raw = n.raw LEFT JOIN cbest b ON b.raw = n.raw"),
    ]


def clean_ctes() -> list[tuple[str, str]]:
    """people -> trimmed -> encoded -> critical -> clean (age_group, continent_code)."""
    return [
        ("people", people_sql()),
        ("trimmed", trimmed_sql()),
        ("encoded", encoded_sql()),
        ("critical", critical_sql()),
        *continent_ctes("critical"),
        ("clean", f"SELECT c.*, {bin_sql(q('age'))} AS age_group, coalesce(m.continent_code, 'Other') AS continent_code "
                  f"FROM critical c LEFT JOIN country_map m ON m.raw = c.{q('native-country')}"),
    ]


def mondrian_ctes(schema, src: str, k: int | None = None, l: int | None = None, guard: bool = True,
                  trees: dict[str, str] | None = None, trace: bool = False) -> list[tuple[str, str]]:
    """CTEs ending in ``classes(pid, size, bounds and labels)`` and ``tuples(pid, values, n)`` of a Mondrian run.

    ``trees``: for QIs that generalize along a tree, the table (value, path, widths) of its leaves.

    One step of the recursion splits every open partition once: windows over the tuples of a partition give
    its totals, medians and bounds, then each tuple moves on with its child's state.
    """
    qi, num, d = schema.qi, schema.is_numeric, len(schema.qi)
    sa = schema.sa
    vals = ", ".join(schema.columns)
    need = " AND ".join(f"{c} IS NOT NULL" for c in schema.columns)
    cast = [f"CAST({c} AS DOUBLE)" if num[i] else f"CAST({c} AS VARCHAR)" for i, c in enumerate(qi)]
    q = [f"q{i}" for i in range(d)]
    deep = {qi.index(name): paths for name, paths in (trees or {}).items()}
    state = [x for i in range(d) for x in ([f"lo{i}", f"hi{i}"] if num[i] else [f"lab{i}", f"dep{i}", f"wd{i}"] if i in deep else [f"lab{i}"])]
    members = (f"SELECT {', '.join(f'{c} AS q{i}' for i, c in enumerate(cast))}, {sa} AS sa, count(*) AS n FROM {src} WHERE {need} GROUP BY ALL")
    if deep:
        members = (f"SELECT m.*, {', '.join(f't{i}.path AS path{i}, t{i}.widths AS wid{i}' for i in deep)} FROM ({members}) m "
                   + " ".join(f"JOIN {paths} t{i} ON t{i}.value = q{i}" for i, paths in deep.items()))
        q += [x for i in deep for x in (f"path{i}", f"wid{i}")]
    start = ", ".join(f"min(q{i}) OVER () AS lo{i}, max(q{i}) OVER () AS hi{i}" if num[i]
                      else f"CAST(NULL AS VARCHAR) AS lab{i}" + (f", 0 AS dep{i}, 1.0::DOUBLE AS wd{i}" if i in deep else "") for i in range(d))
    kids = [f"path{i}[dep{i} + 1] AS kid{i}" if i in deep else f"q{i} AS kid{i}" for i in range(d) if not num[i]]
    threshold = k if k is not None else l
    # windows of a partition
    a = ["sum(n) OVER (PARTITION BY pid) AS tot"]
    for i in range(d):
        if num[i]:
            a += [f"sum(n) OVER (PARTITION BY pid ORDER BY q{i}) AS cum{i}", f"min(q{i}) OVER (PARTITION BY pid) AS vmin{i}", f"max(q{i}) OVER (PARTITION BY pid) AS vmax{i}"]
        else:
            a.append(f"sum(n) OVER (PARTITION BY pid, kid{i}) AS cnt{i}")
    b = [f"min(CASE WHEN cum{i} >= floor(tot / 2) THEN q{i} END) OVER (PARTITION BY pid) AS split{i}, "
         f"min(CASE WHEN cum{i} >= floor(tot / 2) THEN cum{i} END) OVER (PARTITION BY pid) AS left{i}" for i in range(d) if num[i]]
    c = [f"min(CASE WHEN q{i} > split{i} THEN q{i} END) OVER (PARTITION BY pid) AS nxt{i}, q{i} <= split{i} AS side{i}" for i in range(d) if num[i]]

    def diverse(key):
        return (f"sum(n) OVER (PARTITION BY pid, {key}) >= {l} AND count(DISTINCT sa) OVER (PARTITION BY pid, {key}) >= {l} "
                f"AND max(csa_{key}) OVER (PARTITION BY pid, {key}) * {l} <= sum(n) OVER (PARTITION BY pid, {key})")

    keys = [f"side{i}" if num[i] else f"kid{i}" for i in range(d)]
    e = [f"sum(n) OVER (PARTITION BY pid, {key}, sa) AS csa_{key}" for key in keys] if l is not None else ["1 AS one"]
    f = [f"({diverse(key)}) AS div{i}" for i, key in enumerate(keys)] if l is not None else ["1 AS two"]
    g = []
    for i in range(d):
        if num[i]:
            ok = f"floor(tot / 2) >= {threshold} AND vmin{i} < vmax{i} AND nxt{i} IS NOT NULL"
            ok += f" AND bool_and(div{i}) OVER (PARTITION BY pid)" if l is not None else f" AND tot - left{i} >= {k}" if guard else ""
            width = f"CASE WHEN range{i} > 0 THEN (hi{i} - lo{i}) / range{i} ELSE 0.0 END"
        else:
            ok = (f"kid{i}" + " IS NOT NULL AND " if i in deep else f"lab{i} IS NULL AND ") + (f"bool_and(div{i}) OVER (PARTITION BY pid)" if l is not None else f"min(cnt{i}) OVER (PARTITION BY pid) >= {k}")
            width = f"wd{i}" if i in deep else f"CASE WHEN lab{i} IS NULL THEN 1.0 ELSE 0.0 END"
        g.append(f"{width} AS w{i}, ({ok}) AS feas{i}")
    best = "greatest(" + ", ".join(f"CASE WHEN feas{i} THEN w{i} ELSE -1.0 END" for i in range(d)) + ")"
    pick = "CASE " + " ".join(f"WHEN feas{i} AND w{i} = best THEN {i}" for i in range(d)) + " END"
    wch = "CASE ch " + " ".join(f"WHEN {i} THEN w{i}" for i in range(d)) + " END"
    branch = "CASE ch " + " ".join(f"WHEN {i} THEN " + (f"CASE WHEN side{i} THEN 'L' ELSE 'R' END" if num[i] else f"kid{i}") for i in range(d)) + " END"
    new = []
    for i in range(d):
        if num[i]:
            tight = f"(ch IS NULL OR w{i} > wch OR (w{i} = wch AND {i} < ch))"
            new += [f"CASE WHEN ch = {i} THEN CASE WHEN side{i} THEN vmin{i} ELSE nxt{i} END WHEN {tight} THEN vmin{i} ELSE lo{i} END AS lo{i}",
                    f"CASE WHEN ch = {i} THEN CASE WHEN side{i} THEN split{i} ELSE vmax{i} END WHEN {tight} THEN vmax{i} ELSE hi{i} END AS hi{i}"]
        else:
            new.append(f"CASE WHEN ch = {i} THEN kid{i} ELSE lab{i} END AS lab{i}")
            if i in deep:
                new += [f"CASE WHEN ch = {i} THEN dep{i} + 1 ELSE dep{i} END AS dep{i}", f"CASE WHEN ch = {i} THEN wid{i}[dep{i} + 2] ELSE wd{i} END AS wd{i}"]
    ranges = "".join(f", range{i}" for i in range(d) if num[i])
    step = f"SELECT * FROM t WHERE NOT done"
    for extra in (kids, a, b, c, e, f, g):
        step = f"SELECT *, {', '.join(extra)} FROM ({step})" if extra else step
    step = f"SELECT *, {best} AS best FROM ({step})"
    step = f"SELECT *, {pick} AS ch FROM ({step})"
    step = f"SELECT *, {wch} AS wch, {branch} AS branch FROM ({step})"
    if trace:
        new.append("CASE WHEN ch IS NULL THEN above ELSE list_append(above, pid) END AS above")
        start += ", CAST([] AS VARCHAR[]) AS above"
        state.append("above")
    child = "substr(sha256(concat_ws(chr(31), pid, ch, branch)), 1, 32)" if trace else "pid || '/' || ch || ':' || branch"
    step = (f"SELECT CASE WHEN ch IS NULL THEN pid ELSE {child} END AS pid, ch IS NULL AS done, {', '.join(q)}, sa, n{ranges}, "
            f"{', '.join(new)} FROM ({step})")
    first = (f"SELECT 'r' AS pid, false AS done, {', '.join(q)}, sa, n"
             + "".join(f", max(q{i}) OVER () - min(q{i}) OVER () AS range{i}" for i in range(d) if num[i]) + f", {start} FROM members")
    bounds = ", ".join(f"min(q{i}) AS lo_{i}, max(q{i}) AS hi_{i}" if num[i] else f"any_value(lab{i}) AS lab_{i}" + (f", any_value(wd{i}) AS wd_{i}" if i in deep else "") for i in range(d))
    widths = ", ".join([f"any_value(range{i}) AS range_{i}" for i in range(d) if num[i]] + (["any_value(above) AS above"] if trace else []))
    return [("members", members), ("t", f"{first}\nUNION ALL\n{step}"), ("tuples", f"SELECT pid, {', '.join(q)}, sa, n, {', '.join(state)}{ranges} FROM t WHERE done"),
            ("classes", f"SELECT pid, sum(n) AS size, {bounds}{', ' + widths if widths else ''} FROM tuples GROUP BY pid")]


def mondrian_labels(schema) -> list[str]:
    """Label expression of each QI over ``classes``."""
    whole = "CAST(CAST({} AS BIGINT) AS VARCHAR)"
    out = []
    for i in range(len(schema.qi)):
        lo, hi = whole.format(f"lo_{i}"), whole.format(f"hi_{i}")
        out.append(f"CASE WHEN lo_{i} = hi_{i} THEN {lo} ELSE {lo} || ',' || {hi} END" if schema.is_numeric[i] else f"coalesce(lab_{i}, '*')")
    return out


def with_recursive(ctes: list[tuple[str, str]], final: str) -> str:
    return with_(ctes, final).replace("WITH ", "WITH RECURSIVE ", 1)


def mondrian_release_sql(ctes, schema, src: str, **kw) -> str:
    """The release in counted form: labels, sensitive value, n."""
    labels = ", ".join(f"{x} AS {c}" for x, c in zip(mondrian_labels(schema), schema.qi))
    return with_recursive(ctes + mondrian_ctes(schema, src, **kw), f"SELECT {labels}, sa AS {schema.sa}, sum(n) AS n FROM tuples JOIN classes USING (pid) GROUP BY ALL")


def mondrian_rows_sql(ctes, schema, src: str, **kw) -> str:
    """The release with a row for each record."""
    labels = ", ".join(f"{x} AS {c}" for x, c in zip(mondrian_labels(schema), schema.qi))
    return with_recursive(ctes + mondrian_ctes(schema, src, **kw),
                          f"SELECT {labels}, sa AS {schema.sa} FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS copy FROM tuples) JOIN classes USING (pid)")


def mondrian_ncp_sql(ctes, schema, src: str, extra: str = "", **kw) -> str:
    """Information loss of the release, one row."""
    w = " + ".join(f"(CASE WHEN range_{i} > 0 THEN (hi_{i} - lo_{i}) / range_{i} ELSE 0.0 END)" if schema.is_numeric[i]
                   else f"wd_{i}" if schema.qi[i] in (kw.get("trees") or {}) else f"(CASE WHEN lab_{i} IS NULL THEN 1.0 ELSE 0.0 END)" for i in range(len(schema.qi)))
    one = f"SELECT 100.0 * sum(size * ({w})) / ({float(len(schema.qi))} * sum(size)) AS ncp, count(*) AS n_classes, min(size) AS min_class_size, sum(size) AS n_records FROM classes"
    return with_recursive(ctes + mondrian_ctes(schema, src, **kw), f"SELECT *{extra} FROM ({one})")
