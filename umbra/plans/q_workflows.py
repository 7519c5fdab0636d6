"""Registered queries for sources/sinks (S1, S5-S9) and workflows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from umbra.functions.noise import laplace, laplace_sql
from umbra.operators.ledger import measured_ledger, privacy_report
from umbra.operators.mondrian import k_anonymize, k_profile
from umbra.operators.noisy import laplace_purpose, laplace_scale
from umbra.plans.policy import PRESETS, decisions, gate, policy, preset, presets_frame
from umbra.plans.q_mechanisms import _rr_sql
from umbra.plans.q_mondrian import K_SCHEMA, L_SCHEMA, PEOPLE_CTES, people_ids
from umbra.plans.sqltext import mondrian_ctes, mondrian_ncp_sql, with_, with_recursive
from umbra.operators.tree_counts import consistent_counts, count_purpose
from umbra.plans.workflows import anonymize_with_dp, run_pipeline
from umbra.schema import CENSUS_SCHEMA, CLEAN_REQUIRED_COLUMNS, SchemaError, require_columns
from umbra.session import ensure_checkpoint_dir
from umbra.sources.artefacts import read_events, version_id
from umbra.sources.census import census_lines, read_census_csv
from umbra.sources.fixtures import FIXTURE, people, people_sql, table

Q = {}
SQL = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def scratch(spark, what: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/umbra-{what}-{uuid.uuid4().hex}"


def _landing(spark, sf, files=None):
    """Raw census CSV text derived from ``customer`` (written to the shared scratch folder)."""
    path = scratch(spark, "landing")
    lines = census_lines(people(spark, sf))
    (lines.repartition(files) if files else lines).write.text(path)
    return path


_S01 = ("SELECT age, trim(workclass) AS workclass, CAST(person_id AS INTEGER) AS fnlwgt, 'HS-grad' AS education, "
        "\"education-num\", trim(\"marital-status\") AS \"marital-status\", trim(occupation) AS occupation, "
        "'Not-in-family' AS relationship, trim(race) AS race, trim(sex) AS sex, \"capital-gain\", 0 AS \"capital-loss\", "
        "40 AS \"hours-per-week\", trim(\"native-country\") AS \"native-country\", trim(income) AS income FROM people")


@register("s01_raw_csv_scan", with_([("people", people_sql())], _S01))
def s01(spark, sf):
    """Header-less 15-column CSV with ``", "`` separators; blanks trimmed, integers parsed."""
    return read_census_csv(spark, _landing(spark, sf))


@register("s02_csv_sentinel_nulls", with_([("people", people_sql()), ("s", _S01)],
                                          "SELECT * FROM s WHERE workclass <> '?' AND occupation <> '?' AND \"native-country\" <> '?'"))
def s02(spark, sf):
    """The inferring variant: ``?`` read as null, then any-null rows dropped."""
    return read_census_csv(spark, _landing(spark, sf), sentinel_as_null=True).dropna("any")


# files of a landing folder, by the remainder of the customer's key: which of them are data is decided by their names
_FILES = ("adult.data", "adult.test", "more.csv", "MORE.CSV", "notes.txt", "adult.data.bak", "table.csv.tmp")
_TAKEN = tuple(i for i, name in enumerate(_FILES) if name in ("adult.data", "adult.test") or name.lower().endswith(".csv"))


@register("s03_input_selection", "SELECT file, count(*) AS rows FROM (SELECT CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{_FILES[i]}'" for i in _TAKEN)
          + f" END AS file FROM customer WHERE c_custkey % 7 IN ({', '.join(map(str, _TAKEN))})) GROUP BY file")
def s03(spark, sf):
    """S3: of a folder with data files and others, the rows that are read, by file."""
    path = scratch(spark, "mixed")
    lines = people(spark, sf).withColumn("part", F.col("person_id") % len(_FILES))
    for i, name in enumerate(_FILES):
        census_lines(lines.where(F.col("part") == i)).coalesce(1).write.text(f"{path}/one-{i}")
        _rename_part(spark, f"{path}/one-{i}", f"{path}/in", name)
    got = read_census_csv(spark, f"{path}/in", select_files=True, with_file_name=True)
    return got.groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def _rename_part(spark, folder: str, target: str, name: str) -> None:
    """Moves the one part file of a folder to a place and name of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    part = next(x.getPath() for x in fs.listStatus(path(folder)) if x.getPath().getName().startswith("part-"))
    fs.rename(part, path(target, name))


_LACKING = ("income", "age", "native-country")


@register("c16_schema_guard", "SELECT 'whole' AS frame, true AS accepted, '' AS missing, (SELECT count(*) FROM customer) AS rows UNION ALL "
          + " UNION ALL ".join(f"SELECT 'without {c}', false, '{c}', (SELECT count(*) FROM customer)" for c in _LACKING)
          + " UNION ALL SELECT 'wider', true, '', (SELECT count(*) FROM customer)")
def c16(spark, sf):
    """The raw table as it is, without each of three columns, and with one more: what the guard says of each, and the rows it spares or passes."""
    raw = read_census_csv(spark, _landing(spark, sf))
    frames = {"whole": raw, **{f"without {c}": raw.drop(c) for c in _LACKING}, "wider": raw.withColumn("extra", F.lit(1))}
    said = []
    for name, frame in frames.items():
        try:
            require_columns(frame, CLEAN_REQUIRED_COLUMNS)
            said.append((name, True, ""))
        except SchemaError:
            said.append((name, False, ",".join(c for c in CLEAN_REQUIRED_COLUMNS if c not in frame.columns)))
    verdicts = spark.createDataFrame(said, "frame string, accepted boolean, missing string")
    return verdicts.crossJoin(F.broadcast(raw.agg(F.count(F.lit(1)).alias("rows"))))         # one row


# the anonymized artefacts hold the records without a null among the quasi-identifiers and the sensitive attribute
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in CENSUS_SCHEMA.columns)
_ROWS_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS artefact, (SELECT count(*) FROM pid_people WHERE {cond}) AS rows" for kind, cond in (
    ("anon_k", _COMPLETE), ("anon_l", _COMPLETE), ("clean", "true"), ("dp", "true")))


@register("f03_pipeline", with_(PEOPLE_CTES, _ROWS_SQL))
def f03(spark, sf):
    """F3 + S4-S8: clean -> k=10, l=2, eps=0.3 artefacts (versioned parquet) -> manifest with their rows."""
    res = run_pipeline(spark, _landing(spark, sf), scratch(spark, "artefacts"), version_id(), FIXTURE)
    return res.manifest.select("artefact", "rows")


@register("s08_completion_event", with_(PEOPLE_CTES + [("r", _ROWS_SQL)],
          "SELECT 'DATA_CLEANING_COMPLETED' AS event_type, 'people' AS source, 'v-event' AS version_id, artefact, rows FROM r"))
def s08(spark, sf):
    """The stored JSON event of a pipeline run, with the artefacts it lists."""
    out = scratch(spark, "artefacts")
    run_pipeline(spark, _landing(spark, sf), out, "v-event", FIXTURE, source_name="people.csv")
    listed = F.from_json(F.get_json_object("value", "$.artefacts"), "array<struct<path:string,artefact:string,rows:bigint>>")
    return read_events(spark, out).select(
        F.get_json_object("value", "$.event_type").alias("event_type"), "source", "version_id", F.explode(listed).alias("a")).select(
        "event_type", "source", "version_id", "a.artefact", "a.rows")


@register("s09_streaming_ingest", with_(PEOPLE_CTES + [("r", _ROWS_SQL)], "SELECT artefact, rows, CAST(2 AS BIGINT) AS files FROM r"))
def s09(spark, sf):
    """Files landing in a folder are ingested by a Structured Streaming query (availableNow), each under its own name."""
    from umbra.streaming.ingest import ingest
    landing, out, ck = _landing(spark, sf, files=2), scratch(spark, "stream-out"), scratch(spark, "stream-ck")
    ingest(spark, landing, out, ck, FIXTURE, max_files_per_trigger=1, select_files=False)
    kinds = {"clean": "*_clean", "anon_k": "*_anon_k10", "anon_l": "*_anon_l2", "dp": "*_dp_e0_30"}
    parts = [spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/{glob}").groupBy(F.lit(kind).alias("artefact")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col("_metadata.file_path").substr(F.lit(1), F.instr(F.col("_metadata.file_path"), "/version_id="))).alias("files"))
        for kind, glob in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_F01_EPS, _F01_SENS = 0.3, {"age": 100.0, "education_num": 16.0}


def _f01(spark, sf):
    return anonymize_with_dp(people_ids(spark, sf), list(_F01_SENS), "income", _F01_EPS, "person_id", FIXTURE, _F01_SENS)


def _f01_sql():
    def noisy(c, s):
        b = laplace_scale(s, 0.75 * _F01_EPS / 2)
        return f"round({c} + {laplace_sql(FIXTURE.uniform_sql(laplace_purpose('cell:' + c, b), 'person_id'), repr(b))}, 6) AS {c}"
    ctes = PEOPLE_CTES + [("f01n", "SELECT person_id, " + ", ".join(noisy(*x) for x in _F01_SENS.items()) + ", income FROM pid_people")]
    return _rr_sql("krr", col="income", eps=0.25 * _F01_EPS, src="f01n", ctes=ctes, select=["age", "education_num"], text=False)


@register("f01_anonymize_with_dp", _f01_sql())
def f01(spark, sf):
    """3/4 eps on numeric QIs (age, education_num), 1/4 eps k-ary randomized response on income."""
    return _f01(spark, sf)[0].select("person_id", "age", "education_num", "income")


@register("f02_privacy_report", with_(PEOPLE_CTES + [("led", " UNION ALL ".join(
    f"SELECT '{m}' AS mechanism, '{c}' AS target, CAST({e} AS DOUBLE) AS epsilon, (SELECT count({c}) FROM pid_people) AS released_values" for m, c, e in (
        ("laplace", "age", f"0.75 * {_F01_EPS} / 2"), ("laplace", "education_num", f"0.75 * {_F01_EPS} / 2"), ("randomized_response:krr", "income", f"0.25 * {_F01_EPS}"))))],
    "SELECT *, (SELECT sum(epsilon) FROM led) AS total_epsilon, (SELECT count(*) FROM led) AS mechanisms_registered FROM led"))
def f02(spark, sf):
    """epsilon of each mechanism of the F1 release, with the values that the release holds."""
    rel, entries = _f01(spark, sf)
    return privacy_report(measured_ledger(rel, entries, "f01"))


@register("f04_policy_gate", mondrian_ncp_sql(
    PEOPLE_CTES, K_SCHEMA, "pid_people", extra=f", ncp <= {policy()['max_loss_percent']} AS accepted", k=policy()["k"]))
def f04(spark, sf):
    """k from the combined policy (k=5) and its information-loss gate on NCP."""
    rules = policy()
    return gate(k_anonymize(people_ids(spark, sf), K_SCHEMA, k=rules["k"]).ncp(), rules)


def _f05_sql():
    vals = ", ".join(f"('{p}', CAST({preset(p)['epsilon_laplace']!r} AS DOUBLE))" for p in PRESETS)
    draw = laplace_sql(FIXTURE.uniform_sql("preset", "preset", "o_orderpriority"), "(1.0 / epsilon_laplace)")
    return with_([("g", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"),
                   ("p", f"SELECT * FROM (VALUES {vals}) t(preset, epsilon_laplace)")],
                  f"SELECT preset, o_orderpriority, epsilon_laplace, round(n + {draw}, 6) AS noisy_count FROM g, p")


@register("f05_presets", _f05_sql())
def f05(spark, sf):
    """noisy counts per priority under every preset, each at its share of the preset's total epsilon."""
    pre = presets_frame(spark)
    g = (table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
         .withColumn("preset", F.explode(F.array(*[F.lit(p) for p in PRESETS]))))
    j = g.join(F.broadcast(pre.select("preset", "epsilon_laplace")), "preset")
    draw = laplace(FIXTURE.uniform("preset", "preset", "o_orderpriority"), F.lit(1.0) / F.col("epsilon_laplace"))
    return j.select("preset", "o_orderpriority", "epsilon_laplace", F.round(F.col("n") + draw, 6).alias("noisy_count"))


_KS = [2, 3, 5, 8, 13, 21, 34, 50]


@register("f04_k_profile", " UNION ALL ".join(f"SELECT * FROM ({mondrian_ncp_sql(PEOPLE_CTES, K_SCHEMA, 'pid_people', k=k, extra=f', {k} AS k')})" for k in _KS))
def f04_profile(spark, sf):
    """loss, classes and least class of several k out of one run over all k from 2 to 50."""
    return k_profile(people_ids(spark, sf), K_SCHEMA, 2, 50).losses(_KS)


_ENFORCED = policy(k=5, l=1, max_loss_percent=8.0, quasi_identifiers=tuple(L_SCHEMA.qi), sensitive=("workclass",))
_ENFORCED_KS = range(5, 13)


@register("f04_enforced_policy", "WITH losses AS (" + " UNION ALL ".join(
    f"SELECT * FROM ({mondrian_ncp_sql(PEOPLE_CTES, L_SCHEMA, 'pid_people', k=k, extra=f', {k} AS k')})" for k in _ENFORCED_KS)
    + f") SELECT *, ncp <= {_ENFORCED['max_loss_percent']} AS accepted, coalesce(k = (SELECT max(k) FROM losses WHERE ncp <= {_ENFORCED['max_loss_percent']}), false) AS chosen FROM losses")
def f04_enforced(spark, sf):
    """the losses of k = 5 to 12, and the largest k that the policy's limit allows."""
    return decisions(people_ids(spark, sf), _ENFORCED, k_max=max(_ENFORCED_KS))[1]


_TREE_EPS, _TREE_LEVELS = 1.0, 40       # more levels than any run here has, for the recursion's sake


def _tree_counts_sql() -> str:
    """Every partition's noisy count after inference: one step up, then one step down, for each level."""
    def draw(levels):
        # the purpose names the number of levels, so the digest's head is put together in SQL
        head = "".join(f"{len(p)}:{p}" for p in (FIXTURE.secret, FIXTURE.release_id))
        purpose = count_purpose(_TREE_EPS, 10).removesuffix("10")
        text = f"'{head}' || length('{purpose}' || {levels}) || ':' || '{purpose}' || {levels} || length(node) || ':' || node"
        u = f"((CAST(('0x' || substr(sha256({text}), 1, 12)) AS BIGINT) + 0.5) / {float(2 ** 48)})"
        return laplace_sql(u, f"({levels} / {_TREE_EPS!r})")

    ctes = mondrian_ctes(K_SCHEMA, "pid_people", k=10, trace=True)
    ctes += [("steps", "SELECT pid, size, list_append(above, pid) AS path, unnest(list_append(above, pid)) AS node, unnest(range(len(above) + 1)) AS level FROM classes"),
             ("tree0", "SELECT node, max(level) AS level, max(CASE WHEN level > 0 THEN path[level] END) AS parent, bool_or(node = pid) AS leaf, sum(size) AS n FROM steps GROUP BY node"),
             ("top", "SELECT max(level) + 1 AS h FROM tree0"),
             ("tree", f"SELECT node, level, parent, leaf, n + {draw('h')} AS y FROM tree0, top")]
    up, down = [], []
    for level in range(_TREE_LEVELS - 1, -1, -1):
        below = f"(SELECT parent, sum(z) AS s, sum(v) AS sv FROM up{level + 1} GROUP BY parent)" if up else "(SELECT NULL::VARCHAR AS parent, NULL::DOUBLE AS s, NULL::DOUBLE AS sv)"
        up.append((f"up{level}", f"SELECT *, CASE WHEN leaf THEN y ELSE v * (y + s / sv) END AS z FROM (SELECT t.*, b.s, b.sv, CASE WHEN leaf THEN 1.0::DOUBLE ELSE sv / (sv + 1) END AS v "
                                   f"FROM tree t LEFT JOIN {below} b ON b.parent = t.node WHERE t.level = {level})"))
    for level in range(_TREE_LEVELS):
        src = "SELECT *, z AS x FROM up0" if not level else f"SELECT u.*, u.z + (d.x - d.s) / d.sv * u.v AS x FROM up{level} u JOIN down{level - 1} d ON d.node = u.parent"
        down.append((f"down{level}", src))
    ctes += [(name, sql) for name, sql in up + down]
    whole = " UNION ALL ".join(f"SELECT node, parent, level, leaf, round(x, 4) AS noisy_count FROM down{level}" for level in range(_TREE_LEVELS))
    return with_recursive(PEOPLE_CTES + ctes, whole)


@register("f01_tree_counts", _tree_counts_sql())
def f01_tree_counts(spark, sf):
    """noise after grouping: counts of all partitions of the k=10 run, consistent along its splits."""
    return consistent_counts(k_anonymize(people_ids(spark, sf), K_SCHEMA, k=10, trace=True), _TREE_EPS, FIXTURE, decimals=4)[0]
