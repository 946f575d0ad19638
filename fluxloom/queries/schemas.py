"""Queries over nested descriptions and drifting schemas (problems 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.functions.messages import plain
from fluxloom.operators import drift, shred
from fluxloom.operators.shred import LIST, MEMBERS, ONE, Element, Grammar
from fluxloom.queries.feeds import read

_FIELDS = {"properties": (MEMBERS, "field")}

#: Connector descriptions: what lies where, and which elements may hold others.
CONNECTOR = Grammar(
    "connector",
    {
        "connector": Element({"properties": (ONE, "about"), "configOptions": (ONE, "options"), "messages": (ONE, "catalog")}, anchor=True),
        "about": Element(),
        "options": Element({"capabilities": (LIST, "capability"), "connection": (ONE, "form"), "node": (ONE, "form")}, transparent=True),
        "form": Element(_FIELDS, (ONE, "form"), transparent=True),
        "capability": Element(),
        "field": Element(_FIELDS | {"enum": (LIST, "choice"), "x-reactions": (LIST, "reaction")}, (ONE, "form"), anchor=True),
        "choice": Element(_FIELDS, (ONE, "form")),
        "reaction": Element(_FIELDS, (ONE, "form")),
        "catalog": Element({}, (MEMBERS, "message"), transparent=True),
        "message": Element(),
    },
)


#: The entities that are asked for; what else the graph makes a table is none of them.
ENTITIES = ("connector", "capability", "field", "choice", "reaction", "message")

#: The flat tables: entity, and output column -> attribute of the singletons inlined into it.
FLAT = {
    "p4_connectors": ("connector", {"name": "properties.name", "connector_id": "properties.id"}), "p4_capabilities": ("capability", {"capability_id": "id"}),
    "p4_fields": ("field", {"field_type": "type", "title": "title", "component": "x-component", "position": "x-index"}), "p4_choices": ("choice", {"label": "label", "value": "value"}),
    "p4_reactions": ("reaction", {"target": "target"}), "p4_messages": ("message", {"text": "value"}),
}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every whole description, with the path of its parent."""
    rows = shred.shred(read(spark, sf_dir, "connector_spec").select("spec_id", "body"), "spec_id", "body", CONNECTOR)
    return rows.where(F.col("entity").isin(*ENTITIES))


def _flat(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A flat table: own path, parent, and the singletons inlined into it."""
    rows = shred.shred(read(spark, sf_dir, "connector_spec").select("spec_id", "body"), "spec_id", "body", CONNECTOR, attributes=True)
    return shred.flat_table(rows, "spec_id", *FLAT[name])


def _tracked(spark: SparkSession, sf_dir: str) -> tuple[drift.Versions, DataFrame]:
    rows = read(spark, sf_dir, "landed_row")
    return drift.track(read(spark, sf_dir, "landed_file").select("file_id", "source_id", "stream_name", "file_no", "field_list"), rows), rows


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each file against the one before it, for sources that track their schema."""
    v, _ = _tracked(spark, sf_dir)
    ignoring = read(spark, sf_dir, "source_srs").where(plain(F.col("schema_evolution")) == "ignore").select("source_id").distinct()
    return drift.changes(v).join(ignoring, "source_id", "left_anti").select("source_id", "stream_name", "file_no", "change_kind", "field_name", "prev_name")


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of every stream under the columns of the stream's one table, cell by cell."""
    v, rows = _tracked(spark, sf_dir)
    return drift.unified(v, rows).withColumnsRenamed({"column": "column_name", "type": "column_type"})


def p5_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the one table of every stream, and whether its source tracks its schema."""
    v, _ = _tracked(spark, sf_dir)
    cols = drift.table_columns(v).withColumnsRenamed({"column": "column_name", "type": "column_type"})
    ignoring = read(spark, sf_dir, "source_srs").where(plain(F.col("schema_evolution")) == "ignore").select("source_id", F.lit(False).alias("t")).distinct()
    return cols.join(ignoring, "source_id", "left").withColumn("tracked", F.col("t").isNull()).drop("t")


def queries() -> dict:
    flat = {n: lambda spark, sf, n=n: _flat(spark, sf, n) for n in FLAT}
    return {"p4_found": p4_found, **flat, "p5_found": p5_found, "p5_unified": p5_unified, "p5_columns": p5_columns}


def _unfolded(value: str) -> str:
    """SQL: a JSON value, or the object or list that its text stands for (text inside text up to three levels)."""
    out = value
    for i in range(3):  # a list of one binds what is met several times
        text = f"trim(j{i}->>'$', ' ' || chr(9) || chr(10) || chr(13) || chr(65279))"
        out = f"list_transform([{out}], lambda j{i}: CASE WHEN json_type(j{i}) = 'VARCHAR' AND json_valid({text}) AND json_type({text}) IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN {text}::JSON ELSE j{i} END)[1]"
    return f"list_transform([{out}], lambda k: CASE WHEN json_type(k) IN ('OBJECT', 'ARRAY') THEN k ELSE {value} END)[1]"


_TREE = f"""
WITH RECURSIVE tree AS (
  SELECT spec_id, 'connector' AS kind, '$' AS path, '' AS parent, '$' AS anchor, v FROM (SELECT spec_id, {_unfolded("to_json(body)")} AS v FROM connector_spec WHERE body IS NOT NULL) WHERE json_type(v) = 'OBJECT'
  UNION ALL
  SELECT spec_id, made, spot, CASE WHEN starts_with(made, ':') THEN '' ELSE anchor END, CASE WHEN made = 'field' THEN spot ELSE anchor END, v FROM (
    SELECT spec_id, anchor, v, CASE WHEN step[1:3] = ':L:' AND json_type(v) <> 'ARRAY' THEN step[4:] ELSE step END AS made, spot || CASE WHEN step[1:3] = ':L:' AND json_type(v) <> 'ARRAY' THEN '/0' ELSE '' END AS spot
    FROM (
      SELECT t.spec_id, t.anchor, t.path || '/' || e.key AS spot, {_unfolded("e.value")} AS v,
        CASE WHEN t.kind = 'connector' THEN CASE e.key WHEN 'configOptions' THEN ':options' WHEN 'messages' THEN ':catalog' WHEN 'properties' THEN ':about' END
             WHEN kind = ':options' THEN CASE WHEN json_type(t.v) <> 'OBJECT' THEN NULL WHEN e.key = 'capabilities' THEN ':L:capability' WHEN e.key IN ('connection', 'node') THEN ':form' END
             WHEN kind IN (':form', 'field', 'choice', 'reaction') THEN CASE WHEN json_type(t.v) <> 'OBJECT' THEN ':form' WHEN e.key = 'properties' THEN ':members'
               WHEN kind = 'field' AND e.key = 'enum' THEN ':L:choice' WHEN kind = 'field' AND e.key = 'x-reactions' THEN ':L:reaction' ELSE ':form' END
             WHEN kind = ':members' THEN CASE WHEN json_type(t.v) = 'OBJECT' THEN 'field' ELSE ':form' END
             WHEN kind = ':catalog' THEN ':locale' WHEN kind = ':locale' AND json_type(t.v) = 'OBJECT' THEN 'message' WHEN starts_with(kind, ':L:') THEN kind[4:] END AS step
      FROM tree t, json_each(t.v) e WHERE json_type(t.v) IN ('OBJECT', 'ARRAY') AND json_type(e.value) <> 'NULL')
    WHERE step IS NOT NULL)
)
"""


_DRIFT = r"""
WITH RECURSIVE first AS (
  SELECT source_id, stream_name, file_no, file_id, field_list, row_number() OVER (PARTITION BY source_id, stream_name ORDER BY file_no) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, stream_name, file_no ORDER BY field_list IS NULL, file_id) AS copy FROM landed_file) WHERE copy = 1
), rec AS (
  SELECT file_id, line_no, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM landed_row
), cell AS (
  SELECT file_id, line_no, e.key AS name, CASE WHEN json_type(e.value) = 'DOUBLE' AND NOT contains(lower(e.value::VARCHAR), 'e') THEN regexp_replace(e.value::VARCHAR, '\.?0+$', '') ELSE e.value->>'$' END AS value FROM rec, json_each(rec.p) e WHERE json_type(rec.p) = 'OBJECT'
), col AS (
  SELECT file_id, name, min(type) AS type FROM (
    SELECT file_id, f.name AS name, nullif(regexp_replace(lower(f.data_type), '\s+', '', 'g'), '') AS type FROM (SELECT file_id, unnest(field_list) AS f FROM first)
    UNION ALL SELECT DISTINCT file_id, name, NULL FROM cell JOIN first USING (file_id) WHERE field_list IS NULL) WHERE name IS NOT NULL GROUP BY 1, 2
), fld AS (SELECT source_id, stream_name, file_no, k, file_id, name, type FROM first JOIN col USING (file_id)
), pair AS (SELECT b.source_id, b.stream_name, b.file_no, b.k, a.file_id AS old_id, b.file_id AS new_id FROM first a JOIN first b ON b.source_id = a.source_id AND b.stream_name = a.stream_name AND b.k = a.k + 1
), gone AS (SELECT p.*, c.name FROM pair p JOIN col c ON c.file_id = old_id WHERE NOT EXISTS (SELECT 1 FROM col d WHERE d.file_id = new_id AND d.name = c.name)
), came AS (SELECT p.*, c.name FROM pair p JOIN col c ON c.file_id = new_id WHERE NOT EXISTS (SELECT 1 FROM col d WHERE d.file_id = old_id AND d.name = c.name)
), keyed AS (SELECT file_id, line_no, id FROM (SELECT file_id, line_no, value AS id, row_number() OVER (PARTITION BY file_id, value ORDER BY line_no DESC) AS nth FROM cell WHERE name = 'id' AND value IS NOT NULL) WHERE nth = 1
), met AS (
  SELECT g.new_id, g.name AS old, c.name AS new, x.value AS o, y.value AS v FROM gone g JOIN came c USING (new_id)
    JOIN keyed a ON a.file_id = g.old_id JOIN keyed b ON b.file_id = g.new_id AND b.id = a.id
    LEFT JOIN cell x ON x.file_id = a.file_id AND x.line_no = a.line_no AND x.name = g.name LEFT JOIN cell y ON y.file_id = b.file_id AND y.line_no = b.line_no AND y.name = c.name
), likely AS (SELECT new_id, old, new, count(*) FILTER (o = v) / count(*) AS share FROM met WHERE o IS NOT NULL OR v IS NOT NULL GROUP BY 1, 2, 3 HAVING share > 0.5
), ren AS (SELECT new_id, old, new FROM (SELECT *, row_number() OVER (PARTITION BY new_id, old ORDER BY share DESC) AS a, row_number() OVER (PARTITION BY new_id, new ORDER BY share DESC) AS b FROM likely) WHERE a = 1 AND b = 1
), line AS (
  SELECT source_id, stream_name, k, file_no, file_id, name, type, name AS root, file_no AS root_no FROM fld f
    WHERE k = 1 OR EXISTS (SELECT 1 FROM came c WHERE c.new_id = f.file_id AND c.name = f.name) AND NOT EXISTS (SELECT 1 FROM ren r WHERE r.new_id = f.file_id AND r.new = f.name)
  UNION ALL
  SELECT f.source_id, f.stream_name, f.k, f.file_no, f.file_id, f.name, f.type, l.root, l.root_no FROM line l JOIN fld f ON f.source_id = l.source_id AND f.stream_name = l.stream_name AND f.k = l.k + 1
    LEFT JOIN ren r ON r.new_id = f.file_id AND r.new = f.name WHERE f.name = l.name AND r.old IS NULL OR r.old = l.name
)
"""

_CHANGES = """, change AS (
  SELECT source_id, stream_name, file_no, 'renamed' AS change_kind, new AS field_name, old AS prev_name FROM ren JOIN pair USING (new_id)
  UNION ALL SELECT source_id, stream_name, file_no, 'removed', name, name FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.new_id = g.new_id AND r.old = g.name)
  UNION ALL SELECT source_id, stream_name, file_no, 'added', name, name FROM came c WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.new_id = c.new_id AND r.new = c.name)
  UNION ALL SELECT source_id, stream_name, file_no, 'retyped', name, name FROM (
    SELECT *, last_value(type IGNORE NULLS) OVER (PARTITION BY source_id, stream_name, root, root_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM line) WHERE type <> known
) SELECT * FROM change WHERE NOT EXISTS (SELECT 1 FROM source_srs s WHERE s.source_id = change.source_id AND lower(trim(schema_evolution)) = 'ignore')"""

_TABLES = """, ends AS (
  SELECT *, min(lo) OVER (PARTITION BY source_id, stream_name, last ORDER BY hi, lo, root ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM (
    SELECT source_id, stream_name, root, root_no, arg_max(name, file_no) AS last, min(file_no) AS lo, max(file_no) AS hi FROM line GROUP BY 1, 2, 3, 4)
), named AS (SELECT source_id, stream_name, root, root_no, CASE WHEN nxt <= hi THEN last || '@' || root_no ELSE last END AS column_name FROM ends
), typed AS (
  SELECT source_id, stream_name, column_name, list_distinct(list(CASE WHEN type IS NULL THEN NULL WHEN head IN ('bool', 'boolean') THEN 'boolean' WHEN head IN ('int', 'integer', 'tinyint', 'smallint', 'mediumint', 'short') THEN 'int'
    WHEN head IN ('bigint', 'long') THEN 'bigint' WHEN head IN ('decimal', 'numeric', 'number') THEN 'decimal(38,12)' WHEN head IN ('float', 'double', 'real') THEN 'double' WHEN head = 'date' THEN 'date'
    WHEN head IN ('datetime', 'timestamp') THEN 'timestamp' ELSE 'string' END)) AS t
  FROM (SELECT *, regexp_extract(type, '^[a-z]*') AS head FROM line JOIN named USING (source_id, stream_name, root, root_no)) GROUP BY 1, 2, 3
), tab AS (
  SELECT source_id, stream_name, column_name, CASE WHEN len(t) = 1 THEN t[1] WHEN len(t) = 0 THEN 'string' WHEN list_has_all(['int', 'bigint', 'decimal(38,12)'], t) THEN CASE WHEN list_contains(t, 'decimal(38,12)') THEN 'decimal(38,12)' ELSE 'bigint' END
    WHEN list_has_all(['int', 'double'], t) THEN 'double' WHEN list_has_all(['date', 'timestamp'], t) THEN 'timestamp' ELSE 'string' END AS column_type FROM typed
)"""


def oracle_sql() -> dict:
    drifted = {
        "p5_found": _DRIFT + _CHANGES,
        "p5_columns": _DRIFT + _TABLES + " SELECT source_id, stream_name, column_name, column_type, NOT EXISTS (SELECT 1 FROM source_srs s WHERE s.source_id = tab.source_id AND lower(trim(schema_evolution)) = 'ignore') AS tracked FROM tab",
        "p5_unified": _DRIFT + _TABLES + """ SELECT f.source_id, f.stream_name, f.file_no, r.line_no, t.column_name, t.column_type, c.value FROM first f JOIN rec r USING (file_id) JOIN tab t USING (source_id, stream_name)
          LEFT JOIN (line l JOIN named n USING (source_id, stream_name, root, root_no)) ON l.file_id = f.file_id AND n.column_name = t.column_name LEFT JOIN cell c ON c.file_id = f.file_id AND c.line_no = r.line_no AND c.name = l.name""",
    }
    row = "SELECT spec_id, path AS node_path, parent AS parent_path"
    scalar = "CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY') THEN v->>'$' END"
    tables = {
        "p4_connectors": "SELECT c.spec_id, c.path AS node_path, c.parent AS parent_path, a.v->>'name' AS name, a.v->>'id' AS connector_id FROM tree c LEFT JOIN tree a ON a.spec_id = c.spec_id AND a.kind = ':about' WHERE c.kind = 'connector'",
        "p4_capabilities": f"{row}, v->>'id' AS capability_id FROM tree WHERE kind = 'capability'",
        "p4_fields": f"{row}, v->>'type' AS field_type, v->>'title' AS title, v->>'x-component' AS component, v->>'x-index' AS position FROM tree WHERE kind = 'field'",
        "p4_choices": f"{row}, v->>'label' AS label, CASE WHEN json_type(v) = 'OBJECT' THEN v->>'value' ELSE {scalar} END AS value FROM tree WHERE kind = 'choice'",
        "p4_reactions": f"{row}, v->>'target' AS target FROM tree WHERE kind = 'reaction'",
        "p4_messages": f"{row}, {scalar} AS text FROM tree WHERE kind = 'message'",
    }
    found = "SELECT spec_id, kind AS entity, path AS node_path, parent AS parent_path FROM tree WHERE NOT starts_with(kind, ':')"
    return {**drifted, "p4_found": _TREE + found, **{n: _TREE + q for n, q in tables.items()}}
