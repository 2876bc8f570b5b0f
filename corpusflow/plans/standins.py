"""Tables of records, files, links, chats and chunks derived from the given tables.

Each is written once as SQL that Spark and DuckDB both read; where their dialects differ there are two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL: dict[str, str | tuple[str, str]] = {
    "cards": """
SELECT o_orderkey AS card_id,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Order' WHEN '2' THEN 'Contract' WHEN '3' THEN 'Memo' WHEN '4' THEN 'Incoming' ELSE 'Outgoing' END AS type_name,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Приказ' WHEN '2' THEN 'Договорной документ' WHEN '3' THEN 'Служебная записка' WHEN '4' THEN 'Входящее письмо' ELSE NULL END AS doc_type_title,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('N-', CAST(o_orderkey AS STRING)) END AS full_number,
  CASE WHEN o_orderkey % 26 = 0 THEN concat('P-', CAST(o_orderkey AS STRING)) END AS secondary_number,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS doc_date,
  CAST(o_orderdate AS DATE) AS creation_date,
  CASE WHEN o_orderkey % 11 = 0 THEN 'STATUS-CANCELLED' WHEN o_orderkey % 5 = 0 THEN 'status-other' END AS status_id,
  CAST((o_orderkey * 7) % 22 AS INT) AS state_id,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('Dept ', CAST(o_custkey % 20 AS STRING)) END AS department,
  CASE o_custkey % 6 WHEN 0 THEN 'Об утверждении Инструкции' WHEN 1 THEN 'Об актуализации перечня' WHEN 2 THEN 'АКТ на списание' WHEN 3 THEN 'О внесении изменений в ПВТР' WHEN 4 THEN 'Договор поставки' ELSE NULL END AS subject,
  o_orderkey AS pos,
  CASE WHEN o_custkey % 7 <> 0 THEN concat('caption ', substr(o_orderpriority, 1, 1)) END AS type_caption,
  CASE WHEN o_custkey % 5 = 0 THEN concat('state ', CAST(o_custkey % 3 AS STRING)) END AS approval_name,
  CASE WHEN o_custkey % 4 = 0 THEN CAST(o_custkey % 3 AS STRING) END AS approval_id,
  CASE WHEN o_custkey % 3 = 1 THEN concat('clerk ', CAST(o_custkey % 50 AS STRING)) END AS author, CASE WHEN o_custkey % 2 = 1 THEN concat('registrar ', CAST(o_custkey % 9 AS STRING)) END AS registrator
FROM {orders}""",
    "files": (  # Spark numbers a card's files before it makes their texts, which needn't be shuffled then
        """
SELECT l_orderkey AS card_id,
  concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS row_id,
  pos,
  CASE l_linenumber WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' WHEN 3 THEN 'docx' WHEN 4 THEN 'xlsx' WHEN 5 THEN 'jpg' WHEN 6 THEN 'sig' ELSE 'pdf' END AS extension,
  CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'Документ' WHEN 'AO' THEN 'Приложение' WHEN 'NF' THEN 'Подписанные документы' WHEN 'NO' THEN 'Дополнительные сведения' WHEN 'RF' THEN 'Подписи ЭП' ELSE NULL END AS category,
  concat(CASE WHEN l_suppkey % 9 = 0 THEN 'Для печати_' ELSE '' END, 'file_', CAST(l_partkey AS STRING)) AS name,
  md5(CAST(l_partkey AS STRING)) AS sha256,
  CAST(l_quantity * 1000 AS BIGINT) AS size,
  l_suppkey % 20 = 0 AS is_virtual,
  l_suppkey AS supp
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos FROM {lineitem})""",
        """
SELECT l_orderkey AS card_id,
  concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS row_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos,
  CASE l_linenumber WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' WHEN 3 THEN 'docx' WHEN 4 THEN 'xlsx' WHEN 5 THEN 'jpg' WHEN 6 THEN 'sig' ELSE 'pdf' END AS extension,
  CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'Документ' WHEN 'AO' THEN 'Приложение' WHEN 'NF' THEN 'Подписанные документы' WHEN 'NO' THEN 'Дополнительные сведения' WHEN 'RF' THEN 'Подписи ЭП' ELSE NULL END AS category,
  concat(CASE WHEN l_suppkey % 9 = 0 THEN 'Для печати_' ELSE '' END, 'file_', CAST(l_partkey AS STRING)) AS name,
  md5(CAST(l_partkey AS STRING)) AS sha256,
  CAST(l_quantity * 1000 AS BIGINT) AS size,
  l_suppkey % 20 = 0 AS is_virtual,
  l_suppkey AS supp
FROM {lineitem}""",
    ),
    "links": (  # as files
        """
SELECT l_orderkey AS from_id,
  CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE (l_orderkey * 31 + l_partkey) % (SELECT count(*) FROM {orders}) END AS to_id,
  'outgoing' AS direction,
  CASE l_returnflag WHEN 'A' THEN 'в отмену' WHEN 'R' THEN 'Дополнение' END AS ref_type,
  CASE l_returnflag WHEN 'A' THEN 'отменено' WHEN 'R' THEN 'дополнено' END AS reverse_type,
  pos
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos FROM {lineitem})""",
        """
SELECT l_orderkey AS from_id,
  CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE (l_orderkey * 31 + l_partkey) % (SELECT count(*) FROM {orders}) END AS to_id,
  'outgoing' AS direction,
  CASE l_returnflag WHEN 'A' THEN 'в отмену' WHEN 'R' THEN 'Дополнение' END AS ref_type,
  CASE l_returnflag WHEN 'A' THEN 'отменено' WHEN 'R' THEN 'дополнено' END AS reverse_type,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos
FROM {lineitem}""",
    ),
    "messages": """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, conv_id AS conversation_id,
  CASE WHEN turn > 0 THEN concat(CAST(conv_id AS STRING), '-', CAST(turn - 1 AS STRING)) END AS parent_id,
  concat(role, '_message') AS kind, text AS output_text,
  CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN concat('t', CAST(conv_id AS STRING), '.', CAST(turn AS STRING)) END AS trace_id,
  1704067200 + conv_id * 3600 + turn * 60 AS created_s, conv_id % 7 AS user_id, turn
FROM {conversations}""",
    "agent_events": """
SELECT user_id AS session_id, CAST(user_id * 1000 + CAST(floor(value) AS BIGINT) % 10 AS BIGINT) AS question_id, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'run_started' WHEN 'view' THEN 'tool_started' WHEN 'click' THEN 'tool_finished' WHEN 'purchase' THEN 'answer_delta' ELSE 'error' END AS kind
FROM {events}""",
    "lines": (
        "SELECT doc_id, lang, source, CAST(n AS BIGINT) AS n, line FROM {documents} LATERAL VIEW posexplode(split(coalesce(text, ''), '\\n')) AS n, line",
        "SELECT doc_id, lang, source, CAST(unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS BIGINT) AS n, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM {documents}",
    ),
    "chunks": """
SELECT concat(CAST(doc_id AS STRING), '-', CAST(n AS STRING)) AS chunk_id, concat(CAST(doc_id AS STRING), '-p', CAST(CAST(floor(n / 4) AS BIGINT) AS STRING)) AS parent_id,
  doc_id, source AS doc_kind, lang AS department, n, CASE doc_id % 3 WHEN 2 THEN 'cancelled' ELSE 'active' END AS doc_status,
  1704067200 + (doc_id % 400) * 86400 AS doc_date_ts, line AS body
FROM lines WHERE line <> ''""",
    "queries": "SELECT item_id AS query_id, text FROM {benchmark}",
    "registry": """
SELECT card_id, row_id, CASE WHEN pos % 5 = 0 THEN 'old' ELSE sha256 END AS sha256, CASE WHEN pos % 3 = 0 THEN 'old' ELSE md5(row_id) END AS fingerprint,
  CASE WHEN supp % 8 = 0 THEN 'error' ELSE 'indexed' END AS status
FROM files WHERE supp % 7 <> 0
UNION ALL SELECT -1 - card_id, concat('gone-', row_id), sha256, 'x', 'indexed' FROM files WHERE supp % 50 = 1""",
    "plan": """
SELECT card_id, row_id, CASE WHEN supp % 6 <> 0 THEN 'main' END AS role, sha256, md5(row_id) AS fingerprint,
  CASE WHEN extension IN ('jpg', 'pdf') THEN 'model' ELSE 'native' END AS route FROM files""",
    "pages_text": """
SELECT doc_id AS file_id, n AS page_no, CASE WHEN n % 5 = 4 THEN '' WHEN doc_id % 7 = 3 THEN concat('прихOд ', line) ELSE line END AS text FROM lines""",
    "manifest_files": """
SELECT card_id, row_id, concat(CAST(card_id AS STRING), '/', row_id) AS path, sha256, pos % 6 <> 5 AS downloaded FROM files""",
    "disk": """
SELECT concat(CAST(card_id AS STRING), '/', row_id) AS path, CASE WHEN supp % 13 = 0 THEN 'changed' ELSE sha256 END AS sha256, size FROM files WHERE supp % 11 <> 0
UNION ALL SELECT concat(CAST(CASE WHEN supp % 2 = 0 THEN card_id ELSE -5 END AS STRING), '/stray-', row_id), sha256, size FROM files WHERE supp % 40 = 3""",
    "known_cards": "SELECT card_id FROM cards WHERE card_id % 19 <> 0",
    "outcome_rows": """
SELECT concat('q', CAST(conv_id AS STRING)) AS id, CASE conv_id % 6 WHEN 0 THEN 'simple' WHEN 1 THEN 'multi_doc' WHEN 2 THEN 'duplicated' WHEN 3 THEN 'no_answer' WHEN 4 THEN 'contradiction' ELSE 'simple' END AS category,
  max(text) AS answer, conv_id % 10 AS a, conv_id % 7 AS b, conv_id % 6 = 2 AS expected_any, conv_id % 4 = 1 AS refused, conv_id % 9 = 4 AS has_unresolved,
  (conv_id % 50) / CAST(10 AS DOUBLE) AS first_signal_s, (conv_id % 90) / CAST(4 AS DOUBLE) AS seconds, CAST(conv_id % 6 AS INT) AS correctness, CAST(count(*) AS INT) AS statements,
  CAST(count(*) - conv_id % 2 AS INT) AS with_citation, CAST(conv_id % 5 + 1 AS INT) AS citations, CAST(conv_id % 5 AS INT) AS supported,
  conv_id % 8 = 3 AS judge_refusal, conv_id % 5 = 4 AS judge_conflict, conv_id % 9 <> 0 AS parsed, CASE WHEN conv_id % 19 = 0 THEN 'failed' END AS error
FROM {conversations} GROUP BY conv_id""",
}
NEEDS = {
    "chunks": ("lines",), "registry": ("files",), "plan": ("files",), "pages_text": ("lines",), "manifest_files": ("files",), "disk": ("files",), "known_cards": ("cards",),
}


def _text(name: str, dialect: int) -> str:
    sql = SQL[name]
    return sql if isinstance(sql, str) else sql[dialect]


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    sql = _text(name, 0)
    frames = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASE if f"{{{b}}}" in sql}
    for need in NEEDS.get(name, ()):
        sql = sql.replace(f"FROM {need}", f"FROM {{{need}}}")
        frames[need] = standin(spark, sf_dir, need)
    return spark.sql(sql, **frames)


def ctes(*names: str) -> str:
    """``WITH`` clause for DuckDB that defines the derived tables and those they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        sql = _text(name, 1)
        for b in BASE:
            sql = sql.replace(f"{{{b}}}", b)
        done.setdefault(name, sql)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s}\n)" for n, s in done.items())


def nested_cards(spark: SparkSession, sf_dir: str, beside: DataFrame | None = None) -> DataFrame:
    """Cards as documents hold them: sections of fields and rows, their files, and the columns of ``beside(card_id, ..)``."""
    c = standin(spark, sf_dir, "cards")
    more = [] if beside is None else [x for x in beside.columns if x != "card_id"]
    c = c if beside is None else c.join(beside, "card_id", "left")  # before their sections are made
    f = standin(spark, sf_dir, "files").groupBy("card_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "row_id", "name", "category", "size", "is_virtual"))), lambda x: F.struct(x["row_id"].alias("row_id"), x["name"].alias("name"), x["category"].alias("category"), x["size"].alias("size"), x["is_virtual"].alias("is_virtual"))).alias("files"))
    text = lambda c: F.col(c).cast("string")
    fields = {
        "DocTypeTitle": text("doc_type_title"), "FullNumber": text("full_number"), "SecondaryFullNumber": text("secondary_number"), "DocDate": text("doc_date"), "CreationDate": F.concat(text("creation_date"), F.lit("T09:30:00Z")),
        "StatusID": text("status_id"), "StateID": text("state_id"), "StateName": F.concat(F.lit("state "), text("state_id")), "DepartmentName": text("department"), "Subject": F.concat(F.lit("  "), text("subject"), F.lit(" ")),
        "AuthorName": text("author"), "RegistratorName": text("registrator"), "Comment": F.when(F.col("pos") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("comment "), text("pos"))),
    }
    shape = "struct<name:string,fields:map<string,string>,rows:array<map<string,string>>>"
    none, empty = F.array().cast("array<map<string,string>>"), F.create_map().cast("map<string,string>")
    row = lambda column, *values: F.array(*[F.create_map(F.lit(column), v) for v in values])
    section = lambda name, held, rows: F.struct(F.lit(name).alias("name"), held.alias("fields"), rows.alias("rows")).cast(shape)
    common = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields.values()))
    approval = F.map_from_arrays(F.array(F.lit("StateName"), F.lit("StateID")), F.array(text("approval_name"), text("approval_id")))
    people = lambda n: F.concat(F.lit(f"person {n}."), (F.col("pos") % n).cast("string"))
    sections = F.create_map(
        F.lit("Common"), section("Common", common, none), F.lit("Approval"), section("Approval", approval, none),
        F.lit("Directions"), section("Directions", empty, row("DirectionActivityName", F.lit("sales"), F.when(F.col("pos") % 2 == 0, F.lit("")))),
        F.lit("Approvers"), section("Approvers", empty, row("UserName", people(5), people(3))), F.lit("Service"), section("Service", empty, row("x", F.lit("y"))),
    )
    return c.join(f, "card_id", "left").select(
        F.col("card_id").cast("string").alias("id"), "type_name", "type_caption", F.lit(" archive ").alias("created_by_name"), (F.col("pos") % 4).cast("int").alias("version"), text("creation_date").alias("modified"), sections.alias("sections"), "files", *more,
    )
