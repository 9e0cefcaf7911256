"""File sources: the tables are exported as raw files and read back through the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabmeld.plans.consolidate import consolidate
from tabmeld.sources.catalog import check_root, list_files, select_datasets, supported_files
from tabmeld.sources.probe import probe_catalog
from workload import query, table
from workload.exports import new_root, write_csv, write_file, write_hidden, write_lines, write_workbooks


def _orders_by_status(spark, sf_dir, root):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    orders.write.partitionBy("o_orderstatus").option("header", True).csv(root)


@query(
    "source_file_catalog",
    """SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS dataset, 'csv' AS file_format, 'supported' AS status,
       true AS has_bytes FROM orders""",
)
def file_catalog(spark, sf_dir):
    """Folders and files of a root, with format and status, from the listing alone."""
    root = new_root(spark, "catalog")
    _orders_by_status(spark, sf_dir, root)
    files = list_files(spark, root)
    return files.select("dataset", "file_format", "status", (F.col("size") > 0).alias("has_bytes")).distinct()


@query(
    "source_unlisted_files",
    """SELECT 'o_orderstatus=' || o_orderstatus AS dataset, name, status, visible, has_bytes
       FROM (SELECT DISTINCT o_orderstatus FROM orders),
       (VALUES ('part', 'supported', true, true), ('_x.csv', 'supported', false, true), ('.y.csv', 'supported', false, false),
               ('empty.csv', 'supported', true, false), ('~$lock.xlsx', 'lock', true, true), ('merged', 'own_output', true, true))
       AS f(name, status, visible, has_bytes)""",
)
def unlisted_files(spark, sf_dir):
    """Hidden, empty and lock files and earlier results; one row for all files that the export wrote to a folder."""
    root = new_root(spark, "unlisted")
    _orders_by_status(spark, sf_dir, root)
    statuses = table(spark, sf_dir, "orders").select("o_orderstatus").distinct().collect()
    for (status,) in statuses:
        dataset = f"o_orderstatus={status}"
        content = {"_x.csv": "a,b\n1,2\n", ".y.csv": "", "empty.csv": "", "~$lock.xlsx": "x", f"{dataset}_merged.csv": "a,b\n1,2\n"}
        for name, text in content.items():
            write_file(spark, f"{root}/{dataset}/{name}", text)
    name = F.col("file_name")
    kind = F.when(name.startswith("part-"), "part").when(name.contains("_merged."), "merged").otherwise(name)
    return list_files(spark, root).select(
        "dataset", kind.alias("name"), "status", "visible", (F.col("size") > 0).alias("has_bytes")
    ).distinct()


@query(
    "source_dataset_selection",
    "SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS dataset FROM orders WHERE o_orderstatus = 'F'",
)
def dataset_selection(spark, sf_dir):
    root = new_root(spark, "selection")
    _orders_by_status(spark, sf_dir, root)
    wanted = [f"o_orderstatus={status}" for status in "FO"]
    files = select_datasets(list_files(spark, root), include=wanted, exclude=["o_orderstatus=O"])
    return supported_files(files).select("dataset").distinct()


@query(
    "source_root_check",
    "SELECT 'Directory does not exist' AS problem, count(*) > 0 AS orders_root_is_fine FROM orders",
)
def root_check(spark, sf_dir):
    root = new_root(spark, "root")
    missing = check_root(spark, root)
    _orders_by_status(spark, sf_dir, root)
    fine = check_root(spark, root) == []
    files = list_files(spark, root)
    return files.agg(
        F.lit(missing[0].split(":")[0]).alias("problem"), ((F.count("*") > 0) & F.lit(fine)).alias("orders_root_is_fine")
    )


@query("source_csv_scan", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf_dir):
    """Typed rows come back from plain CSV exports."""
    root = new_root(spark, "customer")
    customer = table(spark, sf_dir, "customer")
    write_csv(customer.where("c_acctbal < 0"), root, "customer")
    write_csv(customer.where("c_acctbal >= 0"), root, "customer")
    return consolidate(spark, root).outputs["customer"]


_MIXED_SQL = "SELECT conv_id, turn, role, text FROM conversations"


def _mixed_exports(spark, sf_dir) -> str:
    root = new_root(spark, "dialects")
    talks = table(spark, sf_dir, "conversations")
    sides = {"user": talks.where("role = 'user'"), "other": talks.where("role <> 'user'")}
    early, late = sides["other"].where("turn < 2"), sides["other"].where("turn >= 2")
    write_csv(sides["user"].where("turn < 2"), root, "talks", sep=";", charset="ISO-8859-1", quote_all=True)
    write_csv(sides["user"].where("turn >= 2"), root, "talks", sep="|", charset="UTF-16", quote_all=True)
    write_csv(early, root, "talks", sep="\t", quote_all=True)
    write_csv(late, root, "talks", quote_all=True)
    return root


@query("source_csv_dialects", _MIXED_SQL)
def csv_dialects(spark, sf_dir):
    """Four delimiters, three charsets, whole texts with line breaks inside quotes."""
    return consolidate(spark, _mixed_exports(spark, sf_dir)).outputs["talks"]


@query(
    "source_dialect_probe",
    """SELECT DISTINCT CASE WHEN role = 'user' THEN CASE WHEN turn < 2 THEN ';' ELSE '|' END
       ELSE CASE WHEN turn < 2 THEN chr(9) ELSE ',' END END AS sep,
       CASE WHEN role = 'user' THEN CASE WHEN turn < 2 THEN 'ISO-8859-1' ELSE 'UTF-16' END ELSE 'UTF-8' END AS charset,
       'conv_id,turn,role,text' AS header, 'ok' AS status FROM conversations""",
)
def dialect_probe(spark, sf_dir):
    root = _mixed_exports(spark, sf_dir)
    probes = probe_catalog(supported_files(list_files(spark, root)))
    return probes.select("sep", "charset", F.array_join("header", ",").alias("header"), "status").distinct()


def _ragged_exports(spark, sf_dir) -> str:
    root = new_root(spark, "ragged")
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    # A quote that does not open a field is a plain character, and hides no delimiter.
    line = (
        F.when(size < 3, F.concat(F.col("p_partkey"), F.lit(',5"'), "p_name", F.lit(',6"'), size, F.lit(",surplus")))
        .when(size < 5, F.concat_ws(",", "p_partkey", "p_name", size, F.lit("surplus")))
        .when(size < 10, F.concat_ws(",", "p_partkey", "p_name", size, F.lit("")))
        .when(size < 15, F.concat_ws(",", "p_partkey", "p_name"))
        .when(size < 20, F.concat(F.col("p_partkey"), F.lit(',"'), "p_name", F.lit(', ""big"""  ,  '), size))
        .when(size < 25, F.concat(F.col("p_partkey"), F.lit(',5"'), "p_name", F.lit(","), size))
        .otherwise(F.concat_ws(",", "p_partkey", "p_name", size))
    )
    for brand_test in ("p_brand < 'Brand#2'", "p_brand >= 'Brand#2'"):
        write_lines(part.where(brand_test), line, "p_partkey,p_name,p_size", root, "part")
    return root


@query(
    "source_short_and_long_records",
    """SELECT p_partkey, CASE WHEN p_size >= 15 AND p_size < 20 THEN p_name || ', "big"'
       WHEN p_size >= 20 AND p_size < 25 THEN '5"' || p_name ELSE p_name END AS p_name,
       CASE WHEN p_size >= 15 THEN p_size::BIGINT END AS p_size FROM part WHERE p_size >= 10""",
)
def short_and_long(spark, sf_dir):
    """Short records are padded, long ones are left out of the result."""
    return consolidate(spark, _ragged_exports(spark, sf_dir)).outputs["part"]


@query(
    "source_rejected_records",
    """SELECT 'part' AS dataset, p_partkey::VARCHAR AS first_cell, 4::BIGINT AS n_fields,
       CASE WHEN p_size < 3 THEN p_partkey || ',5"' || p_name || ',6"' || p_size || ',surplus'
       ELSE p_partkey || ',' || p_name || ',' || p_size || CASE WHEN p_size < 5 THEN ',surplus' ELSE ',' END END AS record
       FROM part WHERE p_size < 10""",
)
def rejected_records(spark, sf_dir):
    rejects = consolidate(spark, _ragged_exports(spark, sf_dir)).rejects
    return rejects.select(
        "dataset", F.col("cells")[0].alias("first_cell"), F.col("n_fields").cast("bigint").alias("n_fields"), "record"
    )


@query("source_single_column", "SELECT doc_id AS key FROM labels UNION ALL SELECT item_id FROM benchmark")
def single_column(spark, sf_dir):
    """Files with one column are accepted by the fallback reader only."""
    root = new_root(spark, "single")
    write_csv(table(spark, sf_dir, "labels").selectExpr("doc_id AS key"), root, "keys")
    write_csv(table(spark, sf_dir, "benchmark").selectExpr("item_id AS key"), root, "keys")
    return consolidate(spark, root).outputs["keys"]


_TOKENS = ("NA", "N/A", "null", "None", "nan", "", "#N/A", "-")


@query(
    "source_missing_tokens",
    f"""SELECT event_id, CASE WHEN value > 20 THEN NULL ELSE value END AS value,
        CASE WHEN user_id % 10 < 7 THEN NULL WHEN user_id % 10 = 7 THEN '-' ELSE event_type END AS event_type FROM events""",
)
def missing_tokens(spark, sf_dir):
    """Missing-value tokens become NULL in number and text columns alike."""
    root = new_root(spark, "tokens")
    tokens = F.array(*[F.lit(token) for token in _TOKENS])
    slot = (F.col("user_id") % 10).cast("int")
    df = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("value") > 20, F.element_at(tokens, (F.col("event_id") % 7 + 1).cast("int")))
        .otherwise(F.col("value").cast("string")).alias("value"),
        F.when(slot <= 7, F.element_at(tokens, slot + 1)).otherwise(F.col("event_type")).alias("event_type"),
    )
    write_csv(df.where("event_id % 2 = 0"), root, "events")
    write_csv(df.where("event_id % 2 = 1"), root, "events")
    return consolidate(spark, root).outputs["events"]


@query(
    "source_long_files",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       l_returnflag FROM lineitem""",
)
def long_files(spark, sf_dir):
    """Files longer than the probed head: verified whole, read in splits."""
    root = new_root(spark, "long")
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    write_csv(lineitem.where("l_returnflag <> 'R'"), root, "lineitem")
    write_csv(lineitem.where("l_returnflag = 'R'"), root, "lineitem")
    return consolidate(spark, root).outputs["lineitem"]


def _write_with_ends(rows, ends, root, dataset):
    """Files of descending ranges of ``k``; the end rows, whose keys are the lowest, end the last one."""
    lines = rows.union(ends).repartitionByRange(F.desc("k")).sortWithinPartitions(F.desc("k"))
    write_lines(lines, F.concat_ws(",", "k", "v"), "k,v", root, dataset)


@query(
    "source_dialect_any_size",
    """WITH rows AS (SELECT l_orderkey * 10 + l_linenumber AS k, repeat(l_returnflag, 60) AS v FROM lineitem),
       ends AS (SELECT -1 AS k, '"open' AS v UNION ALL SELECT -2, 'z')
       SELECT 'long' AS dataset, k, v FROM rows UNION ALL SELECT 'short', k, v FROM rows WHERE k % 1000 = 11
       UNION ALL SELECT dataset, k, v FROM ends, (VALUES ('long'), ('long'), ('short'), ('short')) AS d(dataset)""",
)
def dialect_any_size(spark, sf_dir):
    """A quote that stays open at the end makes apostrophes the quotes, in short and in long files."""
    root = new_root(spark, "any-size")
    lineitem = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.expr("repeat(l_returnflag, 60)").alias("v")
    )
    ends = spark.createDataFrame([(-1, '"open'), (-2, "z")], "k bigint, v string")
    half = F.col("k") % 20 < 10
    for dataset, rows in (("long", lineitem), ("short", lineitem.where("k % 1000 = 11"))):
        for part in (rows.where(half), rows.where(~half)):
            _write_with_ends(part, ends, root, dataset)
    outputs = consolidate(spark, root).outputs
    both = [outputs[name].select(F.lit(name).alias("dataset"), "k", "v") for name in ("long", "short")]
    return both[0].union(both[1])


@query(
    "source_quoted_line_breaks",
    "SELECT doc_id, text, lang, source, n_chars FROM documents",
)
def quoted_line_breaks(spark, sf_dir):
    """Whole documents, line breaks and quotes included, survive a CSV round trip."""
    root = new_root(spark, "documents")
    documents = table(spark, sf_dir, "documents")
    write_csv(documents.where("lang = 'en'"), root, "documents", quote_all=True)
    write_csv(documents.where("lang <> 'en'"), root, "documents", quote_all=True)
    return consolidate(spark, root).outputs["documents"]


@query(
    "source_read_status",
    """SELECT 'failed' AS status, 'no encoding and delimiter gave a table' AS error, NULL AS read_method FROM conversations
       WHERE regexp_matches(text, '[^\\x00-\\x7f]') HAVING count(*) > 0
       UNION ALL SELECT 'ok', NULL, 'csv' FROM region HAVING count(*) > 0""",
)
def read_status(spark, sf_dir):
    """One unreadable file is recorded and the others go on."""
    root = new_root(spark, "status")
    words = table(spark, sf_dir, "conversations").select(F.regexp_replace("text", "[,;|\t\n\r\"]", " ").alias("text"))
    write_lines(words, F.col("text"), "text", root, "mixed", charset="ISO-8859-1")
    write_csv(table(spark, sf_dir, "region"), root, "mixed")
    run = consolidate(spark, root)
    return run.files.select("status", "error", "read_method").distinct()


@query(
    "source_workbooks",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_totalprice > 100000 AS large,
       CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
def workbooks(spark, sf_dir):
    """Typed cells, date cells and gaps come back from .xlsx exports."""
    root = new_root(spark, "workbooks")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        (F.col("o_totalprice") > 100000).alias("large"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    for test in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        write_workbooks(orders.where(test), orders.columns, root, "orders")
    return consolidate(spark, root).outputs["orders"].withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "source_workbooks_and_csv",
    """SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""",
)
def workbooks_and_csv(spark, sf_dir):
    """Both formats in one dataset, the large-file reader for the workbooks."""
    root = new_root(spark, "formats")
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    write_workbooks(suppliers, suppliers.columns, root, "parties")
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS key", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    write_csv(customers, root, "parties")
    run = consolidate(spark, root, {"large_file_threshold_mb": 0.0001, "column_cleaning_options": {"handle_common_variations": False}})
    return run.outputs["parties"]


# Rows of a large workbook; the format allows 1 048 576 with the header.
LARGE_WORKBOOK_ROWS = 1_000_000


@query(
    "source_large_workbooks",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_extendedprice, l_returnflag || '-' || l_linestatus AS l_state,
       CASE WHEN l_linenumber < 3 THEN 'part ' || l_partkey END AS l_label, l_shipdate::TIMESTAMP AS l_shipdate FROM lineitem""",
)
def large_workbooks(spark, sf_dir):
    """A million rows a workbook, texts shared: sheets and shared strings are parsed in parts by many tasks."""
    root = new_root(spark, "large-workbooks")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.concat_ws("-", "l_returnflag", "l_linestatus").alias("l_state"),
        F.when(F.col("l_linenumber") < 3, F.concat(F.lit("part "), "l_partkey")).alias("l_label"), "l_shipdate",
    )
    n_books = max(2, -(-lines.count() // LARGE_WORKBOOK_ROWS))
    write_workbooks(lines.repartition(n_books), lines.columns, root, "lines", LARGE_WORKBOOK_ROWS, shared=True)
    return consolidate(spark, root).outputs["lines"].withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))


@query(
    "source_hidden_files",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'merged' AS status FROM orders",
)
def hidden_files(spark, sf_dir):
    """Files whose names start with an underscore or a dot are read like all others."""
    root = new_root(spark, "hidden")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    for status, lead in (("F", "_x"), ("O", ".y"), ("P", "z")):
        write_hidden(orders.where(F.col("o_orderstatus") == status), root, "orders", lead)
    run = consolidate(spark, root)
    (status,) = [state for _, state, *_ in run.status]
    return run.outputs["orders"].withColumn("status", F.lit(status))


@query(
    "source_rejected_raw_text",
    """SELECT file, n_fields, o_orderkey || CASE o_orderstatus WHEN 'F' THEN ' , "' || o_orderpriority || '" ,x'
       WHEN 'O' THEN ',"' || o_orderpriority || ' ""?"" ",  9 ' ELSE ',,' END AS record
       FROM orders, (VALUES ('UTF-8', 3::BIGINT), ('UTF-16', 3::BIGINT)) AS f(file, n_fields) WHERE o_orderkey % 3 = 0""",
)
def rejected_raw_text(spark, sf_dir):
    """Records with as many fields as the widest header of their dialect come back as they stand in the file."""
    root = new_root(spark, "raw")
    orders = table(spark, sf_dir, "orders")
    key, priority = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    odd = (
        F.when(F.col("o_orderstatus") == "F", F.concat(key, F.lit(' , "'), priority, F.lit('" ,x')))
        .when(F.col("o_orderstatus") == "O", F.concat(key, F.lit(',"'), priority, F.lit(' ""?"" ",  9 ')))
        .otherwise(F.concat(key, F.lit(",,")))
    )
    line = F.when(F.col("o_orderkey") % 3 == 0, odd).otherwise(F.concat_ws(",", key, priority))
    for charset in ("UTF-8", "UTF-16"):
        write_lines(orders, line, "key,priority", root, charset, charset)
        write_lines(orders.where("o_orderkey % 3 = 1"), F.concat_ws(",", key, priority, key), "key,priority,more", root, charset, charset)
    rejects = consolidate(spark, root).rejects
    return rejects.select(F.col("dataset").alias("file"), F.col("n_fields").cast("bigint").alias("n_fields"), "record")
