"""Queries over files, attachments, plug-ins and whole jobs."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from talkweave.operators import plugins as PL
from talkweave.operators import registry as RG
from talkweave.plans import composites as C
from talkweave.plans import mappings as M
from talkweave.plans import queries_retrieval as QR
from talkweave.plans import queries_sessions as QS
from talkweave.plans import queries_tables as QT
from talkweave.plans import queries_text as QX
from talkweave.plans.catalog import query, table
from talkweave.session import shared_dir
from talkweave.sources import attachments as A
from talkweave.sources import sheets as SH
from talkweave.sources import specs as SP


# --- specification files ----------------------------------------------------------------
def _spec_files(spark, d):
    """Every supplier as a YAML file, every second one as a JSON file as well; nation 7's YAML is broken."""
    key, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    s = table(spark, d, "supplier")
    yaml = F.when(n == 7, "{: bad").otherwise(
        F.concat(
            F.when(n != 5, F.concat(F.lit("agent_id: ag"), key, F.lit("\n"))).otherwise(""),
            F.lit("description: yaml "), F.col("s_name").substr(1, 8), F.lit("\nmax_steps: "), (n + 1).cast("string"),
            F.lit("\nallowed_tools:\n  - todo_list\n  - t"), n.cast("string"), F.lit("\n"),
        )
    )
    as_json = F.concat(F.lit('{"agent_id": "js'), key, F.lit('", "description": "json", "version": "2", "allowed_tools": null}'))
    files = s.select(F.concat(F.lit("/specs/f"), key, F.lit(".yaml")).alias("path"), yaml.alias("content"))
    more = s.filter(n % 2 == 0).select(F.concat(F.lit("/specs/f"), key, F.lit(".json")).alias("path"), as_json.alias("content"))
    return files.union(more)


@query(
    "spec_lookup",
    """SELECT 'f' || s_suppkey AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'js' || s_suppkey WHEN s_nationkey IN (5, 7) THEN 'f' || s_suppkey
    ELSE 'ag' || s_suppkey END AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'json' WHEN s_nationkey <> 7 THEN 'yaml Supplier' END AS description
    FROM supplier""",
)
def spec_lookup(spark, d):
    specs = SP.specs_of(_spec_files(spark, d), "agent")
    return specs.select("name", "id", F.get_json_object("spec", "$.description").alias("description"))


@query(
    "spec_listing",
    """SELECT CASE WHEN s_nationkey = 5 THEN 'f' || s_suppkey ELSE 'ag' || s_suppkey END AS agent_id, 'yaml Supplier' AS description, '1.0' AS version,
    'todo_list,t' || s_nationkey AS allowed_tools, '' AS model_profile FROM supplier WHERE s_nationkey <> 7""",
)
def spec_listing(spark, d):
    specs = SP.specs_of(_spec_files(spark, d), "agent", listing=True)
    typed = SP.normalize_specs(specs, "agent").drop("agent_id").withColumnRenamed("id", "agent_id")
    return RG.list_specs(typed, "agent").withColumn("allowed_tools", F.array_join("allowed_tools", ","))


@query(
    "spec_files",
    """SELECT 'f' || s_suppkey AS name, CASE WHEN s_nationkey = 5 THEN 'f' || s_suppkey ELSE 'ag' || s_suppkey END AS id FROM supplier
    WHERE s_nationkey <> 7""",
)
def spec_files(spark, d):
    """The same files on storage: each supplier's document is written and the folder is read back."""
    rows = _spec_files(spark, d).filter(F.col("path").endswith(".yaml"))
    folder = shared_dir(spark, "specs")
    # A text sink partitioned by file name stands for one file per supplier.  All tasks write, and move their files themselves
    # (version 2), which the driver else does one by one after them.
    named = rows.select(F.regexp_extract("path", r"/([^/]+)\.yaml$", 1).alias("file"), F.col("content").alias("value"))
    dealt = named.repartition(4 * spark.sparkContext.defaultParallelism, "file")
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("file").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder)
    named = files.withColumn("path", F.concat(F.lit("/"), F.regexp_extract("path", r"file=([^/]+)/", 1), F.lit(".yaml")))
    return SP.specs_of(named, "agent", listing=True).select("name", "id")


@query(
    "normalized_agents",
    """SELECT 'f' || s_suppkey AS name, CASE WHEN s_nationkey % 2 = 0 THEN '2' ELSE '1.0' END AS version, 'text' AS response_mode,
    CASE WHEN s_nationkey % 2 = 0 THEN 8 ELSE CAST(s_nationkey + 1 AS INTEGER) END AS max_steps, 6 AS max_tool_calls, 45 AS max_runtime_seconds,
    CASE WHEN s_nationkey % 2 = 0 THEN 0 ELSE 2 END AS n_tools FROM supplier WHERE s_nationkey <> 7""",
)
def normalized_agents(spark, d):
    specs = SP.specs_of(_spec_files(spark, d), "agent").filter(F.col("spec").isNotNull())
    typed = SP.normalize_specs(specs.withColumn("id", F.col("name")), "agent")
    return typed.select(
        F.col("id").alias("name"), "version", "response_mode", "max_steps", "max_tool_calls", "max_runtime_seconds",
        F.size("allowed_tools").alias("n_tools"),
    )


@query(
    "normalized_workflows",
    """SELECT o_orderkey AS id, '' AS start_at, 2 AS n_nodes, 'n1,' AS node_ids, o_orderstatus AS first_to, 'always' AS first_when,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'x' END AS config_a FROM orders""",
)
def normalized_workflows(spark, d):
    config = F.when(F.col("o_orderpriority") == "2-HIGH", '{"a":"x"}').otherwise("null")
    spec = F.concat(
        F.lit('{"workflow_id":"w","nodes":[{"node_id":"n1","config":'), config, F.lit(',"transitions":[{"to":"'), F.col("o_orderstatus"),
        F.lit('"}]},{"node_type":"tool"}]}'),
    )
    typed = SP.normalize_specs(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), spec.alias("spec")), "workflow")
    return typed.select(
        "id", "start_at", F.size("nodes").alias("n_nodes"), F.array_join(F.transform("nodes", lambda n: n["node_id"]), ",").alias("node_ids"),
        F.col("nodes")[0]["transitions"][0]["to"].alias("first_to"), F.col("nodes")[0]["transitions"][0]["when"].alias("first_when"),
        F.try_element_at(F.col("nodes")[0]["config"], F.lit("a")).alias("config_a"),
    )


@query(
    "normalized_profiles",
    """SELECT c_custkey AS id, '1.0' AS version, c_mktsegment AS first_value, 'enum' AS field_type, true AS required, false AS allow_null,
    c_nationkey % 2 = 0 AS second_null FROM customer""",
)
def normalized_profiles(spark, d):
    spec = F.concat(
        F.lit('{"profile_id":"p","dimensions":[{"name":"a","allowed_values":["'), F.col("c_mktsegment"),
        F.lit('"]},{"name":"b","field_type":"string","allow_null":'), (F.col("c_nationkey") % 2 == 0).cast("string"), F.lit("}]}"),
    )
    typed = SP.normalize_specs(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), spec.alias("spec")), "profile")
    first, second = F.col("dimensions")[0], F.col("dimensions")[1]
    return typed.select(
        "id", "version", first["allowed_values"][0].alias("first_value"), first["field_type"].alias("field_type"),
        first["required"].alias("required"), first["allow_null"].alias("allow_null"), second["allow_null"].alias("second_null"),
    )


@query(
    "normalized_settings",
    """SELECT c_custkey AS id, 'gemini-2.5-flash' AS model, 0.7 :: DOUBLE AS temperature, CAST(c_nationkey AS INTEGER) AS max_tokens,
    c_mktsegment AS collection FROM customer""",
)
def normalized_settings(spark, d):
    spec = F.concat(
        F.lit('{"workflow":"w","nodes":[{"name":"n","max_tokens":'), F.col("c_nationkey").cast("string"),
        F.lit('}],"vector_store":{"collection":"'), F.col("c_mktsegment"), F.lit('"}}'),
    )
    typed = SP.normalize_specs(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), spec.alias("spec")), "settings")
    node = F.col("nodes")[0]
    return typed.select(
        "id", node["model"].alias("model"), node["temperature"].alias("temperature"), node["max_tokens"].alias("max_tokens"),
        F.col("vector_store.collection").alias("collection"),
    )


@query(
    "normalized_models",
    """SELECT 'm' || p_partkey AS name, 'gemini' AS provider, p_brand AS model, 0.7 :: DOUBLE AS temperature, CAST(p_size AS INTEGER) AS max_tokens FROM part""",
)
def normalized_models(spark, d):
    spec = F.concat(
        F.lit('{"profiles":{"m'), F.col("p_partkey").cast("string"), F.lit('":{"model":"'), F.col("p_brand"), F.lit('","max_tokens":'),
        F.col("p_size").cast("string"), F.lit("}}}"),
    )
    typed = SP.normalize_specs(table(spark, d, "part").select(F.col("p_partkey").alias("id"), spec.alias("spec")), "model")
    return typed.select("name", "provider", "model", "temperature", "max_tokens")


@query(
    "normalized_app",
    """SELECT c_custkey AS id, 'gemini' AS provider, c_mktsegment AS model_name, 10 AS top_k, c_nationkey % 2 = 0 AS logging_enabled,
    'config/workflow_settings' AS workflows_dir FROM customer""",
)
def normalized_app(spark, d):
    spec = F.concat(
        F.lit('{"model":{"model_name":"'), F.col("c_mktsegment"), F.lit('"},"logging":{"enabled":'),
        (F.col("c_nationkey") % 2 == 0).cast("string"), F.lit("}}"),
    )
    typed = SP.normalize_specs(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), spec.alias("spec")), "app")
    return typed.select("id", "provider", "model_name", "top_k", "logging_enabled", "workflows_dir")


@query(
    "remote_tools",
    """SELECT 'tool_' || s_suppkey AS tool_name, CASE s_nationkey % 4 WHEN 0 THEN 'http://base/x/' || s_suppkey WHEN 1 THEN 'http://whole' ELSE
    '/x/' || s_suppkey END AS endpoint_url, 'POST' AS method, CASE WHEN s_nationkey % 2 = 0 THEN 12 ELSE 30 END AS timeout_seconds
    FROM supplier WHERE s_nationkey % 4 <> 3 AND s_suppkey % 6 <> 5""",
)
def remote_tools(spark, d):
    key, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    content = F.concat(
        F.lit("tool_name: tool_"), key, F.when(n % 4 != 3, F.concat(F.lit("\nendpoint_url: /x/"), key)).otherwise(""),
        F.when(n % 4 == 0, "\nbase_url_env: BASE").when(n % 4 == 1, "\nendpoint_url_env: WHOLE").when(n % 4 == 2, "\nbase_url_env: UNSET").otherwise(""),
        F.when(n % 2 == 0, "\ntimeout_seconds: 12").otherwise(""), F.lit("\n"),
    )
    path = F.concat(F.lit("/t/"), F.when(F.col("s_suppkey") % 6 == 5, "_").otherwise(""), key, F.lit(".yaml"))
    files = table(spark, d, "supplier").select(path.alias("path"), content.alias("content"))
    tools = SP.remote_tools_of(files, {"BASE": "http://base/"}, {"WHOLE": "http://whole"})
    return tools.select("tool_name", "endpoint_url", "method", "timeout_seconds")


# --- sheets -------------------------------------------------------------------------------
@query(
    "sheet_files",
    """SELECT CAST(c_custkey AS VARCHAR) AS "studentId", c_name AS "Name", CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE '' END AS "Board",
    '' AS "Medium" FROM customer""",
)
def sheet_files(spark, d):
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("studentId"), F.col("c_name").alias("Name"),
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("Board"),
    )
    path = shared_dir(spark, "sheet")
    rows.write.option("header", True).csv(path)
    return SH.read_sheet(spark, path, ["studentId", "Name", "Board"], ("Name", "Medium"))


# --- attachments ----------------------------------------------------------------------------
def _uploads(spark, d):
    """Documents as uploads: some as data URLs, some damaged, some without a name."""
    key = F.col("doc_id")
    encoded = F.base64(F.encode("text", "UTF-8"))
    body = (
        F.when(key % 7 == 0, F.concat(F.lit("data:text/plain;base64,"), encoded)).when(key % 11 == 0, "not-valid***")
        .when(key % 13 == 0, "").otherwise(encoded)
    )
    doc = F.struct(
        F.replace(body, F.lit("\r\n"), F.lit("")).alias("base64"),
        F.when(key % 3 == 0, F.concat(F.lit("Notes."), F.col("lang"), F.lit(".MD"))).alias("filename"),
        F.when(key % 3 == 1, F.lit(" .txt")).otherwise("").alias("extension"),
        F.when(key % 2 == 0, F.lit("Text/Plain; charset=utf-8")).alias("mimeType"),
    )
    return table(spark, d, "documents").select(
        key.alias("request_id"), F.concat(F.lit("m "), F.col("source")).alias("message"), F.array(doc).alias("documents")
    )


_FILES = """files AS (SELECT doc_id AS request_id, source, text, CASE WHEN doc_id % 3 = 0 THEN 'Notes.' || lang || '.MD' WHEN doc_id % 3 = 1
  THEN 'upload.txt' ELSE 'upload-1' END AS filename, CASE WHEN doc_id % 2 = 0 THEN 'text/plain' WHEN doc_id % 3 = 0 THEN 'text/markdown'
  WHEN doc_id % 3 = 1 THEN 'text/plain' ELSE 'application/octet-stream' END AS mime_type,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'base64 must be valid base64' WHEN doc_id % 13 = 0 THEN 'base64 is required' END AS reason
  FROM documents)"""


@query(
    "decoded_documents",
    f"WITH {_FILES} SELECT request_id, filename, octet_length(encode(text)) AS n_bytes, mime_type FROM files WHERE reason IS NULL",
)
def decoded_documents(spark, d):
    files, _ = A.decode_documents(_uploads(spark, d))
    return files.select(
        "request_id", "filename", F.length("bytes").cast("long").alias("n_bytes"), A.infer_mime(F.col("filename"), F.col("mime")).alias("mime_type")
    )


@query("decode_rejects", f"WITH {_FILES} SELECT request_id, filename, reason FROM files WHERE reason IS NOT NULL")
def decode_rejects(spark, d):
    return A.decode_documents(_uploads(spark, d))[1].select("request_id", "filename", "reason")


_KINDS = ["a.png", "b.WAV", "c.tar.gz", "d.docx", "e.xls", "f.ppt", "g.pptx", "h.XLSM", "noext", ".csv", "k.html"]
_KIND_SQL = """CASE p_partkey % 11 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 3 THEN 'document' WHEN 6 THEN 'presentation' WHEN 7 THEN 'spreadsheet'
  WHEN 10 THEN 'text' ELSE 'unsupported' END"""


@query(
    "attachment_kinds",
    f"""SELECT p_partkey, {_KIND_SQL} AS kind, CASE p_partkey % 11 WHEN 4 THEN 'Legacy .xls files are not supported yet; upload .xlsx or .csv'
    WHEN 5 THEN 'Legacy .ppt files are not supported yet; upload .pptx' WHEN 2 THEN 'Unsupported file type ''application/octet-stream'' — skipped'
    WHEN 8 THEN 'Unsupported file type ''application/octet-stream'' — skipped' WHEN 9 THEN 'Unsupported file type ''application/octet-stream'' — skipped' END
    AS note FROM part""",
)
def attachment_kinds(spark, d):
    name = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("p_partkey") % 11 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", A.infer_mime(name, F.lit("application/octet-stream")).alias("m"))
    kind = A.attachment_kind(F.col("m"))
    return rows.select("p_partkey", kind.alias("kind"), F.when(kind == "unsupported", A.unsupported_note(F.col("m"))).alias("note"))


def _sized_files(spark, d):
    """Order lines as files of an order, a byte per unit of quantity."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").cast("long").alias("position"),
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("filename"), F.lit("text/plain").alias("mime"),
        F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).cast("binary").alias("bytes"),
    )


_SIZED = """s AS (SELECT l_orderkey AS request_id, sum(l_quantity) AS total, min(CASE WHEN l_quantity > 48 THEN l_linenumber END) AS big
  FROM lineitem GROUP BY l_orderkey)"""


@query(
    "upload_sizes",
    f"""WITH {_SIZED} SELECT l_orderkey AS request_id, CAST(l_linenumber AS BIGINT) AS position FROM lineitem JOIN s ON request_id = l_orderkey
    WHERE big IS NULL AND total <= 150""",
)
def upload_sizes(spark, d):
    return A.check_upload_sizes(_sized_files(spark, d), 48, 150)[0].select("request_id", "position")


@query(
    "upload_size_rejects",
    f"""WITH {_SIZED} SELECT request_id, CASE WHEN big IS NOT NULL THEN 'File ''f' || big || ''' exceeds the 0 MB upload limit' ELSE
    'combined upload size exceeds the 0 MB upload limit' END AS reason FROM s WHERE big IS NOT NULL OR total > 150""",
)
def upload_size_rejects(spark, d):
    return A.check_upload_sizes(_sized_files(spark, d), 48, 150)[1]


@query("upload_totals", "SELECT l_orderkey AS request_id, CAST(sum(l_quantity) AS BIGINT) AS total_bytes FROM lineitem GROUP BY l_orderkey")
def upload_totals(spark, d):
    return A.total_upload_bytes(_sized_files(spark, d))


@query(
    "extracted_text",
    f"""WITH {_FILES}, t AS (SELECT *, '[File: ' || filename || ']' || chr(10) || trim(text, chr(10) || ' ') AS b FROM files WHERE reason IS NULL)
    SELECT request_id, CASE WHEN mime_type LIKE 'text/%' THEN 'text' ELSE 'unsupported' END AS kind,
    CASE WHEN mime_type LIKE 'text/%' THEN b END AS block, CASE WHEN mime_type LIKE 'text/%' THEN length(b) ELSE 0 END AS chars_extracted,
    CASE WHEN mime_type LIKE 'text/%' THEN 'Text decoded as UTF-8' ELSE 'Unsupported file type ''application/octet-stream'' — skipped' END AS note
    FROM t""",
)
def extracted_text(spark, d):
    files, _ = A.decode_documents(_uploads(spark, d))
    return A.extract_text(files).select("request_id", "kind", "block", "chars_extracted", "note")


_XML = "http://schemas.openxmlformats.org/"


def _office_file(kind: str, name: str, brand: str, size: int) -> bytes:
    """A minimal office file holding the three values."""
    if kind == "xlsx":
        ns = f'xmlns="{_XML}spreadsheetml/2006/main"'
        parts = {
            "xl/sharedStrings.xml": f"<sst {ns}><si><t>{name}</t></si><si><r><t>{brand[:3]}</t></r><r><t>{brand[3:]}</t></r></si></sst>",
            "xl/worksheets/sheet10.xml": f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>last</t></is></c></row></sheetData></worksheet>',
            "xl/worksheets/sheet2.xml": f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c/><c t="s"><v>1</v></c></row><row/>'
            f"<row><c><v>{size}</v></c></row></sheetData></worksheet>",
        }
    elif kind == "pptx":
        ns = f'xmlns:a="{_XML}drawingml/2006/main" xmlns:p="{_XML}presentationml/2006/main"'
        parts = {
            f"ppt/slides/slide{i}.xml": f"<p:sld {ns}><a:t>{text}</a:t><a:t> </a:t><a:t>{size}</a:t></p:sld>"
            for i, text in ((10, brand), (9, name))
        }
    else:
        ns = f'xmlns:w="{_XML}wordprocessingml/2006/main"'
        parts = {
            "word/document.xml": f"<w:document {ns}><w:body><w:p><w:r><w:t>{name}</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>{brand[:2]}</w:t>"
            f"</w:r><w:r><w:t>{brand[2:]}</w:t></w:r></w:p><w:p><w:r><w:t>{size}</w:t></w:r></w:p></w:body></w:document>"
        }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path, xml in parts.items():
            archive.writestr(path, xml)
    return out.getvalue()


@query(
    "office_files",
    """SELECT p_partkey AS request_id, CASE p_partkey % 4 WHEN 0 THEN 'spreadsheet' WHEN 1 THEN 'presentation' ELSE 'document' END AS kind,
    CASE p_partkey % 4 WHEN 0 THEN '[Spreadsheet: f.xlsx]' || chr(10) || 'Sheet 1:' || chr(10) || p_name || ' | ' || p_brand || chr(10) || p_size || chr(10) ||
      chr(10) || 'Sheet 2:' || chr(10) || 'last'
    WHEN 1 THEN '[Presentation: f.pptx]' || chr(10) || 'Slide 1:' || chr(10) || p_name || chr(10) || p_size || chr(10) || chr(10) || 'Slide 2:' || chr(10) ||
      p_brand || chr(10) || p_size
    WHEN 2 THEN '[Document: f.docx]' || chr(10) || p_name || chr(10) || p_brand || chr(10) || p_size
    ELSE '[Document: f.docx]' || chr(10) || '[DOCX extraction error: File is not a zip file]' END AS block FROM part""",
)
def office_files(spark, d):
    """Every part as an office file, built in the tasks and read back."""

    def build(batches):
        for b in batches:
            kinds = [("xlsx", "pptx", "docx", "docx")[k % 4] for k in b["p_partkey"]]
            data = [
                b"no zip file at all" if key % 4 == 3 else _office_file(kind, name, brand, size)
                for kind, key, name, brand, size in zip(kinds, b["p_partkey"], b["p_name"], b["p_brand"], b["p_size"])
            ]
            yield pd.DataFrame(
                {"request_id": b["p_partkey"], "position": 1, "filename": [f"f.{k}" for k in kinds], "mime": None, "bytes": data}
            )

    schema = "request_id long, position long, filename string, mime string, bytes binary"
    # A table may be one file; the work is in Python, so it is dealt to all tasks.
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    files = parts.mapInPandas(build, schema)
    return A.extract_text(files).select("request_id", "kind", "block")


@query(
    "attachment_ingest",
    f"""WITH {_FILES}, b AS (SELECT *, '[File: ' || filename || ']' || chr(10) || trim(text, chr(10) || ' ') AS block FROM files WHERE reason IS NULL)
    SELECT request_id, 'm ' || source || CASE WHEN mime_type LIKE 'text/%' THEN chr(10) || chr(10) || '--- Attached content ---' || chr(10) || block ||
    chr(10) || '--- End of attached content ---' ELSE '' END AS message FROM b""",
)
def attachment_ingest(spark, d):
    return C.attachment_ingest(_uploads(spark, d))["messages"]


@query(
    "image_records",
    """SELECT 'Description: ' || text || ' Caption: ' || source || ' Prompt: ' AS content, 'Class_10' AS level, lang AS subject, 'CBSE' AS board,
    'image' AS content_type, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS topic_name FROM documents""",
)
def image_records(spark, d):
    images = table(spark, d, "documents").select(
        F.col("text").alias("image_description"), F.col("source").alias("image_caption"), F.col("lang").alias("subject"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("topic_name"), F.col("lang").alias("topic"),
    )
    m = F.col("metadata")
    return A.image_records(images).select("content", *[m[k].alias(k) for k in ("level", "subject", "board", "content_type", "topic_name")])


# --- plug-ins --------------------------------------------------------------------------------
def _quiet(prompts):
    """A stand-in for a model: counts words, fails on very long prompts."""
    out = []
    for p in prompts:
        if len(p) > 1500:
            raise ValueError("prompt too long")
        out.append({"text": p.lower(), "input_tokens": len(p.split(" ")), "output_tokens": 1, "model": "m"})
    return out


@query(
    "map_model",
    """SELECT doc_id, CASE WHEN length(text) <= 1500 THEN lower(text) END AS answer, CASE WHEN length(text) <= 1500 THEN len(string_split(text, ' ')) END
    AS input_tokens, CASE WHEN length(text) > 1500 THEN 'prompt too long' END AS error FROM documents""",
)
def map_model(spark, d):
    rows = PL.map_model(table(spark, d, "documents"), _quiet, "text", "r")
    return rows.select("doc_id", F.col("r.text").alias("answer"), "r.input_tokens", "r.error")


@query("embed_batch", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS first, 3 AS n FROM documents")
def embed_batch(spark, d):
    rows = PL.embed_batch(table(spark, d, "documents"), lambda texts: [[float(len(t)), 1.0, 0.0] for t in texts], "text")
    return rows.select("doc_id", F.element_at("vector", 1).cast("double").alias("first"), F.size("vector").alias("n"))


@query(
    "apply_tool",
    f"""SELECT event_id, event_type <> 'view' AND NOT (event_type <> 'click' AND {M.K} = 13) AS ok, CASE WHEN event_type NOT IN ('view') AND
    NOT (event_type <> 'click' AND {M.K} = 13) THEN {M.K} * 2 END AS doubled, CASE WHEN event_type = 'view' THEN 'invalid_arguments'
    WHEN event_type <> 'click' AND {M.K} = 13 THEN 'tool_runtime_error' END AS code FROM events""",
)
def apply_tool(spark, d):
    def double(args):
        if args["k"] == 13 and not args.get("quiet"):
            raise RuntimeError("unlucky")
        return args["k"] * 2

    kind, number = F.col("event_type"), M.props_k().cast("string")
    arguments = (
        F.when(kind == "view", '{"q":1}').when(kind == "click", F.concat(F.lit('{"quiet":true,"k":'), number, F.lit("}"))).otherwise(F.col("props"))
    )
    schema = {"type": "object", "required": ["k"]}
    rows = PL.apply_tool(table(spark, d, "events").withColumn("a", arguments), double, schema, "a", "r")
    return rows.select(
        "event_id", "r.ok", F.get_json_object("r.data", "$.result").cast("long").alias("doubled"), F.col("r.error.code").alias("code")
    )


@query(
    "step_branches",
    "SELECT event_id, CASE event_type WHEN 'click' THEN value * 2 WHEN 'view' THEN -value END AS v FROM events WHERE event_type IN ('click', 'view')",
)
def step_branches(spark, d):
    return PL.run_branches(
        table(spark, d, "events"), F.col("event_type"),
        {
            "click": lambda df: df.select("event_id", (F.col("value") * 2).alias("v")),
            "view": lambda df: df.select("event_id", (-F.col("value")).alias("v")),
        },
    )


# --- whole jobs --------------------------------------------------------------------------------
@query(
    "lead_export",
    f"""WITH {M.LEADS}, {M.COMPANIES}, {QT._ADDED} SELECT trim(company_name) AS "Company Name",
    trim(CASE WHEN contact_name <> '' THEN contact_name ELSE founder_name END) AS "Contact Name", email AS "Email",
    CASE WHEN trim(status) = '' THEN 'New' ELSE trim(status) END AS "Status" FROM added""",
)
def lead_export(spark, d):
    leads = M.leads(table(spark, d, "part")).withColumn("subject", F.lit("")).withColumn("body", F.lit(""))
    out = C.lead_export(leads, QX._probes(leads), M.companies(table(spark, d, "part")))
    return out["rows"].select("Company Name", "Contact Name", "Email", "Status")


def _ticket_model(prompts):
    """A stand-in for a classifier: the answer depends on the length of the conversation."""
    out = []
    for p in prompts:
        n = len(p.split("Conversation:\n", 1)[1].split("\n\nAdditional context JSON:", 1)[0])
        answer = {
            "needs_ticket": n % 2 == 0, "ticket_queue": "no_ticket" if n % 3 == 0 else "sales", "ticket_title": f"T{n}",
            "confidence": 0.5, "error_code": None,
        }
        if n % 5 == 0:
            answer["ticket_queue"] = "garage"
        out.append({"text": "Here it is: " + json.dumps(answer) + " as asked."})
    return out


@query(
    "auto_ticketing",
    """WITH n AS (SELECT conv_id, turn, length(text) AS n FROM conversations), q AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'garage' WHEN n % 3 = 0
    THEN 'no_ticket' ELSE 'sales' END AS queue FROM n) SELECT conv_id, turn, n % 2 = 0 AS needs_ticket, queue AS ticket_queue, 'T' || n AS ticket_title,
    CASE WHEN n % 5 = 0 THEN 'enum:ticket_queue' ELSE '' END AS violations, CASE WHEN (n % 2 = 0) = (queue = 'no_ticket') THEN 'queue_disagrees'
    ELSE '' END AS broken_rules, CASE WHEN n % 2 = 0 THEN 'ticket' ELSE 'archive' END AS branch FROM q""",
)
def auto_ticketing(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("conversation_text"))
    out = C.auto_ticketing(rows, QX.PROFILE, _ticket_model, {"turn": "turn"})
    return out.select(
        "conv_id", "turn", "needs_ticket", "ticket_queue", "ticket_title", F.array_join("violations", ",").alias("violations"),
        F.array_join("broken_rules", ",").alias("broken_rules"), "branch",
    )


@query(
    "task_board",
    """WITH r AS (SELECT o_orderkey AS request_id, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS a, o_custkey FROM orders WHERE o_orderstatus = 'F'),
    u AS (SELECT s_nationkey AS tenant_id, s_name AS name, min(s_suppkey) AS id FROM supplier GROUP BY ALL)
    SELECT r.request_id, strftime(CASE WHEN request_id % 2 = 0 THEN CAST(DATE '2024-05-01' + 1 AS DATE) ELSE DATE '2024-05-31' END, '%Y-%m-%d') AS due_date,
    'medium' AS priority, 'u' || o_custkey AS requester, u.id AS assignee FROM r LEFT JOIN u ON u.tenant_id = r.o_custkey % 25 AND
    u.name = 'Supplier#' || lpad(CAST(r.o_custkey % 100 AS VARCHAR), 9, '0')""",
)
def task_board(spark, d):
    cust = F.col("o_custkey")
    requests = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"), (cust % 25).cast("int").alias("tenant_id"),
        F.concat(F.lit("u"), cust.cast("string")).alias("user_id"), F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderkey") % 2 == 0, "do it tomorrow").otherwise("by end of the month").alias("due_text"),
        F.concat(F.lit("Supplier#"), F.lpad((cust % 100).cast("string"), 9, "0")).alias("assignee"), F.lit("").alias("priority"),
        (F.col("o_orderstatus") == "F").alias("confirmed"), F.lit("yes please").alias("user_message"),
    )
    users = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("tenant_id"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    out = C.task_board(requests, users, F.lit("2024-05-01"), "task_agent", max_dist=0)["requests"]
    return out.select(
        "request_id", "due_date", "priority", F.col("requesterId").alias("requester"), F.col("assigneeId").alias("assignee")
    )


@query(
    "chat_responses",
    """SELECT conv_id AS "sessionId", turn, CASE WHEN turn % 2 = 0 THEN role ELSE 'Student' END AS name, 'N/A' AS class, 'N/A' AS chapter,
    CASE WHEN turn % 3 = 0 THEN 'document' ELSE 'database' END AS message_type, false AS retrieval_used, 0 AS retrieval_count FROM conversations""",
)
def chat_responses(spark, d):
    null = F.lit(None).cast("string")
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("student_id"), F.lit("b").alias("business_id"), F.lit("English").alias("subject"),
        F.col("text"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("name"), null.alias("class"), F.lit("").alias("chapter"),
        (F.col("turn") % 3 == 0).alias("has_documents"), F.lit(None).cast("boolean").alias("retrieval_used"),
        F.lit(None).cast("int").alias("retrieval_count"), null.alias("image_url"), F.lit(False).alias("image_generated"), null.alias("trace_id"),
    )
    out = C.chat_response(rows)
    return out.select(
        "sessionId", F.col("studentId").alias("turn"), F.col("response.studentName").alias("name"), "response.class", "response.chapter",
        F.col("metadata.messageType").alias("message_type"), "metadata.retrieval_used", "metadata.retrieval_count",
    )


_TUTOR = "c.level = q.level AND (q.ctx_subject = '' OR c.subject = q.ctx_subject)"


@query(
    "tutor_requests",
    f"""WITH {M.CHUNKS}, {M.MESSAGES}, base AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, 'Example ' || turn || ' of ' || text AS query,
      CAST(embedding AS DOUBLE[]) AS vector, CASE WHEN c_custkey IS NULL THEN 'Class_10' WHEN c_nationkey % 3 = 0 THEN 'Class_10'
        ELSE 'Class_' || (c_nationkey % 12) END AS level, CASE WHEN c_custkey IS NULL THEN 'Student' ELSE c_name END AS name,
      CASE WHEN turn % 5 = 4 THEN '' ELSE 'fr' END AS ctx_subject
      FROM conversations JOIN embeddings ON vec_id = conv_id LEFT JOIN customer ON c_custkey = conv_id * 20 WHERE role = 'user'),
    asked AS (SELECT query_id, query, vector, level, ctx_subject, 'N/A' AS chapter FROM base),
    {QR._ranked('asked', _TUTOR, 3)}, {QR._RESCORED.replace('c.level, c.subject', 'c.level AS chunk_level, c.subject')}, {QR._CONTEXTS},
    memory AS (SELECT a.session_id * 1000 + a.seq AS query_id, CASE WHEN count(b.seq) = 0 THEN '' ELSE '--- Conversation Memory ---' || chr(10) ||
      string_agg(CASE WHEN b.role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || b.content, chr(10) ORDER BY b.seq) || chr(10) ||
      '--- End Memory ---' || chr(10) || chr(10) END AS memory FROM messages a LEFT JOIN messages b ON a.session_id = b.session_id AND b.seq < a.seq
      AND b.seq >= a.seq - 4 GROUP BY a.session_id, a.seq)
    SELECT query_id, name, level, memory || {QR.PROMPT} AS prompt FROM base JOIN memory USING (query_id) LEFT JOIN contexts USING (query_id)""",
)
def tutor_requests(spark, d):
    conversations = table(spark, d, "conversations")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("vector"))
    requests = conversations.filter(F.col("role") == "user").join(vectors, "conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), (F.col("conv_id") * 20).alias("student_id"),
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"),
        F.concat(F.lit("Example "), F.col("turn").cast("string"), F.lit(" of "), F.col("text")).alias("query"), "vector",
        F.lit("Hindi").alias("model_label"), (F.col("turn") % 5 == 4).alias("is_document"),
    )
    # Every text turn is labelled Hindi; the chunks' French stands for that subject.
    chunks = M.chunks(spark, d)
    meta = F.map_concat(
        F.map_filter("metadata", lambda k, _: k != "subject"),
        F.create_map(F.lit("subject"), F.when(F.col("metadata.subject") == "fr", "Hindi").otherwise(F.col("metadata.subject"))),
    )
    cfg = {"must": [{"field": "level", "value": "{{ level }}"}, {"field": "subject", "value": "{{ subject }}"}]}
    out = C.tutor_request(
        requests, QT.students(spark, d), "row", M.messages(conversations), chunks.withColumn("metadata", meta), cfg, 3, QS.TURNS,
        keywords={"Hindi": (" of ",)},
    )
    return out.select("query_id", "name", F.col("class").alias("level"), "prompt")


def _echo(prompts):
    return [{"text": json.dumps({"answer": len(p)})} for p in prompts]


@query(
    "chat_turns",
    f"""WITH {M.MESSAGES}, {QR._HITS.replace('rank <= 7', 'rank <= 5')}, {QR._RESCORED}, {QR._CONTEXTS},
    memory AS (SELECT a.session_id * 1000 + a.seq AS query_id, CASE WHEN count(b.seq) = 0 THEN '' ELSE '--- Conversation Memory ---' || chr(10) ||
      string_agg(CASE WHEN b.role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || b.content, chr(10) ORDER BY b.seq) || chr(10) ||
      '--- End Memory ---' || chr(10) || chr(10) END AS memory FROM messages a LEFT JOIN messages b ON a.session_id = b.session_id AND b.seq < a.seq
      AND b.seq >= a.seq - 4 GROUP BY a.session_id, a.seq),
    p AS (SELECT query_id, session_id, seq, query, memory || {QR.PROMPT} AS prompt FROM asked JOIN memory USING (query_id) LEFT JOIN contexts USING (query_id))
    SELECT session_id, seq, part, CASE WHEN part = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN part = 0 THEN query ELSE
    '{{"answer":' || length(prompt) || '}}' END AS content FROM p, (VALUES (0), (1)) v(part)""",
)
def chat_turns(spark, d):
    messages = M.messages(table(spark, d, "conversations"))
    return C.chat_turns(messages, M.asked(spark, d), M.chunks(spark, d), _echo, 5, json_mode=True, turns=QS.TURNS)["appended"]


def _fenced(prompts):
    return [{"text": "```json\n" + json.dumps({"summary": p.split("Text:\n", 1)[1], "n": len(p)}) + "\n```"} for p in prompts]


@query(
    "research_reports",
    """SELECT doc_id, text AS summary, length(text) + 103 + length('{"summary": "string"}') AS n FROM documents""",
)
def research_reports(spark, d):
    out = C.research_report(table(spark, d, "documents"), _fenced, '{"summary": "string"}')
    return out.select(
        "doc_id", F.try_variant_get("state", "$.outputs.structured_report.summary", "string").alias("summary"),
        F.try_variant_get("state", "$.outputs.structured_report.n", "bigint").alias("n"),
    )


@query(
    "ops_report",
    f"""WITH {M.USAGE}, {M.CALLS}, {M.POLICY_AGENTS}, {M.POLICY_TOOLS},
    runs AS (SELECT user_id, bool_or(event_type = 'signup') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY user_id),
    audit AS (SELECT CASE WHEN last_tool > 0 AND CAST(tool_name[6:] AS INTEGER) > last_tool * 2 THEN 'not_allowed' WHEN t.name IS NULL THEN 'not_found'
      WHEN error_code = 'tool_timeout' OR latency_ms > timeout_seconds * 1000 THEN 'timeout' ELSE 'ok' END AS verdict
      FROM calls c LEFT JOIN policy_agents a ON c.agent_id = a.agent_id LEFT JOIN policy_tools t ON c.tool_name = t.name)
    SELECT 'calls ' || workflow AS metric, count(*) AS n FROM usage GROUP BY workflow
    UNION ALL SELECT 'requests ' || upper(event_type), count(*) FROM events GROUP BY event_type
    UNION ALL SELECT 'runtime ' || event_type, count(*) FROM events GROUP BY event_type
    UNION ALL SELECT 'failed calls', CAST(sum(failed) AS BIGINT) FROM runs UNION ALL SELECT 'verdict ' || verdict, count(*) FROM audit GROUP BY verdict""",
)
def ops_report(spark, d):
    events = table(spark, d, "events")
    request = F.concat(
        M.event_time(), F.lit(" INFO api.request request request_id=r method="), F.upper("event_type"), F.lit(" path=/ status=200 duration_ms=1")
    )
    runtime = F.concat(
        M.event_time(), F.lit(" INFO agent.runtime x event="), F.col("event_type"),
        F.lit(" trace_id=t session_id=- agent_id=- workflow_id=- step=1 tool=- status=- payload={}"),
    )
    out = C.ops_report(
        events.select(request.alias("value")), events.select(runtime.alias("value")), M.usage(events),
        M.steps(events).withColumn("payload", F.try_parse_json("payload")), M.calls(events),
        M.policy_agents(table(spark, d, "region")), M.policy_tools(table(spark, d, "nation")),
    )

    def metric(df, label, column, n=F.count(F.lit(1))):
        return df.groupBy(F.concat(F.lit(label + " "), F.col(column)).alias("metric")).agg(n.alias("n"))

    failed = out["runs"].agg(F.lit("failed calls").alias("metric"), F.sum("failed_calls").alias("n"))
    return (
        metric(out["usage"], "calls", "workflow", F.sum("total_calls"))
        .unionByName(metric(out["requests"], "requests", "method"))
        .unionByName(metric(out["runtime"], "runtime", "event"))
        .unionByName(failed)
        .unionByName(metric(out["audit"], "verdict", "verdict"))
    )
