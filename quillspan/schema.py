"""Table schemas of the document model, its nested JSON form, and strict reading of that form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCHEMA_VERSION = "1.1.0"

# Fixed values of the document model.
BLOCK_TYPES = ("title", "heading", "paragraph", "list", "quote", "footnote", "table", "image", "caption", "page_marker", "aside")
METHODS = ("native", "ocr_fast", "ocr_maximum", "office_import")
DIRECTIONS = ("ltr", "rtl")
CLASSIFICATIONS = ("native", "scanned", "mixed", "broken_digital")

BOX = "struct<x0:double,y0:double,x1:double,y1:double,coord_system:string>"
CELL = "struct<text:string,row_span:int,col_span:int,is_header:boolean>"
TABLE = f"struct<rows:array<array<{CELL}>>,has_header:boolean,caption:string>"
ASSET = "struct<asset_id:string,file_path:string,mime_type:string,width:int,height:int,alt_text:string>"
STYLES = "array<struct<start:int,end:int,bold:boolean,italic:boolean,underline:boolean>>"
BLOCK_FIELDS = (
    "id string, type string, text string, level int, language string, text_direction string, source_page int, "
    f"source_bounding_box {BOX}, extraction_method string, confidence double, warnings array<string>, image_asset {ASSET}, "
    f"table_structure {TABLE}, page_marker int, list_marker string, indent_level int, styles {STYLES}, role string"
)
PAGE_FIELDS = "page_number int, width double, height double, rotation int, classification string, details map<string,string>"
METADATA_FIELDS = "title string, source_file_name string, page_count int, created_at string"
_struct = lambda fields: "struct<" + ", ".join(f.strip().replace(" ", ":", 1) for f in _split(fields)) + ">"


def _split(fields: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


DOCUMENT = f"schema_version string, metadata {_struct(METADATA_FIELDS)}, pages array<{_struct(PAGE_FIELDS)}>, blocks array<{_struct(BLOCK_FIELDS)}>"

WORDS = "doc_id string, page_number int, word_id int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, italic boolean, underline boolean, blank boolean, visual_order boolean, confidence double"
REGIONS = "doc_id string, page_number int, region_id int, kind string, x0 double, y0 double, x1 double, y1 double, score double, ord double, label string, decorative boolean"
RULES = "doc_id string, page_number int, rule_id int, x0 double, y0 double, x1 double, y1 double, vertical boolean"


def names(fields: str) -> list[str]:
    return [f.split()[0] for f in _split(fields)]


def read_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Parse document JSON strictly: malformed text and wrong types fail, and so do unknown keys of a document or block."""
    keys = lambda j, allowed: F.array_except(F.json_object_keys(j), F.array(*map(F.lit, allowed)))
    j = F.col(column)
    blocks = F.from_json(F.get_json_object(j, "$.blocks"), "array<string>")
    strange = F.concat(keys(j, names(DOCUMENT)), F.coalesce(F.flatten(F.transform(blocks, lambda b: keys(b, names(BLOCK_FIELDS)))), F.array().cast("array<string>")))
    checked = F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(strange, ", "))).cast("string")).otherwise(j)
    return df.withColumn(column, checked).withColumn("doc", F.from_json(column, DOCUMENT, {"mode": "FAILFAST"}))


def to_json(blocks: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, value): the nested JSON of each document from its normalised tables, blocks in their order."""
    by = lambda c: lambda x, y: F.when(x[c] < y[c], -1).when(x[c] > y[c], 1).otherwise(0)
    b = blocks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*names(BLOCK_FIELDS)).alias("b"))), by("ord")), lambda x: x["b"]).alias("blocks"))
    p = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names(PAGE_FIELDS))), by("page_number")).alias("pages"))
    d = documents.join(p, "doc_id", "left").join(b, "doc_id", "left")
    empty = lambda c, fields: F.coalesce(F.col(c), F.array().cast(f"array<{_struct(fields)}>"))
    return d.select("doc_id", F.to_json(F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(*names(METADATA_FIELDS)).alias("metadata"),
        empty("pages", PAGE_FIELDS).alias("pages"), empty("blocks", BLOCK_FIELDS).alias("blocks"),
    )).alias("value"))


def explode_blocks(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc_id, ord, block fields) from parsed documents."""
    return docs.select("doc_id", F.posexplode(f"{doc}.blocks").alias("ord", "b")).select("doc_id", "ord", "b.*")


def explode_pages(docs: DataFrame, doc: str = "doc") -> DataFrame:
    return docs.select("doc_id", F.explode(f"{doc}.pages").alias("p")).select("doc_id", "p.*")


def explode_cells(blocks: DataFrame, table: str = "table_structure") -> DataFrame:
    """(doc_id, id, r, c, cell fields), rows ragged as they are."""
    rows = blocks.select("doc_id", "id", F.posexplode(f"{table}.rows").alias("r", "row"))
    return rows.select("doc_id", "id", "r", F.posexplode("row").alias("c", "cell")).select("doc_id", "id", "r", "c", "cell.*")


def violations(blocks: DataFrame) -> DataFrame:
    """Rows of blocks outside the model's ranges, with what is wrong."""
    bad = lambda cond, text: F.when(cond, F.lit(text))
    outside: list[Column] = [
        bad(~F.col("confidence").between(0, 1), "confidence"), bad(~F.col("indent_level").between(0, 6), "indent_level"),
        bad(F.exists("styles", lambda s: (s["start"] < 0) | (s["end"] < 0)), "styles"), bad(~F.col("type").isin(*BLOCK_TYPES), "type"),
        bad(~F.col("extraction_method").isin(*METHODS), "extraction_method"), bad(~F.col("text_direction").isin(*DIRECTIONS), "text_direction"),
    ]
    return blocks.withColumn("wrong", F.array_compact(F.array(*outside))).filter(F.size("wrong") > 0)
