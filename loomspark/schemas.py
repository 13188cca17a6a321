"""Declared schemas.  Inputs are never inferred: an absent optional field stays a null column."""

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("text_nl", T.StringType()),
        T.StructField("fiscal_year", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("section_breadcrumb", T.StringType()),
        T.StructField("table_title", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("start_page", T.IntegerType()),
        T.StructField("parent_chunk_id", T.StringType()),
        T.StructField("related_chunk_ids", T.ArrayType(T.StringType())),
    ]
)

#: Types that get an embedding.
EMBED_TYPES = ("narrative", "table")

MANIFEST_COLUMNS = ["index", "chunk_id", "chunk_type", "fiscal_year", "source_file", "section_breadcrumb", "page", "embed_chars", "table_title"]

QUESTION = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("fiscal_year", T.StringType()),
        T.StructField("power_search", T.BooleanType()),
        T.StructField("image", T.StringType()),
    ]
)
