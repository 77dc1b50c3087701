"""Schemas of the catalogue's tables and results."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_KINDS = {"long": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "double": DoubleType(), "timestamp": TimestampType()}


def _struct(**fields: str) -> StructType:
    return StructType([StructField(k, _KINDS[v]) for k, v in fields.items()])


CONTENTS = _struct(id="long", checksum="string", page_count="int", ocr_pending="boolean")
DOCUMENTS = _struct(id="long", path="string", content_id="long", created_at="timestamp", modified_at="timestamp", modified_ns="long", deleted="boolean")
PAGES = _struct(id="long", content_id="long", page_index="int", markdown="string", search_text="string")
SCAN = _struct(path="string", mtime_ns="long", size="long", content_type="string", checksum="string", page_count="int", error="string")
FOUND = _struct(path="string", page_index="int", page_count="int", snippet="string", rank="double", search_source="string")
OCR_RESULT = _struct(content_id="long", path="string", status="string", error="string").add("pages", ArrayType(_struct(page_index="int", markdown="string")))
TABLES = {"contents": CONTENTS, "documents": DOCUMENTS, "pages": PAGES}
#: Version 1 had no search_text, version 2 no segments; state.Store brings both up to date.
VERSION = 3
