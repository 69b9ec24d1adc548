"""Row types of the engine. Every table that it makes has one of these schemas; none is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
STRINGS = T.ArrayType(S)

PARAMETER = _row(name=S, type=S, optional=B, default=S)
FUNCTION = _row(name=S, parameters=T.ArrayType(PARAMETER), return_type=S, is_async=B, is_exported=B, line_range=T.ArrayType(I), existing_doc=S, signature=S)
METHOD = T.StructType([*FUNCTION.fields, T.StructField("visibility", S), T.StructField("is_static", B)])
PROPERTY = _row(name=S, type=S, optional=B, visibility=S, existing_doc=S)
CLASS = _row(name=S, extends=S, implements=STRINGS, methods=T.ArrayType(METHOD), properties=T.ArrayType(PROPERTY), is_exported=B, line_range=T.ArrayType(I), existing_doc=S)
TYPE = _row(name=S, kind=S, properties=T.ArrayType(PROPERTY), line_range=T.ArrayType(I), existing_doc=S)
IMPORT = _row(source=S, names=STRINGS, is_default=B)

SOURCE_FILE = _row(path=S, content=S)
MODULE = _row(path=S, language=S, functions=T.ArrayType(FUNCTION), classes=T.ArrayType(CLASS), types=T.ArrayType(TYPE), imports=T.ArrayType(IMPORT), error=S)
FACETS = ("parameters", "return", "inheritance", "members", "modifiers")
SYMBOL = _row(kind=S, qualified_name=S, language=S, contract_facets=T.MapType(S, S), contract_fp=S, implementation_fp=S, documentation_fp=S)
SNAPSHOT = _row(path=S, language=S, dependency_fp=S, symbols=T.ArrayType(SYMBOL), error=S)
FILE_STATUS = _row(status=S, before_path=S, after_path=S)
FILE_CHANGE = _row(file_id=S, status=S, before_path=S, after_path=S, before_content=S, after_content=S)
CHANGE = _row(scope=S, id=S, before_id=S, after_id=S, category=S, risk=S, language=S, path=S, kind=S, qualified_name=S, changed_facets=STRINGS, digest=S)
SECTION = _row(file=S, ordinal=I, heading=S, slug=S, body=S, code_spans=STRINGS, link_targets=STRINGS)
REFERENCE = _row(file=S, section=S, slug=S, reason=S)
COMMIT = _row(hash=S, message=S, date=S, author=S)
FINDING = _row(kind=S, start=I, end=I, value=S, priority=I)
REDACTION = _row(text=S, action=S, findings=T.ArrayType(_row(kind=S, count=I)))
DIFF_SUMMARY = _row(changed=B, added_lines=I, removed_lines=I, old_bytes=L, new_bytes=L)
