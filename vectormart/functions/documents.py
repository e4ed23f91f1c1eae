"""Parsing nested documents, and reading values that may be a string or a list."""

from pyspark.sql import functions as F

from vectormart.fixed_values import DOCUMENT_PATHS, FLAT_COLUMNS, KEY_BLOCKS, TAGS_PATH
from vectormart.functions.text import blank_to_null, strip, strip_item


def json_path(doc, path, data_type="string"):
    """Value at a dotted path; NULL when a step is missing or is no object."""
    return F.try_variant_get(doc, "$." + path, data_type)


def _is_string(value):
    return F.schema_of_variant(value) == "STRING"


def strings_of(doc, path):
    """Stripped, non-blank strings of a list value in order; NULL for any other value."""
    items = F.try_variant_get(doc, "$." + path, "array<variant>")
    texts = F.transform(
        F.filter(items, lambda x: x.isNotNull() & _is_string(x)),
        lambda x: strip(F.try_variant_get(x, "$", "string")),
    )
    return F.filter(texts, lambda x: x != "")


def _is_list(doc, path):
    """True for a list; a look at the value's text settles most other values cheaply."""
    looks_so = F.startswith(json_path(doc, path), F.lit("["))
    return looks_so & F.try_variant_get(doc, "$." + path, "array<variant>").isNotNull()


def first_string(doc, path):
    """First non-blank string of a string-or-list value, stripped; NULL when there is none."""
    scalar = blank_to_null(strip(json_path(doc, path)))
    return F.when(_is_list(doc, path), F.try_element_at(strings_of(doc, path), F.lit(1))).otherwise(scalar)


def join_distinct(texts):
    """Distinct stripped non-blank strings in first-seen order, joined by ", "."""
    kept = F.filter(F.transform(texts, strip_item), lambda x: x.isNotNull() & (x != ""))
    return blank_to_null(F.array_join(F.array_distinct(kept), ", "))


def list_to_csv(doc, path):
    """Distinct strings of a list value joined by ", "; a scalar passes through."""
    return F.when(_is_list(doc, path), join_distinct(strings_of(doc, path))).otherwise(first_string(doc, path))


def first_usable(blocks):
    """The first whole block with a key, a scale or a strength; blocks are never mixed."""

    def usable(block):
        return (
            (F.coalesce(block["key"], F.lit("")) != "")
            | (F.coalesce(block["scale"], F.lit("")) != "")
            | block["strength"].isNotNull()
        )

    return F.coalesce(*[F.when(usable(block), block) for block in blocks])


def first_block(part):
    """The preferred key block of a document; ``part`` maps a path to a column."""
    return first_usable([part(path) for path in KEY_BLOCKS])


def _nested():
    """Schema of the read parts of a document as nested dictionaries with type names as leaves."""
    types = dict(FLAT_COLUMNS)
    leaves = {path: types[name] if types[name].startswith("array") else "string"
              for name, path in DOCUMENT_PATHS.items()}
    leaves[TAGS_PATH] = "variant"
    for block in KEY_BLOCKS:
        leaves.update({f"{block}.{part}": "string" for part in ("key", "scale", "strength")})
    tree = {}
    for path, kind in leaves.items():
        *parents, last = path.split(".")
        node = tree
        for parent in parents:
            node = node.setdefault(parent, {})
        node[last] = kind
    return tree


def document_type():
    """Struct type of a parsed document.

    Only parts that are used are named, so the parser skips the rest of a document
    without building it.  Plain values are read as text, whatever their JSON type, and
    tags stay VARIANT because each may be a string or a list.
    """
    def ddl(node):
        if isinstance(node, str):
            return node
        return "struct<" + ",".join(f"{name}:{ddl(child)}" for name, child in node.items()) + ">"

    return ddl(_nested())


def parse_documents(df, text="value", doc="doc"):
    """Add the document of a JSON text column as a struct; NULL for text that is no JSON.

    A part of an unexpected JSON type reads as NULL.  The parser reports such documents
    like broken ones, so only those are parsed a second time to tell them apart.  The
    parsed value is generated, not projected: later filters on it cannot repeat the parser.
    """
    mark = "_unread"
    kind = document_type()[:-1] + f",{mark}:string>"
    parsed = F.from_json(F.col(text), kind, {"columnNameOfCorruptRecord": mark})
    unread = F.col(f"{doc}.{mark}")
    broken = F.when(unread.isNotNull(), F.try_parse_json(unread).isNull()).otherwise(F.lit(False))
    return df.select("*", F.explode(F.array(parsed)).alias(doc)).withColumn(doc, F.when(~broken, F.col(doc).dropFields(mark)))
