"""Declared key catalogues out of JSON documents of several shapes, read by shape as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import define_name
from lattica.functions.storage import materialize

#: What an entry of a key list may be.
LIST_ENTRY = r"^[A-Z][A-Z0-9_]*$"


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _entries(classes: Column, under: str, space: Column, group: str, one) -> Column:
    """Entries of all classes in their order; a class whose list is absent has none.

    The names of the document and of each class are made once, as an array of one, and not for each key.
    """
    keys = lambda c: F.coalesce(_get(c, f"$.{under}", "array<variant>"), F.array().cast("array<variant>"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    own = lambda s, c: F.flatten(F.transform(F.array(empty(_get(c, f"$.{group}"))), lambda g: F.transform(keys(c), lambda k: one(s, g, k))))
    return F.flatten(F.transform(F.array(empty(space)), lambda s: F.flatten(F.transform(classes, lambda c: own(s, c)))))


def read_manifests(texts: DataFrame, path: str, text: str) -> DataFrame:
    """(manifest, shape, names, entries): what each document is and declares.

    Shapes: ``key_list`` (a list of names in capitals, not empty), ``tables`` (a list of classes, of which one has an id and a list of
    keys), ``spaces`` (a namespace, and a list of classes of which one has a list of data), ``other`` and ``malformed`` (no JSON, or
    null). A document of one shape that declares nothing keeps its shape and has no entries. Entries without a name are left out.
    Tables give a key's type, default and enumeration; spaces vary those by build, so that theirs are named as unresolved.
    """
    doc = F.try_parse_json(text)
    read = texts.select(F.col(path).alias("manifest"), doc.alias("doc"))
    doc = F.col("doc")
    classes, names = _get(doc, "$.classes", "array<variant>"), _get(doc, "$", "array<string>")
    is_list = (F.size(names) > 0) & F.forall(names, lambda n: F.coalesce(n.rlike(LIST_ENTRY), F.lit(False)))
    is_tables = F.exists(classes, lambda c: _get(c, "$.id").isNotNull() & _get(c, "$.keys", "array<variant>").isNotNull())
    is_spaces = _get(doc, "$.namespace").isNotNull() & F.exists(classes, lambda c: _get(c, "$.data", "array<variant>").isNotNull())
    shape = F.when(doc.isNull(), "malformed").when(is_list, "key_list").when(is_tables, "tables").when(is_spaces, "spaces").otherwise("other")

    def entry(space: Column, group: Column, name: Column, kind: Column, default: Column, enum: Column, helpers: Column, open_fields: Column) -> Column:
        parts = {"define_name": define_name(space, group, name), "namespace": space, "class_name": group, "key_id": name, "value_type": kind, "default_value": default, "enum_name": enum, "helpers": helpers, "unresolved": open_fields}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    null = F.lit(None).cast("string")
    of_tables = _entries(classes, "keys", _get(doc, "$.meta.id"), "id", lambda s, g, k: entry(s, g, _get(k, "$.id"), _get(k, "$.type"), _get(k, "$.default"), _get(k, "$.enum"), _get(k, "$.helpers", "boolean"), null))

    def open_fields(k: Column) -> Column:
        found = F.concat_ws(",", F.when(_get(k, "$.type.default", "variant").isNotNull(), "default"), F.when(_get(k, "$.enum_set", "variant").isNotNull(), "enum_set"))
        return F.nullif(found, F.lit(""))

    of_spaces = _entries(classes, "data", _get(doc, "$.namespace"), "name", lambda s, g, k: entry(s, g, _get(k, "$.name"), _get(k, "$.type.mem"), null, null, _get(k, "$.generate_helpers", "boolean"), open_fields(k)))
    entries = F.when(F.col("shape") == "tables", of_tables).when(F.col("shape") == "spaces", of_spaces)
    named = F.filter(entries, lambda e: F.coalesce(e["key_id"] != "", F.lit(False)))
    return read.withColumn("shape", shape).select("manifest", "shape", F.when(F.col("shape") == "key_list", names).alias("names"), named.alias("entries"))


def select_manifests(read: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, manifests): the keys of manifests that key lists vouch for, and what became of each document.

    A manifest is kept whole if any list names any of its keys, whatever its shape, else it is ``unlisted`` and refused. Keys have
    ``listed`` and ``observed`` (their name is in ``observed``: define_name); of keys of one name in a manifest the first stays.
    ``manifests``: (manifest, shape, state, n_keys), state one of ``selected``, ``unlisted``, ``key_list``, ``other``, ``malformed``.
    """
    read = materialize(read, "manifests")
    listed = read.select(F.explode("names").alias("define_name")).distinct().withColumn("listed", F.lit(True))
    seen = observed.select("define_name").distinct().withColumn("observed", F.lit(True))
    every = read.select("manifest", "shape", F.posexplode("entries").alias("place", "e")).select("manifest", "shape", "place", "e.*")
    first = every.groupBy("manifest", "define_name").agg(F.min_by(F.struct([c for c in every.columns if c not in ("manifest", "define_name", "place")]), "place").alias("e")).select("manifest", "define_name", "e.*")
    flagged = first.join(listed, "define_name", "left").join(seen, "define_name", "left").fillna(False, ["listed", "observed"])
    flagged = materialize(flagged, "manifest-keys")
    kept = flagged.groupBy("manifest").agg(F.bool_or("listed").alias("kept"), F.count("*").alias("n_keys"))
    state = F.when(~F.col("shape").isin("tables", "spaces"), F.col("shape")).when(F.col("kept"), "selected").otherwise("unlisted")
    manifests = read.select("manifest", "shape").join(kept, "manifest", "left").select("manifest", "shape", state.alias("state"), F.coalesce("n_keys", F.lit(0)).cast("long").alias("n_keys"))
    return flagged.join(kept.where("kept").select("manifest"), "manifest", "left_semi"), manifests
