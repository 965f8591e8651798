"""Deeply nested records as related flat tables, by Merkle identities of their objects.

Objects are canonicalised and hashed bottom-up (links and attributes, spans over their attributes' hashes, chunks over
their spans' hashes, records over the hashes of their chunks and their meta object), so that equal objects have one
identity whatever their key order or JSON form.  The object tables hold each identity once; the bridge tables hold every
occurrence with its parent's key and its ordinal.  Fields that have no column of their own are kept as canonical JSON in
``extra`` and belong to the identity.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Closes a framed text: where it is found at the top level, nothing of the text was left over.
_END = "end"
_MAP = "try_variant_get(%s, '$', 'map<string,variant>')"


def _let(name: str, value: str, then: str) -> str:
    """SQL of ``then`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _items(expr: str, name: str) -> str:
    """ARRAY<VARIANT> of a list, of an object given in place of one, or of either written as a JSON string; null for others."""
    inner = f"{name}s"

    def of(v: str) -> str:
        return f"coalesce(try_variant_get({v}, '$', 'array<variant>'), if({_MAP % v} is not null, array({v}), null))"

    return _let(name, expr, f"coalesce({of(name)}, {_let(inner, f'''try_parse_json(try_variant_get({name}, '$', 'string'))''', of(inner))})")


def _hash(expr: str) -> str:
    return f"sha2(to_json({expr}), 256)"


def _json(v: str) -> str:
    """Canonical JSON: a VARIANT keeps the fields of its objects in the order of their names."""
    return f"nullif(to_json({v}), 'null')"


def _object(v: str, node: str, columns: dict[str, str], hashed: str = "t") -> str:
    """SQL of a struct for the object ``v``, null for other values: ``node``, ``columns`` and ``extra``.

    ``columns`` maps the JSON names, with the columns they fill, to SQL over ``m``, the object's fields.  What they don't
    hold, because it has another name or a form that the column can't take, goes to ``extra``.
    """
    typed = ", ".join(f"'{c}', {e}" for c, e in columns.values())
    lost = " ".join(f"when '{name}' then t.`{c}` is null" for name, (c, _) in columns.items())
    extra = f"nullif(to_json(map_filter(m, (k, x) -> not is_variant_null(x) and case k {lost} else true end)), '{{}}')"
    with_extra = "named_struct(" + ", ".join(f"'{c}', t.`{c}`" for c, _ in columns.values()) + f", 'extra', {extra})"
    final = f"named_struct('{node}', {_hash(hashed)}, " + ", ".join(f"'{c}', t.`{c}`" for c in [*(c for c, _ in columns.values()), "extra"]) + ")"
    return _let("m", _MAP % v, f"if(m is null, null, {_let('t', f'named_struct({typed})', _let('t', with_extra, final))})")


def _get(name: str, kind: str = "string") -> str:
    return f"try_variant_get(m['{name}'], '$', '{kind}')"


def _number(name: str) -> str:
    return f"try_cast({_get(name)} as int)"


@dataclass(frozen=True)
class FlatTables:
    """The related tables of nested annotation records.

    Bridges, every occurrence: ``records`` (key, record_node, source, risk, meta_node, extra), ``chunk_bridge`` (key,
    record_node, chunk_pos, chunk_node), ``span_bridge`` (key, chunk_pos, chunk_node, span_pos, span_node), ``link_bridge``
    (key, chunk_pos, span_pos, attrs_node, link_pos, link_node), ``annotator_bridge`` (key, meta_node, annotator_pos,
    annotator_node).  Objects, each once: ``chunk_objects`` (chunk_node, chunk_id, text, extra), ``span_objects``
    (span_node, text, label, start_pos, end_pos, attrs_node, extra), ``attrs_objects`` (attrs_node, attrs),
    ``meta_objects`` (meta_node, meta), ``link_objects`` (link_node, kind, to, extra), ``annotator_objects``
    (annotator_node, code, seconds, extra).  ``unreadable`` (key, problem) lists the texts that gave no record.
    """

    records: DataFrame
    chunk_bridge: DataFrame
    span_bridge: DataFrame
    link_bridge: DataFrame
    annotator_bridge: DataFrame
    chunk_objects: DataFrame
    span_objects: DataFrame
    attrs_objects: DataFrame
    meta_objects: DataFrame
    link_objects: DataFrame
    annotator_objects: DataFrame
    unreadable: DataFrame


def _record(text: str) -> str:
    """SQL of the VARIANT of the record in ``text``, else null: parsed once, framed so that nothing may follow the value."""
    framed = f"""try_parse_json(concat('{{"r":', {text}, ',"{_END}":0}}'))"""
    unwrapped = "if(m['record'] is not null and m['chunks'] is null and " + _MAP % "m['record']" + " is not null, m['record'], f['r'])"
    return _let("f", _MAP % framed, f"if(size(f) = 2 and f['{_END}'] is not null, {_let('m', _MAP % '''f['r']''', f'if(m is null, null, {unwrapped})')}, null)")


def nested_records(df: DataFrame, key: str = "line_id", text: str = "raw_line") -> DataFrame:
    """One row per readable record: (key, record_node, source, risk, meta_node, meta, extra, chunks) with Merkle nodes at every level.

    Blank, null and broken texts give no row, nor does JSON that is no object.  A record wrapped as ``{"record": {...}}``
    is unwrapped.  Absent and null fields are one, numbers written as strings are numbers, lists written as one object
    or as a JSON string are lists; null entries keep their positions.  Names that occur twice in an object make a
    record unreadable.  Columns of ``df`` other than ``key`` and ``text`` don't matter.
    """
    attrs = _let("a", "m['attrs']", f"if(a is null or is_variant_null(a), null, {_let('j', _json('a'), '''named_struct('attrs_node', sha2(j, 256), 'attrs', j)''')})")
    span = _object("s", "span_node", {"text": ("text", _get("text")), "label": ("label", _get("label")), "start": ("start_pos", _number("start")), "end": ("end_pos", _number("end")), "attrs": ("attrs", attrs)},
                   "named_struct('t', t.text, 'l', t.label, 'a', t.start_pos, 'b', t.end_pos, 'n', t.attrs.attrs_node, 'x', t.extra)")
    spans = f"transform({_items('''m['spans']''', 'u')}, s -> {span})"
    chunk = _object("c", "chunk_node", {"chunk_id": ("chunk_id", _number("chunk_id")), "text": ("text", _get("text")), "spans": ("spans", spans)},
                    "named_struct('i', t.chunk_id, 't', t.text, 's', transform(t.spans, s -> s.span_node), 'x', t.extra)")
    chunks = f"transform({_items('''m['chunks']''', 'w')}, c -> {chunk})"
    meta = _let("a", "m['meta']", f"if(a is null or is_variant_null(a), null, {_let('j', _json('a'), '''named_struct('meta_node', sha2(j, 256), 'meta', j)''')})")
    record = _object("r", "record_node", {"source": ("source", _get("source")), "risk": ("risk", _get("risk")), "meta": ("meta", meta), "chunks": ("chunks", chunks)},
                     "named_struct('s', t.source, 'r', t.risk, 'm', t.meta.meta_node, 'c', transform(t.chunks, c -> c.chunk_node), 'x', t.extra)")
    # A cheap cut before the JSON parser: no readable record lacks an opening brace.
    src = df.where(F.col(text).contains("{")).select(F.col(key).alias(key), F.col(text).alias("__t"))
    # exploded, as a filter of the result would evaluate it twice
    read = src.select(key, F.explode(F.expr(f"array_compact(array({_let('r', _record('__t'), f'if(r is null, null, {record})')}))")).alias("r"))
    return read.select(key, "r.record_node", "r.source", "r.risk", "r.meta.meta_node", "r.meta.meta", "r.extra", "r.chunks")


def flatten_records(df: DataFrame, key: str = "line_id", text: str = "raw_line", wanted: Sequence[str] | None = None) -> FlatTables:
    """The :class:`FlatTables` of the JSON records in ``text``; rows delivered twice count once in every table.

    The texts are parsed once, and the parsed records written for the tables to read; where only one table is ``wanted``
    it is made from the texts directly.
    """
    wanted = [f.name for f in fields(FlatTables)] if wanted is None else wanted
    nested = nested_records(df, key, text)
    if len(wanted) > 1:
        nested = cut(nested)
    chunks = nested.select(key, "record_node", F.posexplode("chunks").alias("chunk_pos", "c")).where("c is not null")
    spans = chunks.select(key, "chunk_pos", F.col("c.chunk_node").alias("chunk_node"), F.posexplode("c.spans").alias("span_pos", "s")).where("s is not null")

    def parts(of: DataFrame, json: str, name: str, node: str, columns: dict[str, str]) -> DataFrame:
        """The objects in the list ``name`` of the object that ``json`` holds."""
        typed = {c: (c, _get(c) if kind == "string" else _number(c)) for c, kind in columns.items()}
        hashed = "named_struct(" + ", ".join(f"'{c}', t.`{c}`" for c in columns) + ", 'x', t.extra)"
        each = f"transform(try_variant_get(try_parse_json({json}), '$.{name}', 'array<variant>'), l -> {_object('l', node, typed, hashed)})"
        return of.withColumn("l", F.expr(each)).select("*", F.posexplode("l").alias("at", "o")).where("o is not null")

    with_attrs = spans.where("s.attrs is not null").select(key, "chunk_pos", "span_pos", "s.attrs.*")
    links = parts(with_attrs, "attrs", "links", "link_node", {"kind": "string", "to": "int"})
    people = parts(nested.where("meta is not null").select(key, "meta_node", "meta"), "meta", "annotators", "annotator_node", {"code": "string", "seconds": "int"})

    def once(objects: DataFrame) -> DataFrame:
        node, *rest = objects.columns
        return objects.groupBy(node).agg(*[F.first(c).alias(c) for c in rest])

    problem = F.when(F.col(text).isNull(), "null").when(F.trim(F.regexp_replace(text, r"\s", " ")) == "", "blank").otherwise("no record")
    return FlatTables(
        records=nested.drop("chunks", "meta").distinct(),
        chunk_bridge=chunks.select(key, "record_node", "chunk_pos", F.col("c.chunk_node").alias("chunk_node")).distinct(),
        span_bridge=spans.select(key, "chunk_pos", "chunk_node", "span_pos", F.col("s.span_node").alias("span_node")).distinct(),
        link_bridge=links.select(key, "chunk_pos", "span_pos", "attrs_node", F.col("at").alias("link_pos"), "o.link_node").distinct(),
        annotator_bridge=people.select(key, "meta_node", F.col("at").alias("annotator_pos"), "o.annotator_node").distinct(),
        chunk_objects=once(chunks.select("c.chunk_node", "c.chunk_id", "c.text", "c.extra")),
        span_objects=once(spans.select("s.span_node", "s.text", "s.label", "s.start_pos", "s.end_pos", F.col("s.attrs.attrs_node").alias("attrs_node"), "s.extra")),
        attrs_objects=once(with_attrs.select("attrs_node", "attrs")),
        meta_objects=once(nested.where("meta is not null").select("meta_node", "meta")),
        link_objects=once(links.select("o.*")),
        annotator_objects=once(people.select("o.*")),
        unreadable=df.join(nested.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti").select(key, problem.alias("problem")).distinct(),
    )
