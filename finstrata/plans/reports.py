"""Queries of the report operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import ENTITIES, IGNORED_ID, LABELS, LEMMAS, METRICS, NOISE_PATTERNS
from ..functions.regex import NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACE, WORD
from ..operators import bioes, chunk, encode, lemma, metrics, noise, resolve, spans, split, synth, text
from ..session import table
from ..sources import detect, records
from ..streaming.flows import late_counts
from . import pipeline

# ---------------------------------------------------------------- inputs


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections, rows delivered twice once."""
    return table(spark, d, "sections").dropDuplicates(["doc_id", "section_idx"])


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["doc_id", "chunk_id"])


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotated_chunks").dropDuplicates(["chunk_key"])


_SECTIONS = "(SELECT DISTINCT ON (doc_id, section_idx) * FROM sections)"
_CHUNKS = "(SELECT DISTINCT ON (doc_id, chunk_id) * FROM chunks)"
_ANNOTATED = "(SELECT DISTINCT ON (chunk_key) * FROM annotated_chunks)"
_STRIP = f"regexp_replace(%s, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_TITLE = f"(coalesce(length({_STRIP % 'text'}) BETWEEN 1 AND 120 AND NOT regexp_matches({_STRIP % 'text'}, '[\\n.!?:,;]'), false))"
_WORDS = f"regexp_extract_all(text, '[^{SPACE}]+')"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- parsers' rules


@_query(f"SELECT doc_id, section_idx, {_TITLE} AS is_title FROM {_SECTIONS}")
def section_titles(spark, d):
    return _sections(spark, d).select("doc_id", "section_idx", text.looks_like_title(F.col("text")).alias("is_title"))


@_query(f"""SELECT doc_id, section_idx, CASE WHEN y_top < 0.05 THEN 'header' WHEN y_bottom > 0.95 THEN 'footer'
            WHEN {_TITLE} THEN 'title' ELSE 'paragraph' END AS kind FROM {_SECTIONS}""")
def block_kinds(spark, d):
    return _sections(spark, d).select("doc_id", "section_idx", text.classify_block(F.col("text"), F.col("y_top"), F.col("y_bottom")).alias("kind"))


@_query(f"""SELECT doc_id, section_idx, coalesce(array_to_string(list_transform(cell_rows, lambda r: coalesce(array_to_string(list_transform(coalesce(r, []),
            lambda c: coalesce(c, '')), ' | '), '')), ' | '), '') AS table_text FROM {_SECTIONS} WHERE block_type = 'table'""")
def table_texts(spark, d):
    return _sections(spark, d).where("block_type = 'table'").select("doc_id", "section_idx", text.rows_to_text(F.col("cell_rows")).alias("table_text"))


@_query("""SELECT doc_id, CASE WHEN lower(filename) SIMILAR TO '.+\\.(xlsx|xlsm)' THEN 'xlsx' WHEN lower(filename) LIKE '%_.docx' THEN 'docx'
           WHEN lower(filename) SIMILAR TO '.+\\.(html|htm)' THEN 'html' WHEN lower(filename) LIKE '%_.pdf' THEN 'pdf' END AS file_kind
           FROM (SELECT DISTINCT ON (doc_id) * FROM parsed_documents)""")
def file_kinds(spark, d):
    docs = table(spark, d, "parsed_documents").dropDuplicates(["doc_id"])
    return docs.select("doc_id", detect.detect_type(F.col("filename"), strict=False).alias("file_kind"))


@_query(f"""WITH p AS (SELECT doc_id, page, sum(length({_STRIP % "coalesce(text, '')"})) AS n FROM {_SECTIONS} WHERE page <= 3 GROUP BY 1, 2),
            m AS (SELECT doc_id, avg(n) AS mean FROM p GROUP BY 1)
            SELECT s.doc_id, CASE WHEN mean >= 50 THEN 'pdf_text' ELSE 'pdf_scan' END AS document_type FROM (SELECT DISTINCT doc_id FROM sections) s LEFT JOIN m USING (doc_id)""")
def pdf_kinds(spark, d):
    return detect.pdf_types(_sections(spark, d).select("doc_id", "page", "text"))


@_query("SELECT doc_id, CASE WHEN contains(lang, 'eng') THEN lang ELSE lang || '+eng' END AS ocr_lang FROM documents")
def ocr_languages(spark, d):
    return table(spark, d, "documents").select("doc_id", text.ocr_language(F.col("lang")).alias("ocr_lang"))


# ---------------------------------------------------------------- normalisation

_CYR = "а-яёА-ЯЁ"


def _twice(expr: str, pattern: str, to: str) -> str:
    """Two passes, as neighbouring matches may share a character that a pass consumes."""
    for _ in range(2):
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return expr


def _sql_steps() -> dict[str, object]:
    def embedded(t: str) -> str:
        for latin, cyr in text.LOOKALIKES.items():
            t = _twice(t, f"([а-яё]){latin}([а-яё])", f"\\1{cyr}\\2")
        return t

    def initial(t: str) -> str:
        for latin, cyr in (("c", "с"), ("o", "о"), ("C", "С"), ("O", "О")):
            t = _twice(t, f"(^|[^{WORD}]){latin}([{_CYR}]{{2}})", f"\\1{cyr}\\2")
        return t

    def dates(t: str) -> str:
        t = _twice(t, f"(^|[^{WORD}])(\\p{{Nd}}{{1,2}})[./-](\\p{{Nd}}{{1,2}})[./-](\\p{{Nd}}{{4}})($|[^{WORD}])", "\\1\ue000\\4-0\\3-0\\2\ue001\\5")
        return f"regexp_replace({t}, '\ue000(\\p{{Nd}}{{4}})-0?(\\p{{Nd}}{{2}})-0?(\\p{{Nd}}{{2}})\ue001', '\\1-\\2-\\3', 'g')"

    return {
        "drop_soft_hyphens": lambda t: f"replace({t}, chr(173), '')",
        "join_line_hyphens": lambda t: _twice(t, f"([{_CYR}])-[{SPACE}]*\\n[{SPACE}]*([{_CYR}])", "\\1\\2"),
        "replace_yo": lambda t: f"translate({t}, 'ёЁ', 'еЕ')",
        "unify_dashes": lambda t: f"translate({t}, chr(8212) || chr(8211) || chr(8722) || chr(8209), '----')",
        "fix_embedded_lookalikes": embedded,
        "fix_initial_lookalikes": initial,
        "join_digit_groups": lambda t: _twice(t, f"(\\p{{Nd}})[{SPACE}]+(\\p{{Nd}})", "\\1\\2"),
        "decimal_commas": lambda t: _twice(t, "(\\p{Nd}),(\\p{Nd})", "\\1.\\2"),
        "iso_dates": dates,
        "collapse_spaces": lambda t: f"trim(regexp_replace({t}, '[{SPACE}]+', ' ', 'g'), ' ')",
    }


def _register_steps() -> None:
    sql = _sql_steps()
    for step in text.STEPS:

        def one(spark, d, step=step):
            return table(spark, d, "documents").select("doc_id", step(F.col("text")).alias("result"))

        QUERIES[f"normalize_{step.__name__}"] = one
        ORACLES[f"normalize_{step.__name__}"] = f"SELECT doc_id, {sql[step.__name__]('text')} AS result FROM documents"
    ctes = ["s0 AS (SELECT doc_id, text AS t FROM documents)"]
    for i, step in enumerate(text.STEPS):
        ctes.append(f"s{i + 1} AS (SELECT doc_id, {sql[step.__name__]('t')} AS t FROM s{i})")
    ORACLES["normalize_composed"] = f"WITH {', '.join(ctes)} SELECT doc_id, t AS result FROM s{len(text.STEPS)}"


@_query()
def normalize_composed(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_composed(F.col("text")).alias("result"))


@_query()
def normalize_full(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("result"))


_register_steps()

# ---------------------------------------------------------------- noise

_GEOMETRY = "NOT coalesce(y_top IS NOT NULL AND y_bottom IS NOT NULL AND (y_top < 0.05 OR y_bottom > 0.95), false)"
_HEADERS = "coalesce(block_type NOT IN ('header', 'footer'), true)"
_PATTERN = "(?i)" + "|".join(f"(?:{p})" for p in NOISE_PATTERNS).replace(r"[:\s]", f"[:{SPACE}]").replace(r"\s", f"[{SPACE}]").replace(r"\d", r"\p{Nd}")
_PATTERNS = f"NOT coalesce(regexp_matches(text, '{_PATTERN}'), false)"


def _repeats_sql(source: str) -> str:
    return f"""WITH s AS ({source}), p AS (SELECT doc_id, greatest(2, round_even(coalesce(max(page), 1) * 0.7::DOUBLE, 0)) AS least FROM s GROUP BY 1),
        c AS (SELECT doc_id, coalesce(text, '') AS t, count(*) AS n FROM s WHERE block_type = 'paragraph' GROUP BY 1, 2),
        r AS (SELECT doc_id, t FROM c JOIN p USING (doc_id) WHERE n >= least)
        SELECT s.doc_id, s.section_idx FROM s LEFT JOIN r ON s.doc_id = r.doc_id AND coalesce(s.text, '') = r.t AND s.block_type = 'paragraph' WHERE r.t IS NULL"""


@_query(f"SELECT doc_id, section_idx FROM {_SECTIONS} WHERE {_GEOMETRY}")
def noise_geometry(spark, d):
    return noise.drop_by_geometry(_sections(spark, d)).select("doc_id", "section_idx")


@_query(f"SELECT doc_id, section_idx FROM {_SECTIONS} WHERE {_HEADERS}")
def noise_headers(spark, d):
    return noise.drop_headers_footers(_sections(spark, d)).select("doc_id", "section_idx")


@_query(f"SELECT doc_id, section_idx FROM {_SECTIONS} WHERE {_PATTERNS}")
def noise_patterns(spark, d):
    return noise.drop_patterns(_sections(spark, d)).select("doc_id", "section_idx")


@_query(_repeats_sql(f"SELECT * FROM {_SECTIONS}"))
def noise_repeats(spark, d):
    return noise.drop_repeating(_sections(spark, d)).select("doc_id", "section_idx")


@_query(_repeats_sql(f"SELECT * FROM {_SECTIONS} WHERE {_GEOMETRY} AND {_HEADERS} AND {_PATTERNS}"))
def noise_removed(spark, d):
    return noise.remove_noise(_sections(spark, d)).select("doc_id", "section_idx")


# ---------------------------------------------------------------- chunks

def _pieces(m: int, step: int, o: int) -> str:
    return f"""src AS (SELECT doc_id, section_idx, page, text, {_WORDS} AS w, coalesce(block_type = 'title', false) AS title FROM {_SECTIONS} WHERE length({_STRIP % 'text'}) > 0),
    cut AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= {m} THEN 1 ELSE len(w) END, {step})) AS pos FROM src),
    pieces AS (SELECT doc_id, section_idx, page, title, text, floor(pos / {step}) AS slice_no,
        CASE WHEN len(w) <= {m} THEN text ELSE array_to_string(w[greatest(pos - {o}, 0) + 1 : pos + {step}], ' ') END AS piece,
        CASE WHEN len(w) <= {m} THEN len(w) ELSE len(w[greatest(pos - {o}, 0) + 1 : pos + {step}]) END AS n FROM cut)"""


@_query("WITH " + _pieces(m=40, step=38, o=2) + " SELECT doc_id, section_idx, slice_no::INT AS slice_no, piece, n::INT AS n_words FROM pieces")
def chunk_slices(spark, d):
    return chunk.slice_sections(_sections(spark, d), 40, 0.05)


@_query(
    "WITH RECURSIVE "
    + _pieces(m=128, step=122, o=6)
    + """, grouped AS (SELECT *, coalesce(sum(CASE WHEN title AND slice_no = 0 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY section_idx, slice_no ROWS UNBOUNDED PRECEDING), 0) AS grp FROM pieces),
    ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY section_idx, slice_no) AS i FROM grouped),
    walk AS (SELECT doc_id, grp, i, piece, n AS w, 0 AS g FROM ord WHERE i = 1 UNION ALL
        SELECT o.doc_id, o.grp, o.i, o.piece, CASE WHEN k.w + o.n > 128 THEN o.n ELSE k.w + o.n END, CASE WHEN k.w + o.n > 128 THEN k.g + 1 ELSE k.g END
        FROM walk k JOIN ord o ON o.doc_id = k.doc_id AND o.grp = k.grp AND o.i = k.i + 1),
    heads AS (SELECT doc_id, grp, min(page) FILTER (title AND i = 1) AS page, min(text) FILTER (title AND i = 1) AS anchor FROM ord GROUP BY 1, 2),
    packed AS (SELECT doc_id, grp, g, string_agg(piece, chr(10) ORDER BY i) AS text FROM walk GROUP BY 1, 2, 3)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp, g))::INT AS chunk_id, text, anchor AS section_anchor, coalesce(page, 1) AS page
    FROM packed JOIN heads USING (doc_id, grp)"""
)
def chunk_packed(spark, d):
    return chunk.chunk_sections(_sections(spark, d), 128, 0.05)


@_query(f"SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY section_idx) FILTER (length(text) > 0), '') AS normalized_text FROM {_SECTIONS} GROUP BY 1")
def document_texts(spark, d):
    return chunk.document_texts(_sections(spark, d))


@_query(f"""SELECT p.doc_id, p.filename AS source, coalesce(n, 0)::VARCHAR AS chunk_count FROM (SELECT DISTINCT ON (doc_id) * FROM parsed_documents) p
            LEFT JOIN (SELECT doc_id, count(*) AS n FROM {_CHUNKS} GROUP BY 1) c USING (doc_id)""")
def document_metadata(spark, d):
    return chunk.document_metadata(table(spark, d, "parsed_documents").dropDuplicates(["doc_id"]), _chunks(spark, d))


# ---------------------------------------------------------------- tokens

_LEMMA_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LEMMAS.items()) + "}"


@_query(f"""SELECT doc_id, chunk_id, (generate_subscripts(w, 1) - 1)::INT AS word_idx, unnest(w) AS token, lower(unnest(w)) AS lemma
            FROM (SELECT doc_id, chunk_id, {_WORDS} AS w FROM {_CHUNKS} WHERE len({_WORDS}) > 0)""")
def lemma_tokens(spark, d):
    return lemma.explode_tokens(_chunks(spark, d), ["doc_id", "chunk_id"])


@_query(f"""SELECT lemma, count(*) AS n FROM (SELECT coalesce(m[lower(t)], lower(t)) AS lemma FROM
            (SELECT unnest({_WORDS}) AS t, {_LEMMA_MAP} AS m FROM {_CHUNKS})) GROUP BY 1""")
def lemma_counts(spark, d):
    return lemma.explode_tokens(_chunks(spark, d), ["doc_id", "chunk_id"], overrides=True).groupBy("lemma").agg(F.count("*").alias("n"))


def _position_sql(source: str, keys: str, pattern: str, label: str = "span_text") -> str:
    framed = f"(?s)(.*?)({pattern})"
    return f"""SELECT {keys}, h AS {label}, (e - length(h))::INT AS start_pos, e::INT AS end_pos FROM (
        SELECT {keys}, i, h, sum(length(g) + length(h)) OVER (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM (
        SELECT {keys}, unnest(regexp_extract_all(text, '{framed}', 1)) AS g, unnest(regexp_extract_all(text, '{framed}', 2)) AS h,
        generate_subscripts(regexp_extract_all(text, '{framed}', 2), 1) AS i FROM {source}))"""


def _words_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, word, (e - length(word))::INT AS start_pos, e::INT AS end_pos, (i - 1)::INT AS word_idx FROM (
        SELECT {keys}, i, regexp_replace(m, '^[{SPACE}]+', '') AS word, sum(length(m)) OVER (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM (
        SELECT {keys}, unnest(l) AS m, generate_subscripts(l, 1) AS i FROM (SELECT {keys}, regexp_extract_all(text, '[{SPACE}]*[^{SPACE}]+') AS l FROM {source})))"""


@_query(f"SELECT * EXCLUDE (word_idx) FROM ({_words_sql(_CHUNKS, 'doc_id, chunk_id')})")
def word_offsets(spark, d):
    c = _chunks(spark, d).select("doc_id", "chunk_id", F.explode(lemma.word_spans(F.col("text"))).alias("w"))
    return c.select("doc_id", "chunk_id", F.col("w.text").alias("word"), "w.start_pos", "w.end_pos")


# ---------------------------------------------------------------- spans

_BY_LABEL = {label: p for label, p in spans.PATTERNS}


@_query(_position_sql(_CHUNKS, "doc_id, chunk_id", _BY_LABEL["amount"]))
def amount_spans(spark, d):
    return spans.pattern_spans(_chunks(spark, d), ["doc_id", "chunk_id"], "amount")


@_query(_position_sql(_CHUNKS, "doc_id, chunk_id", _BY_LABEL["currency"].replace("(?iu:", "(?i:")))
def currency_spans(spark, d):
    return spans.pattern_spans(_chunks(spark, d), ["doc_id", "chunk_id"], "currency")


def _exploded_spans(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode("spans").alias("span_idx", "s")).select(*keys, "span_idx", "s.*")


_BEFORE = f"(?:^|[^{WORD}])"


def _scan_sql(i: int, label: str, pattern: str, keys: str) -> str:
    """All matches of a pattern in the texts ``src``; the engine has no lookbehind, so the character before is matched and not counted."""
    guarded = pattern.startswith(NOT_AFTER_WORD)
    bare = pattern.removeprefix(NOT_AFTER_WORD).replace("(?iu:", "(?i:")
    ahead = bare.endswith(NOT_BEFORE_WORD)
    bare = bare.removesuffix(NOT_BEFORE_WORD)
    framed = f"(?s)(.*?{_BEFORE if guarded else ''})({bare})"
    # the character after a match is looked at in the text
    after = f"AND NOT regexp_matches(substr(text, e::BIGINT + 1, 1), '[{WORD}]')" if ahead else ""
    return f"""m{i} AS (SELECT *, '{label}' AS label FROM (SELECT {keys}, text, h, (e - length(h))::INT AS a, e::INT AS b, e FROM (
        SELECT {keys}, text, h, sum(length(g) + length(h)) OVER (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM (
        SELECT {keys}, text, unnest(regexp_extract_all(text, '{framed}', 1)) AS g, unnest(regexp_extract_all(text, '{framed}', 2)) AS h,
        generate_subscripts(regexp_extract_all(text, '{framed}', 2), 1) AS i FROM src))) WHERE true {after})"""


def _rule_spans_sql(source: str, keys: str = "doc_id, chunk_id") -> str:
    """CTEs up to ``rs`` (keys, text, h, a, b, label, span_idx): the matches by priority, without those that overlap one taken before."""
    scans = [("metric", f"{NOT_AFTER_WORD}(?i:{p}){NOT_BEFORE_WORD}") for p in spans.METRIC_PHRASES] + list(spans.PATTERNS)
    same = " AND ".join(f"t.{k} = n.{k}" for k in keys.split(", "))
    ctes = [f"src AS MATERIALIZED (SELECT {keys}, text FROM {source})"]
    for i, (label, pattern) in enumerate(scans):
        ctes.append(_scan_sql(i, label, pattern, keys))
        mine = f"SELECT {keys}, text, h, a, b, label FROM m{i}"
        if i:
            mine = f"SELECT * FROM t{i - 1} UNION ALL ({mine} n WHERE NOT EXISTS (FROM t{i - 1} t WHERE {same} AND t.a < n.b AND n.a < t.b))"
        ctes.append(f"t{i} AS MATERIALIZED ({mine})")
    return ", ".join([*ctes, f"rs AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY {keys} ORDER BY a, b - a) - 1)::INT AS span_idx FROM t{len(scans) - 1})"])


@_query(f"WITH {_rule_spans_sql(_CHUNKS)} SELECT doc_id, chunk_id, span_idx, h AS text, label, a AS start_pos, b AS end_pos FROM rs")
def rule_spans(spark, d):
    """Spans of all labels, packed."""
    return _exploded_spans(spans.annotate(_chunks(spark, d).select("doc_id", "chunk_id", "text")), ["doc_id", "chunk_id"])


_STATEMENTS = f"""stm AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Значение ' WHEN 1 THEN 'По итогам ' ELSE 'По состоянию на ' END AS p0,
    CASE WHEN o_orderkey % 4 = 0 THEN metric ELSE period END AS p1, CASE WHEN o_orderkey % 4 = 0 THEN ' за ' ELSE ' ' END AS p2,
    CASE WHEN o_orderkey % 4 = 0 THEN period ELSE metric END AS p3, CASE WHEN o_orderkey % 4 = 1 THEN ' — ' ELSE ': ' END AS p4, amount, unit FROM (
    SELECT o_orderkey, ({[m.replace('_', ' ') for m in METRICS]})[(o_orderkey % {len(METRICS)} + 1)::INT] AS metric, year(o_orderdate)::VARCHAR || ' год' AS period,
    replace(format('{{:,}}', floor(o_totalprice)::BIGINT), ',', ' ') AS amount, (['тыс.', 'млн', 'млрд'])[(o_orderkey % 3 + 1)::INT] AS unit FROM orders))"""


@_query(f"WITH {_STATEMENTS} SELECT o_orderkey, p0 || p1 || p2 || p3 || p4 || amount || ' ' || unit || ' руб..' AS text FROM stm")
def synthetic_statements(spark, d):
    return synth.order_statements(table(spark, d, "orders")).select("o_orderkey", "text")


@_query(f"""WITH {_STATEMENTS}, x AS (SELECT *, length(p0) AS a1, length(p0 || p1 || p2) AS a3, length(p0 || p1 || p2 || p3 || p4) AS a5 FROM stm)
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'metric' ELSE 'period' END AS label, p1 AS span_text, a1::INT AS start_pos FROM x UNION ALL
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'period' ELSE 'metric' END, p3, a3::INT FROM x UNION ALL
    SELECT o_orderkey, 'amount', amount, a5::INT FROM x UNION ALL SELECT o_orderkey, 'unit', unit, (a5 + length(amount) + 1)::INT FROM x UNION ALL
    SELECT o_orderkey, 'currency', 'руб..', (a5 + length(amount) + length(unit) + 2)::INT FROM x WHERE false UNION ALL
    SELECT o_orderkey, 'currency', 'руб.', (a5 + length(amount) + length(unit) + 2)::INT FROM x""")
def statement_spans(spark, d):
    """The rule-based spans of generated statements: they are the parts the statements were made of."""
    a = spans.annotate(synth.order_statements(table(spark, d, "orders")).select("o_orderkey", "text"))
    return _exploded_spans(a, ["o_orderkey"]).select("o_orderkey", "label", F.col("text").alias("span_text"), "start_pos")


@_query(f"""SELECT chunk_key, coalesce(bool_and(coalesce(text[s.start_pos + 1 : s.end_pos] = s.text, false)) FILTER (s IS NOT NULL), true) AS spans_valid
    FROM (SELECT chunk_key, text, unnest(CASE WHEN len(spans) > 0 THEN spans ELSE [NULL] END) AS s FROM {_ANNOTATED}) GROUP BY 1""")
def span_validity(spark, d):
    return records.valid_spans(_annotated(spark, d)).select("chunk_key", "spans_valid")


# ---------------------------------------------------------------- labels

_WORD_LABELS = f"""ac AS MATERIALIZED {_ANNOTATED}, wn AS MATERIALIZED ({_words_sql('ac', 'chunk_key')}),
    sp AS (SELECT chunk_key, generate_subscripts(spans, 1) AS k, unnest(spans) AS s FROM ac),
    cov AS (SELECT w.chunk_key, w.word_idx, sp.k, s.label AS ent, row_number() OVER (PARTITION BY w.chunk_key, sp.k ORDER BY w.word_idx) AS p, count(*) OVER (PARTITION BY w.chunk_key, sp.k) AS n
        FROM wn w JOIN sp ON w.chunk_key = sp.chunk_key AND 2 * s.start_pos <= w.start_pos + w.end_pos AND w.start_pos + w.end_pos < 2 * s.end_pos),
    lab AS (SELECT chunk_key, word_idx, arg_max((CASE WHEN n = 1 THEN 'S' WHEN p = 1 THEN 'B' WHEN p = n THEN 'E' ELSE 'I' END) || '-' || ent, k) AS label FROM cov GROUP BY 1, 2),
    labelled AS MATERIALIZED (SELECT wn.*, coalesce(lab.label, 'O') AS label FROM wn LEFT JOIN lab USING (chunk_key, word_idx))"""


@_query(f"WITH {_WORD_LABELS} SELECT chunk_key, word_idx, word, start_pos, end_pos, label FROM labelled")
def bioes_words(spark, d):
    return bioes.label_words(_annotated(spark, d), ["chunk_key"])


@_query(f"WITH {_WORD_LABELS} SELECT chunk_key, word_idx, (list_position({list(LABELS)}, label) - 1)::INT AS label_id, regexp_replace(label, '^[BES]-', 'I-') AS continued FROM labelled")
def bioes_ids(spark, d):
    w = bioes.label_words(_annotated(spark, d), ["chunk_key"])
    return w.select("chunk_key", "word_idx", bioes.label_id(F.col("label")).alias("label_id"), bioes.continuation_label(F.col("label")).alias("continued"))


def _labelled_arrays(spark, d) -> DataFrame:
    a = _annotated(spark, d).select("chunk_key", F.col("spans").cast("array<struct<text:string,label:string,start_pos:int,end_pos:int>>").alias("s"), lemma.word_spans(F.col("text")).alias("words"))
    return a.withColumn("labels", bioes.bioes_labels(F.col("words"), F.col("s")))


def _walk_sql(first: str, after: str, closed: str) -> str:
    """The words' labels walked one by one: (op, ent) is the open span; ``after`` gives the next, ``closed`` the spans that end, as lists of (a, b, y)."""
    return f"""WITH RECURSIVE {_WORD_LABELS},
        tags AS MATERIALIZED (SELECT chunk_key, word_idx AS i, word, start_pos, end_pos, label[1:1] AS t, regexp_replace(label, '^[^-]*-?', '') AS y FROM labelled),
        walk AS (SELECT chunk_key, i, {first.format(at="-1", ent="''")} FROM tags n WHERE i = 0
            UNION ALL SELECT n.chunk_key, n.i, {after.format(at="w.op", ent="w.ent")} FROM walk w JOIN tags n ON n.chunk_key = w.chunk_key AND n.i = w.i + 1),
        ended AS (SELECT chunk_key, unnest(done) AS x FROM walk
            UNION ALL SELECT chunk_key, {{'a': op, 'b': i + 1, 'y': ent}} FROM (SELECT *, max(i) OVER (PARTITION BY chunk_key) AS top FROM walk) WHERE i = top AND op >= 0),
        found AS (SELECT chunk_key, x.a AS a, x.b AS b, x.y AS y, (row_number() OVER (PARTITION BY chunk_key ORDER BY x.a) - 1)::INT AS span_idx FROM ended)
        SELECT f.chunk_key, span_idx, string_agg(word, ' ' ORDER BY i) AS text, any_value(f.y) AS label, {closed} FROM found f JOIN tags g ON g.chunk_key = f.chunk_key AND g.i >= a AND g.i < b GROUP BY 1, 2"""


_NONE = "[]::STRUCT(a INT, b INT, y VARCHAR)[]"
_STRICT = f"""CASE WHEN {{at}} < 0 THEN CASE WHEN n.t = 'O' THEN -1 ELSE n.i END WHEN n.t IN ('O', 'E') THEN -1 WHEN n.t IN ('B', 'S') OR n.y <> {{ent}} AND n.t = 'I' THEN n.i ELSE {{at}} END AS op,
    CASE WHEN {{at}} < 0 OR n.t IN ('B', 'S') OR n.t = 'I' AND n.y <> {{ent}} THEN n.y ELSE {{ent}} END AS ent,
    CASE WHEN {{at}} < 0 OR n.t = 'I' AND n.y = {{ent}} THEN {_NONE} ELSE [{{{{'a': {{at}}, 'b': n.i + (n.t = 'E')::INT, 'y': {{ent}}}}}}] END AS done"""
_LENIENT = f"""CASE WHEN n.t IN ('O', 'S', 'E') THEN -1 WHEN n.t = 'B' OR {{at}} < 0 THEN n.i ELSE {{at}} END AS op,
    CASE WHEN n.t = 'B' OR {{at}} < 0 THEN n.y ELSE {{ent}} END AS ent,
    CASE WHEN {{at}} >= 0 AND n.t IN ('O', 'S', 'B') THEN [{{{{'a': {{at}}, 'b': n.i, 'y': {{ent}}}}}}] ELSE {_NONE} END ||
    CASE WHEN n.t = 'S' THEN [{{{{'a': n.i, 'b': n.i + 1, 'y': n.y}}}}] WHEN n.t = 'E' THEN [{{{{'a': CASE WHEN {{at}} < 0 THEN n.i ELSE {{at}} END, 'b': n.i + 1, 'y': CASE WHEN {{at}} < 0 THEN n.y ELSE {{ent}} END}}}}] ELSE {_NONE} END AS done"""


@_query(_walk_sql(_STRICT, _STRICT, "min(start_pos) AS start_pos, max(end_pos) AS end_pos"))
def bioes_decoded(spark, d):
    """Spans decoded from the words' labels."""
    return _exploded_spans(bioes.decode_bioes(_labelled_arrays(spark, d), ["chunk_key"]), ["chunk_key"])


@_query(_walk_sql(_LENIENT, _LENIENT, "(1.0 / (min(i) + 2))::DOUBLE AS confidence"))
def predictions_decoded(spark, d):
    """Spans with confidences decoded from predicted labels."""
    a = _labelled_arrays(spark, d).withColumn("probs", F.transform("labels", lambda x, i: 1.0 / (i + 2)))
    return _exploded_spans(bioes.decode_predictions(a, ["chunk_key"]), ["chunk_key"])


def _slots_sql(spans: str, keys: str) -> str:
    """Slots of ``sp`` (keys, text, k, s), which the CTEs ``spans`` give."""
    same = " AND ".join(f"c.{k} = m.{k}" for k in keys.split(", "))
    near = ", ".join(
        f"""(SELECT struct_pack(t := s.text, a := s.start_pos, b := s.end_pos) FROM sp c WHERE {same} AND c.s.label = '{x}'
        ORDER BY greatest(0, greatest(c.s.start_pos, m.s.start_pos) - least(c.s.end_pos, m.s.end_pos)), c.k LIMIT 1) AS {x}""".replace("s.text", "c.s.text").replace("a := s.", "a := c.s.").replace("b := s.", "b := c.s.")
        for x in ("amount", "period", "currency", "unit")
    )
    return f"""WITH {spans},
        m AS (SELECT * FROM sp WHERE s.label = 'metric'), n AS (SELECT {keys}, text, k, s, {near} FROM m),
        b AS (SELECT *, greatest(0, least(s.start_pos, coalesce(amount.a, s.start_pos)) - 80) AS lo, greatest(s.end_pos, coalesce(amount.b, s.end_pos)) + 80 AS hi FROM n)
        SELECT {keys}, (k - 1)::INT AS anchor_idx, s.text AS metric, period.t AS period, currency.t AS currency, unit.t AS unit, amount.t AS value,
        substring(text, lo + 1, hi - lo) AS context FROM b"""


@_query(_slots_sql(f"sp AS (SELECT chunk_key, text, generate_subscripts(spans, 1) AS k, unnest(spans) AS s FROM {_ANNOTATED})", "chunk_key"))
def resolved_slots(spark, d):
    return resolve.resolve_slots(_annotated(spark, d), ["chunk_key"])


@_query()
def pipeline_chunks(spark, d):
    """Normalise, remove noise, chunk."""
    return pipeline.preprocess(_sections(spark, d)).select("doc_id", "chunk_id", "text", "section_anchor", "page", F.size("tokens").alias("n_tokens"))


_SPAN = "struct_pack(text := h, label := label, start_pos := a, end_pos := b)"


@_query(_slots_sql(f"{_rule_spans_sql(_CHUNKS)}, sp AS MATERIALIZED (SELECT doc_id, chunk_id, text, span_idx + 1 AS k, {_SPAN} AS s FROM rs)", "doc_id, chunk_id"))
def pipeline_slots(spark, d):
    """Slots of chunks, by rule-based spans."""
    return pipeline.extract_slots(_chunks(spark, d), ["doc_id", "chunk_id"])


# ---------------------------------------------------------------- metrics


def _predictions(spark, d) -> DataFrame:
    """A three-class toy prediction: softmax of the first three embedding coordinates, against the label modulo 3."""
    e = table(spark, d, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 4)
    return e.select("vec_id", (F.col("label") % 3).cast("int").alias("true_id"), metrics.softmax(logits).alias("probs"))


_PRED = """e AS (SELECT vec_id, (label % 3)::INT AS true_id, list_transform(embedding[1:3], lambda x: x::DOUBLE * 4) AS l FROM embeddings),
    x AS (SELECT *, list_transform(l, lambda v: exp(v - list_max(l))) AS ex FROM e),
    pr AS (SELECT vec_id, true_id, list_transform(ex, lambda v: v / list_sum(ex)) AS probs, (list_position(l, list_max(l)) - 1)::INT AS pred_id FROM x),
    k AS (SELECT unnest(range(3))::INT AS c),
    grid AS (SELECT a.c AS true_id, b.c AS pred_id, (SELECT count(*) FROM pr WHERE pr.true_id = a.c AND pr.pred_id = b.c) AS n FROM k a, k b),
    per AS (SELECT c AS class_id, sum(n) FILTER (true_id = c AND pred_id = c) AS tp, sum(n) FILTER (pred_id = c) AS p, sum(n) FILTER (true_id = c) AS t FROM grid, k GROUP BY 1),
    pre AS (SELECT class_id, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS precision, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS recall FROM per),
    sc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pre)"""
_BRIER = "(SELECT avg(list_sum(list_transform(probs, lambda v, i: (v - CASE WHEN i = true_id + 1 THEN 1 ELSE 0 END) ** 2))) FROM pr)"
_ECE = """(SELECT sum(n * abs(acc - conf)) / sum(n) FROM (SELECT least(floor(list_max(probs) * 10), 9) AS b, count(*) AS n,
    avg((pred_id = true_id)::INT) AS acc, avg(list_max(probs)) AS conf FROM pr GROUP BY 1))"""


@_query(f"WITH {_PRED} SELECT vec_id, list_transform(probs, lambda v: round(v, 6)) AS probs FROM pr")
def softmax_probabilities(spark, d):
    return _predictions(spark, d).select("vec_id", F.transform("probs", lambda x: F.round(x, 6)).alias("probs"))


@_query(f"WITH {_PRED} SELECT true_id, pred_id, n FROM grid")
def confusion(spark, d):
    p = _predictions(spark, d)
    return metrics.confusion_matrix(p.withColumn("pred_id", metrics.argmax(F.col("probs"))), 3)


@_query(f"WITH {_PRED} SELECT class_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sc")
def class_scores(spark, d):
    s = metrics.class_scores(metrics.confusion_matrix(_predictions(spark, d).withColumn("pred_id", metrics.argmax(F.col("probs"))), 3))
    return s.select("class_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@_query(f"""WITH {_PRED} SELECT (SELECT count(*) FROM pr) AS n, round((SELECT avg((pred_id = true_id)::INT) FROM pr), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
    round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round({_BRIER}, 6) AS brier, round({_ECE}, 6) AS ece FROM sc""")
def risk_report(spark, d):
    r = metrics.risk_metrics(_predictions(spark, d))
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "brier", "ece")])


def _ner_sql() -> str:
    def ents(col: str) -> str:
        return f"""(SELECT chunk_key, min_by(y, word_idx) AS ent, min(word_idx) AS a, max(word_idx) AS b FROM (SELECT *, sum(CASE WHEN t IN ('B', 'S') OR (pt IN ('E', 'S', 'O') AND t IN ('I', 'E'))
            OR (t <> 'O' AND py <> y) THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_key ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS n FROM (
            SELECT *, coalesce(lag(t) OVER w, 'O') AS pt, coalesce(lag(y) OVER w, '') AS py FROM (SELECT chunk_key, word_idx, {col}[1:1] AS t, regexp_replace({col}, '^[^-]*-?', '') AS y FROM two)
            WINDOW w AS (PARTITION BY chunk_key ORDER BY word_idx))) WHERE t <> 'O' GROUP BY chunk_key, n)"""

    scores = "CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall"
    f1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1"
    return f"""WITH {_WORD_LABELS}, two AS (SELECT chunk_key, word_idx, label AS gold, CASE WHEN label LIKE '%-unit' THEN 'O' WHEN label LIKE 'E-%' THEN 'I' || label[2:] WHEN label = 'S-period' THEN 'S-amount' ELSE label END AS pred FROM labelled),
        g AS {ents('gold')}, p AS {ents('pred')},
        m AS (SELECT coalesce(g.ent, p.ent) AS entity, count(*) FILTER (g.ent IS NOT NULL AND p.ent IS NOT NULL) AS tp, count(p.ent) AS np, count(g.ent) AS support FROM g FULL JOIN p ON g.chunk_key = p.chunk_key AND g.ent = p.ent AND g.a = p.a AND g.b = p.b GROUP BY 1),
        s AS (SELECT *, {f1} FROM (SELECT entity, tp, np, support, {scores} FROM m)), t AS (SELECT *, {f1} FROM (SELECT support, {scores} FROM (SELECT sum(tp) AS tp, sum(np) AS np, sum(support) AS support FROM m))),
        a AS (SELECT entity, precision, recall, f1, support FROM s UNION ALL SELECT 'micro avg', precision, recall, f1, support FROM t UNION ALL
            SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s UNION ALL
            SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s)
        SELECT entity, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM a"""


@_query(_ner_sql())
def entity_report(spark, d):
    """Entity scores of labels against a fixed degradation of them."""
    w = bioes.label_words(_annotated(spark, d), ["chunk_key"])
    pred = F.when(F.col("label").endswith("-unit"), "O").when(F.col("label").startswith("E-"), F.concat(F.lit("I"), F.expr("substring(label, 2)"))).when(F.col("label") == "S-period", "S-amount").otherwise(F.col("label"))
    r = metrics.entity_report(w.select("chunk_key", "word_idx", F.col("label").alias("gold"), pred.alias("pred")), ["chunk_key"])
    return r.select("entity", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@_query(f"""WITH {_WORD_LABELS}, c AS (SELECT (list_position({list(LABELS)}, label) - 1)::INT AS class_id, 1.0::DOUBLE / count(*) AS inv FROM labelled GROUP BY 1 HAVING class_id IS NOT NULL)
    SELECT k::INT AS class_id, round(coalesce(inv * (SELECT count(*) FROM c) / (SELECT sum(inv) FROM c), 1), 6) AS weight FROM (SELECT unnest(range({len(LABELS)})) AS k) LEFT JOIN c ON k = class_id""")
def label_weights(spark, d):
    w = encode.ner_words(_annotated(spark, d), ["chunk_key"]).withColumn("label_id", F.coalesce("label_id", F.lit(IGNORED_ID)))
    return metrics.class_weights(w, len(LABELS)).select("class_id", F.round("weight", 6).alias("weight"))


# ---------------------------------------------------------------- training sets


@_query(f"""WITH n AS (SELECT count(*) AS n FROM {_ANNOTATED}), c AS (SELECT n, greatest(1, floor(n * 0.85::DOUBLE)) AS c FROM n)
    SELECT 'train' AS part, (CASE WHEN c >= n THEN greatest(0, n - 1) ELSE c END)::BIGINT AS n_rows FROM c UNION ALL
    SELECT 'validation', (n - CASE WHEN c >= n THEN greatest(0, n - 1) ELSE c END)::BIGINT FROM c""")
def split_sizes(spark, d):
    return split.split_records(_annotated(spark, d).select("chunk_key"), ["chunk_key"]).groupBy("part").agg(F.count("*").alias("n_rows"))


@_query(f"""SELECT source, coalesce(string_agg(text, chr(10) ORDER BY chunk_id, text) FILTER (text IS NOT NULL), '') AS text, max(risk) AS risk,
    (list_position(['low', 'medium', 'high'], max(risk)) - 1)::INT AS risk_id FROM {_ANNOTATED} GROUP BY 1 HAVING max(risk) IS NOT NULL""")
def risk_examples(spark, d):
    return encode.risk_examples(_annotated(spark, d))


@_query()
def ner_examples(spark, d):
    """Encoded chunks by a vocabulary of single characters."""
    alphabet = "0123456789abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё.,;:%-«»()"
    vocab = {p: i for i, p in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *alphabet, *(f"##{c}" for c in alphabet)])}
    return encode.ner_examples(_annotated(spark, d), ["chunk_key"], vocab)


@_query("""SELECT unnest(range(400))::INT AS step, round(CASE WHEN unnest(range(400)) < 24 THEN (unnest(range(400)) + 1) / 24 ELSE greatest(0, 1 - (unnest(range(400)) - 24) / 376) END, 6) AS rate""")
def warmup_schedule(spark, d):
    steps = spark.range(400).select(F.col("id").cast("int").alias("step"))
    return steps.select("step", F.round(split.warmup_rate(F.col("step"), 24, 400), 6).alias("rate"))


@_query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value AS score FROM events WHERE value IS NOT NULL),
    u AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM s),
    r AS (SELECT *, sum(up::INT) OVER (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS g FROM u),
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY epoch) - 1 AS idle FROM r),
    z AS (SELECT *, min(epoch) FILTER (idle >= 2) OVER (PARTITION BY user_id) AS stop FROM i)
    SELECT user_id, arg_max(epoch, score) FILTER (up) AS best_epoch, max(score) AS best_score, count(*) AS epochs_run FROM z WHERE stop IS NULL OR epoch <= stop GROUP BY 1""")
def early_stopping(spark, d):
    e = table(spark, d, "events").where("value is not null")
    runs = e.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("epoch"), F.col("value").alias("score"))
    return split.best_epochs(runs, ["user_id"])


@_query(f"""WITH {_rule_spans_sql(_ANNOTATED, 'chunk_key')}, v AS (SELECT chunk_key, list(struct_pack(from_name := 'entities', to_name := 'text', type := 'labels',
        value := struct_pack(start := a, "end" := b, text := h, labels := [label])) ORDER BY span_idx) AS r FROM rs GROUP BY 1)
    SELECT chunk_key, to_json(struct_pack(data := struct_pack(text := text, source := source, chunk_id := chunk_id), predictions := [struct_pack(model_version := 'baseline', result := coalesce(r, []))]))::VARCHAR AS task
    FROM {_ANNOTATED} LEFT JOIN v USING (chunk_key)""")
def labelling_tasks(spark, d):
    """Task payloads with predictions."""
    return records.labelling_tasks(_annotated(spark, d).select("chunk_key", "source", "chunk_id", "text"), ["chunk_key"])


def _export(spark, d) -> DataFrame:
    """An export whose tasks are the annotated chunks in order of their keys."""
    value = lambda s: F.struct(F.struct(s["text"].alias("text"), F.array(s["label"]).alias("labels"), s["start_pos"].cast("int").alias("start"), s["end_pos"].cast("int").alias("end")).alias("value"))
    return _annotated(spark, d).select(
        F.col("chunk_key").alias("task_idx"), F.struct("source", F.col("chunk_id").cast("string").alias("chunk_id"), "text").alias("data"),
        F.array(F.struct(F.transform(F.filter("spans", lambda s: s.isNotNull()), value).alias("result"))).alias("annotations"),
    )


@_query(f"""SELECT coalesce(source, 'unknown') AS source, (row_number() OVER (PARTITION BY coalesce(source, 'unknown') ORDER BY coalesce(chunk_id, 0), chunk_key) - 1)::INT AS place,
    coalesce(chunk_id, 0)::INT AS chunk_id, coalesce(text, '') AS text, coalesce(len(list_filter(spans, lambda s: s IS NOT NULL)), 0)::INT AS n_spans FROM {_ANNOTATED}""")
def export_chunks(spark, d):
    c = records.export_chunks(_export(spark, d))
    place = F.row_number().over(W.partitionBy("source").orderBy("chunk_id", "task_idx")) - 1
    return c.select("source", place.alias("place"), "chunk_id", "text", F.size("spans").alias("n_spans"))


@_query()
def synthetic_records(spark, d):
    """Generated records, one row per chunk."""
    g = synth.generate(spark, synth.Options())
    return g.select("source", "risk", F.explode("chunks").alias("c")).select("source", "risk", "c.chunk_id", "c.text", F.size("c.spans").alias("n_spans"))


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark, d):
    return late_counts(table(spark, d, "events"))


assert set(_BY_LABEL) <= set(ENTITIES)
