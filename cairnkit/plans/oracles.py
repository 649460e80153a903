"""DuckDB SQL that states each registered query independently of its Spark plan."""

from __future__ import annotations

NL = "chr(10)"
WS = r"[\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
SPACES = "　   " + "".join(map(chr, range(0x2000, 0x200B)))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, {NL}), lambda q: {strip('q')}), lambda q: q <> '')"


def basic(x: str) -> str:
    x = f"regexp_replace({x}, '^\\x{{FEFF}}', '')"
    x = f"replace(replace({x}, chr(13) || chr(10), {NL}), chr(13), {NL})"
    x = f"regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"
    return f"array_to_string({lines(x)}, {NL})"


def squeeze(x: str) -> str:
    """Runs of blanks to one, each line without white space at its end, the whole stripped."""
    x = f"regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g')"
    x = f"array_to_string(list_transform(string_split({x}, {NL}), lambda q: regexp_replace(q, '{WS}+$', '')), {NL})"
    return strip(x)


def prose(x: str, code: bool = False) -> str:
    x = f"translate({x}, '{SPACES}', '{' ' * len(SPACES)}')"
    return squeeze(f"nfc_normalize({x})" if code else f"nfc_normalize(translate({x}, '{WIDE}', '{NARROW}'))")


def toks(x: str) -> str:
    """Words if there is a space, else characters."""
    return f"list_filter(CASE WHEN contains({x}, ' ') THEN string_split_regex({x}, '{WS}+') ELSE string_split({x}, '') END, lambda q: q <> '')"


def windows(x: str, size: int, overlap: int) -> str:
    step = size - overlap
    parts = toks(x)
    many = f"range(0, CAST(greatest(0, ceil((len({parts}) - {size}) / {step}.0)) AS BIGINT) + 1)"

    def piece(glue: str) -> str:
        return strip(f"array_to_string(list_slice({parts}, i * {step} + 1, i * {step} + {size}), '{glue}')")

    return f"list_filter(CASE WHEN contains({x}, ' ') THEN list_transform({many}, lambda i: {piece(' ')}) ELSE list_transform({many}, lambda i: {piece('')}) END, lambda q: q <> '')"


def exploded(chunks: str, source: str = "documents") -> str:
    """(doc_id, pos, chunk) rows of a list, counted from 0."""
    return f"SELECT doc_id, CAST(unnest(range(len(c))) AS INTEGER) AS pos, unnest(c) AS chunk FROM (SELECT doc_id, {chunks} AS c FROM {source})"


def hybrid_cte(docs: str, size: int, overlap: int) -> str:
    """CTEs up to h (doc_id, c): the packed chunks of docs (doc_id, t)."""
    return f"""
    l0 AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM (SELECT doc_id, {lines("t")} AS l FROM {docs})),
    l1 AS (SELECT doc_id, pos, x, len({toks("x")}) AS n, CASE WHEN contains(x, ' ') THEN ' ' ELSE '' END AS glue,
      CASE WHEN contains(x, ' ') THEN array_to_string({toks("x")}, ' ') ELSE x END AS body,
      CASE WHEN len({toks("x")}) > {size} THEN {windows("x", size, overlap)} END AS pieces FROM l0),
    l2 AS (
      SELECT doc_id, pos, CASE WHEN n > {size} THEN pieces ELSE CAST([] AS VARCHAR[]) END AS c, CASE WHEN n > {size} THEN '' ELSE body END AS o, CASE WHEN n > {size} THEN 0 ELSE n END AS n, CASE WHEN n > {size} THEN '' ELSE glue END AS glue FROM l1 WHERE pos = 0
      UNION ALL
      SELECT r.doc_id, l1.pos,
        CASE WHEN l1.n > {size} THEN list_concat(CASE WHEN r.n > 0 THEN list_append(r.c, r.o) ELSE r.c END, l1.pieces)
             WHEN r.n > 0 AND r.n + l1.n <= {size} AND r.glue = l1.glue THEN r.c
             WHEN r.n > 0 THEN list_append(r.c, r.o) ELSE r.c END,
        CASE WHEN l1.n > {size} THEN '' WHEN r.n > 0 AND r.n + l1.n <= {size} AND r.glue = l1.glue THEN r.o || l1.glue || l1.body ELSE l1.body END,
        CASE WHEN l1.n > {size} THEN 0 WHEN r.n > 0 AND r.n + l1.n <= {size} AND r.glue = l1.glue THEN r.n + l1.n ELSE l1.n END,
        CASE WHEN l1.n > {size} THEN '' ELSE l1.glue END
      FROM l2 r JOIN l1 ON l1.doc_id = r.doc_id AND l1.pos = r.pos + 1),
    h AS (SELECT doc_id, CASE WHEN n > 0 THEN list_append(c, o) ELSE c END AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back FROM l2) WHERE back = 1)"""


def line_cte(docs: str, size: int, overlap: int) -> str:
    return f"""
    l0 AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM (SELECT doc_id, {lines("t")} AS l FROM {docs})),
    l1 AS (SELECT doc_id, pos, x, CASE WHEN len({toks("x")}) > {size} THEN {windows("x", size, overlap)} END AS pieces FROM l0),
    l2 AS (
      SELECT doc_id, pos, coalesce(pieces, CAST([] AS VARCHAR[])) AS c, CASE WHEN pieces IS NULL THEN x ELSE '' END AS o FROM l1 WHERE pos = 0
      UNION ALL
      SELECT doc_id, pos, CASE WHEN pieces IS NOT NULL THEN list_concat(CASE WHEN o <> '' THEN list_append(c, o) ELSE c END, pieces) WHEN o <> '' AND fits THEN c WHEN o <> '' THEN list_append(c, o) ELSE c END,
        CASE WHEN pieces IS NOT NULL THEN '' WHEN o <> '' AND fits THEN cand ELSE x END
      FROM (SELECT r.doc_id, l1.pos, r.c, r.o, l1.x, l1.pieces, r.o || {NL} || l1.x AS cand, len({toks(f"(r.o || {NL} || l1.x)")}) <= {size} AS fits FROM l2 r JOIN l1 ON l1.doc_id = r.doc_id AND l1.pos = r.pos + 1)),
    h AS (SELECT doc_id, CASE WHEN o <> '' THEN list_append(c, o) ELSE c END AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back FROM l2) WHERE back = 1)"""


def paragraphs(x: str, size: int, overlap: int) -> str:
    parts = f"list_filter(list_transform(string_split_regex({strip(x)}, '\\n{WS}*\\n+'), lambda q: {strip('q')}), lambda q: q <> '')"
    parts = f"CASE WHEN len({parts}) = 1 AND contains({strip(x)}, {NL}) THEN {lines(strip(x))} ELSE {parts} END"
    return f"flatten(list_transform({parts}, lambda p: CASE WHEN len({toks('p')}) > {size} THEN {windows('p', size, overlap)} ELSE [p] END))"


def first_places(x: str) -> str:
    """Distinct items of a list in the order of their first places."""
    return f"list_filter({x}, lambda v, k: list_position({x}, v) = k)"


FULL = "'Ａ！　'"
ZONE = "CASE {0} % 3 WHEN 0 THEN 'cyber' WHEN 1 THEN 'ai' ELSE 'crypto' END"
TYPE = "CASE WHEN {0} % 10 = 0 THEN 'baseline' ELSE 'knowledge' END"
PATH = "source || '/' || doc_id || '.txt'"
STORED = f"""s AS (SELECT sha1({PATH}) AS chunk_id, {ZONE.format("doc_id")} AS zone_id, {TYPE.format("doc_id")} AS record_type, text, lang, CAST(doc_id AS VARCHAR) AS doc_id, false AS is_deleted, CAST(1 AS BIGINT) AS created_at, CAST(1 AS BIGINT) AS updated_at FROM documents)"""
SEEN = "chunk_id, zone_id, record_type, sha1(text) AS text_hash, is_deleted, created_at, updated_at"
VECTORS = f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, {ZONE.format("label")} AS zone_id, {TYPE.format("vec_id")} AS record_type FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0)"""
COSINE = "list_inner_product(e, q) / sqrt(list_inner_product(e, e) * list_inner_product(q, q))"


def fake(x: str, dim: int) -> str:
    raw = f"list_transform(range({dim}), lambda i: CAST(CAST('0x' || substr(sha256({x}), CAST((i % 32) * 2 + 1 AS INTEGER), 2) AS INTEGER) AS DOUBLE) / 255)"
    return f"(SELECT list_transform(r, lambda y: y / n) FROM (SELECT r, sqrt(list_inner_product(r, r)) AS n FROM (SELECT {raw} AS r)))"


def topk(score: str, order: str, where: str, k: int = 20) -> str:
    return f"WITH {VECTORS}, s AS (SELECT vec_id, zone_id, record_type, {score} AS score FROM v, q WHERE {where}), r AS (SELECT *, CAST(row_number() OVER (ORDER BY score {order}, vec_id) AS INTEGER) AS rank FROM s) SELECT vec_id, zone_id, record_type, round(score, 6) AS score, rank FROM r WHERE rank <= {k}"


DOCS = f"""c AS (SELECT sha1({PATH}) AS chunk_id, {ZONE.format("doc_id")} AS zone_id, {TYPE.format("doc_id")} AS record_type, text, doc_id || '.txt' AS filename FROM documents)"""
ASKED = f"""a AS (SELECT item_id AS query_id, {ZONE.format("item_id")} AS zone_id, text AS query FROM benchmark)"""
OKAPI = rf"""{DOCS}, {ASKED},
    t AS (SELECT zone_id, chunk_id, record_type, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM c),
    z AS (SELECT zone_id, count(*) AS n, avg(len(w)) AS avgdl FROM t GROUP BY zone_id),
    p AS (SELECT zone_id, chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT zone_id, chunk_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
    d AS (SELECT p.zone_id, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p JOIN z ON p.zone_id = z.zone_id GROUP BY p.zone_id, term),
    i AS (SELECT zone_id, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY zone_id) ELSE raw END AS idf FROM d),
    qt AS (SELECT query_id, zone_id, term, count(*) AS qtf FROM (SELECT query_id, zone_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS term FROM a) GROUP BY ALL),
    x AS (SELECT query_id, p.zone_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN qt ON p.zone_id = qt.zone_id AND p.term = qt.term JOIN i ON p.zone_id = i.zone_id AND p.term = i.term JOIN z ON p.zone_id = z.zone_id GROUP BY ALL),
    f AS (SELECT g.query_id, g.zone_id, t.chunk_id, round(coalesce(score, 0), 9) AS score FROM t JOIN (SELECT DISTINCT query_id, zone_id FROM qt) g ON t.zone_id = g.zone_id LEFT JOIN x ON x.query_id = g.query_id AND x.chunk_id = t.chunk_id WHERE record_type = 'knowledge')"""

ORACLES: dict[str, str] = {
    "chunk_records": f"""WITH RECURSIVE d AS (SELECT doc_id AS no, {PATH} AS source_path, sha1({PATH}) AS doc_id, source, lang, text, {prose(basic("text"))} AS t FROM documents), {hybrid_cte("d", 300, 50)},
      e AS (SELECT doc_id, {first_places("c")} AS c FROM h),
      u AS (SELECT doc_id, CAST(len(c) AS INTEGER) AS chunk_count, CAST(unnest(range(len(c))) AS INTEGER) AS chunk_index, unnest(c) AS text FROM e)
      SELECT sha1(u.doc_id || ':' || chunk_index || ':' || sha1(u.text)) AS chunk_id, u.doc_id, {ZONE.format("no")} AS zone_id, {TYPE.format("no")} AS record_type, u.text, no || '.txt' AS filename, source_path, '.txt' AS extension, chunk_index, chunk_count,
        CAST(length(u.text) AS INTEGER) AS char_len, sha1(u.text) AS content_hash, CAST(strlen(d.text) AS BIGINT) AS size_bytes, 'text' AS file_type, lang AS language, 384 AS dim,
        round(CAST(CAST(b[1] / sqrt(12 * list_inner_product(b, b)) AS FLOAT) AS DOUBLE), 6) AS v1
      FROM (SELECT *, list_transform(range(32), lambda i: CAST(CAST('0x' || substr(sha256(text), CAST(i * 2 + 1 AS INTEGER), 2) AS INTEGER) AS DOUBLE) / 255) AS b FROM u) u JOIN d ON d.doc_id = u.doc_id""",
    "doc_metadata": f"SELECT doc_id AS doc_no, sha1({PATH}) AS doc_id, doc_id || '.txt' AS filename, '.txt' AS extension, 'text' AS file_type, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents",
    "clean_basic": f"SELECT doc_id, {basic(f'''(chr(65279) || ' ' || chr(9) || replace(text, {NL}, ' ' || chr(13) || chr(10) || ' ' || chr(13)) || chr(0) || chr(7) || chr(127) || 'x' || chr(9) || ' ' || {NL} || {NL})''')} AS cleaned FROM documents",
    "normalize_prose": f"SELECT doc_id, {prose(f'''({FULL} || replace(text, '. ', '. 　 ') || ' e' || chr(769) || ' ' || chr(9) || ' ' || {NL} || ' z ' || chr(9))''')} AS cleaned FROM documents",
    "clean_code": f"SELECT doc_id, {squeeze(prose(f'''('  ' || {FULL} || replace(text, {NL}, '  ' || chr(9) || {NL} || '    ') || ' ' || {NL})''', code=True))} AS cleaned FROM documents",
    "clean_markdown": f"""SELECT page_id, regexp_replace({strip(f"array_to_string(list_transform(string_split(regexp_replace(replace(html, '</p>', '</p> ' || {NL} || {NL} || {NL} || {NL} || '<!-- a' || {NL} || 'b -->'), '(?s)<!--.*?-->', '', 'g'), {NL}), lambda q: regexp_replace(q, '{WS}+$', '')), {NL})")}, '\\n{{3,}}', {NL} || {NL}, 'g') AS cleaned FROM pages""",
    "pdf_header_footer": f"""WITH p AS (SELECT CAST(floor(doc_id / 5) AS BIGINT) AS f, doc_id % 5 AS n, string_split({strip(f"('Report ' || CAST(floor(doc_id / 5) AS BIGINT) || ' HEADER' || {NL} || text || {NL} || '  CONFIDENTIAL  ' || {NL})")}, {NL}) AS l FROM documents),
      e1 AS (SELECT f, x, count(*) AS c, min(n) AS a FROM (SELECT f, n, list_filter(list_transform(l, lambda q: {strip("q")}), lambda q: q <> '')[1] AS x FROM p) GROUP BY ALL),
      g1 AS (SELECT f, arg_min(x, (-c, a)) AS x, max(c) AS c, sum(c) AS pages FROM e1 GROUP BY f),
      p1 AS (SELECT p.f, n, CASE WHEN g.x IS NOT NULL AND list_contains(list_transform(l, lambda q: {strip("q")}), g.x) THEN list_filter(l, lambda v, k: k <> list_position(list_transform(l, lambda q: {strip("q")}), g.x)) ELSE l END AS l
        FROM p LEFT JOIN g1 g ON g.f = p.f AND pages >= 2 AND c >= greatest(2, ceil(0.65 * pages)) AND length(x) BETWEEN 3 AND 200),
      e2 AS (SELECT f, x, count(*) AS c, min(n) AS a FROM (SELECT f, n, list_filter(list_transform(l, lambda q: {strip("q")}), lambda q: q <> '')[-1] AS x FROM p1) WHERE x IS NOT NULL GROUP BY ALL),
      g2 AS (SELECT f, arg_min(x, (-c, a)) AS x, max(c) AS c, sum(c) AS pages FROM e2 GROUP BY f),
      p2 AS (SELECT p1.f, n, list_reverse(l) AS l, g.x FROM p1 LEFT JOIN g2 g ON g.f = p1.f AND pages >= 2 AND c >= greatest(2, ceil(0.65 * pages)) AND length(x) BETWEEN 3 AND 200),
      p3 AS (SELECT f, n, list_reverse(CASE WHEN x IS NOT NULL AND list_contains(list_transform(l, lambda q: {strip("q")}), x) THEN list_filter(l, lambda v, k: k <> list_position(list_transform(l, lambda q: {strip("q")}), x)) ELSE l END) AS l FROM p2)
      SELECT f AS doc_id, coalesce(string_agg(b, {NL} || {NL} ORDER BY n) FILTER (b <> ''), '') AS text FROM (SELECT f, n, {strip(f"array_to_string(l, {NL})")} AS b FROM p3) GROUP BY f""",
    "md_table": f"""SELECT n_regionkey AS region, '| nation\\|name | key number | x |' || {NL} || '| --- | --- | --- |' || {NL} || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |  |', {NL} ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""",
    "chunk_fixed_window": exploded(windows("t", 40, 8), f"(SELECT doc_id, {strip('text')} AS t FROM documents)"),
    "chunk_hybrid": f"WITH RECURSIVE d AS (SELECT doc_id, text AS t FROM documents), {hybrid_cte('d', 60, 10)} {exploded('c', 'h')}",
    "chunk_line": f"WITH RECURSIVE d AS (SELECT doc_id, text AS t FROM documents), {line_cte('d', 60, 10)} {exploded('c', 'h')}",
    "chunk_paragraph": exploded(paragraphs("t", 60, 10), f"(SELECT doc_id, replace(text, 'on.' || {NL}, 'on.' || {NL} || ' ' || {NL} || {NL}) AS t FROM documents)"),
    "semantic_breaks": f"""WITH s AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(string_split(regexp_replace({strip("text")}, '([。！？．.?!]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda q: q <> '') AS l FROM documents)),
      a AS (SELECT doc_id, pos, sentence, concat_ws(' ', lag(sentence) OVER w, sentence, lead(sentence) OVER w) AS around FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
      v AS (SELECT doc_id, pos, sentence, list_transform(range(32), lambda i: CAST(CAST('0x' || substr(sha256(around), CAST(i * 2 + 1 AS INTEGER), 2) AS INTEGER) AS DOUBLE)) AS v FROM a),
      n AS (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM v),
      d AS (SELECT doc_id, pos, sentence, 1 - list_inner_product(v, next) / sqrt(list_inner_product(v, v) * list_inner_product(next, next)) AS distance FROM n)
      SELECT doc_id, pos, sentence, round(distance, 6) AS distance, coalesce(distance > quantile_cont(distance, 0.9) OVER (PARTITION BY doc_id), false) AS is_break FROM d""",
    "dedup_exact": exploded(first_places("l"), f"(SELECT doc_id, {lines('text')} AS l FROM documents)"),
    "dedup_exact_corpus": f"SELECT min(doc_id) AS doc_id, sha1({strip('text')}) AS hash FROM documents GROUP BY sha1({strip('text')})",
    "dropped_duplicates": f"""WITH c AS (SELECT sha1({PATH}) AS doc_id, {paragraphs(prose(basic("text")), 60, 10)} AS c FROM documents)
      SELECT doc_id, CAST(len(c) AS INTEGER) AS n_chunks, CAST(len(list_distinct(c)) AS INTEGER) AS n_deduped, CAST(len(c) - len(list_distinct(c)) AS INTEGER) AS dropped_duplicates FROM c""",
    "fake_embed": """WITH b AS (SELECT doc_id, list_transform(range(32), lambda i: CAST(CAST('0x' || substr(sha256(text), CAST(i * 2 + 1 AS INTEGER), 2) AS INTEGER) AS DOUBLE) / 255) AS b FROM documents)
      SELECT doc_id, CAST(i AS INTEGER) AS i, round(b[i % 32 + 1] / sqrt(12 * list_inner_product(b, b)), 9) AS v FROM b, range(384) r(i)""",
    "align_dim": "SELECT vec_id, list_slice(CAST(embedding AS DOUBLE[]), 1, 48) AS cut, list_concat(CAST(embedding AS DOUBLE[]), list_transform(range(6), lambda i: CAST(0 AS DOUBLE))) AS filled FROM embeddings",
    "upsert_merge": f"""WITH {STORED}, n AS (SELECT CASE WHEN lang = 'fr' THEN 'new-' || chunk_id ELSE chunk_id END AS chunk_id, zone_id, record_type, 'v2 ' || text AS text FROM s WHERE lang IN ('en', 'fr'))
      SELECT coalesce(n.chunk_id, s.chunk_id) AS chunk_id, coalesce(n.zone_id, s.zone_id) AS zone_id, coalesce(n.record_type, s.record_type) AS record_type, sha1(coalesce(n.text, s.text)) AS text_hash, false AS is_deleted, coalesce(s.created_at, 2) AS created_at, CAST(CASE WHEN n.chunk_id IS NULL THEN 1 ELSE 2 END AS BIGINT) AS updated_at
      FROM s FULL JOIN n ON s.chunk_id = n.chunk_id AND s.zone_id = n.zone_id""",
    "upsert_last_wins": f"WITH {STORED} SELECT chunk_id, zone_id, record_type, sha1('2' || text) AS text_hash, is_deleted, created_at, updated_at FROM s",
    "soft_delete": f"WITH {STORED}, t AS (SELECT * REPLACE (lang = 'fr' AS is_deleted, CAST(CASE WHEN lang = 'fr' THEN 3 ELSE 1 END AS BIGINT) AS updated_at) FROM s) SELECT {SEEN} FROM t",
    "delete_by_doc": f"WITH {STORED}, t AS (SELECT * REPLACE (doc_id = '7' AS is_deleted, CAST(CASE WHEN doc_id = '7' THEN 4 ELSE 1 END AS BIGINT) AS updated_at) FROM s) SELECT {SEEN} FROM t",
    "zone_counts": f"WITH {STORED} SELECT zone_id, count(*) FILTER (lang <> 'fr' AND record_type = 'knowledge') AS record_count, count(*) FILTER (lang <> 'fr' AND record_type = 'baseline') AS baseline_count FROM s GROUP BY zone_id",
    "baseline": f"SELECT vec_id, {ZONE.format('label')} AS zone_id, embedding FROM embeddings WHERE vec_id % 10 = 0",
    "export_manifest": f"WITH {STORED} SELECT zone_id, 'spark' AS engine, 1 AS schema_version, count(*) FILTER (record_type = 'knowledge') AS record_count, count(*) FILTER (record_type = 'baseline') AS baseline_count FROM s GROUP BY zone_id",
    "ext_histogram": "SELECT CASE length(text) % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.gz' ELSE '' END AS extension, count(*) AS files FROM documents GROUP BY 1",
    "dense_topk": topk(COSINE, "DESC", "record_type = 'knowledge'"),
    "dense_topk_filtered": topk(COSINE, "DESC", "record_type = 'baseline' AND zone_id = 'ai'"),
    "dense_dot": topk("list_inner_product(e, q)", "DESC", "record_type = 'knowledge'"),
    "dense_euclid": topk("list_distance(e, q)", "ASC", "record_type = 'knowledge'"),
    "dense_overfetch": f"""WITH {VECTORS}, s AS (SELECT vec_id, CASE WHEN label < 3 THEN 'en' ELSE 'de' END AS language, {COSINE} AS score FROM v, q WHERE record_type = 'knowledge' ORDER BY score DESC, vec_id LIMIT 160),
      r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s WHERE language = 'de') SELECT vec_id, language, round(score, 6) AS score, rank FROM r WHERE rank <= 20""",
    "dense_batch": f"""WITH {VECTORS}, s AS (SELECT a.vec_id AS query_id, b.vec_id, b.zone_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.zone_id = b.zone_id),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, vec_id, zone_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
    "bm25_zone_stats": rf"WITH {DOCS} SELECT zone_id, count(*) AS n, round(avg(len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))), 6) AS avgdl FROM c GROUP BY zone_id",
    "bm25_okapi": f"WITH {OKAPI}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM f) SELECT query_id, zone_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "bm25_fts5": rf"""WITH {DOCS}, {ASKED},
      t AS (SELECT zone_id, chunk_id, record_type, list_concat(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+'), regexp_extract_all(strip_accents(lower(filename)), '[\p{{L}}\p{{N}}]+')) AS w FROM c),
      z AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
      p AS (SELECT zone_id, chunk_id, record_type, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT zone_id, chunk_id, record_type, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
      i AS (SELECT term, CASE WHEN ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM p, z GROUP BY term),
      qt AS (SELECT query_id, zone_id, term, count(*) AS qtf FROM (SELECT query_id, zone_id, unnest(regexp_extract_all(strip_accents(lower(query)), '[\p{{L}}\p{{N}}]+')) AS term FROM a) GROUP BY ALL),
      f AS (SELECT query_id, p.zone_id, chunk_id, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM p JOIN qt ON p.zone_id = qt.zone_id AND p.term = qt.term JOIN i ON i.term = p.term, z WHERE record_type = 'knowledge' GROUP BY ALL),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM f)
      SELECT query_id, zone_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "hybrid_search": f"""WITH {OKAPI}, sp AS (SELECT query_id, chunk_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM f) WHERE rank <= 50),
      cv AS (SELECT chunk_id, zone_id, list_transform(range(64), lambda i: CAST(CAST('0x' || substr(sha256(text), CAST((i % 32) * 2 + 1 AS INTEGER), 2) AS INTEGER) AS DOUBLE)) AS e FROM c WHERE record_type = 'knowledge'),
      qv AS (SELECT query_id, zone_id, list_transform(range(64), lambda i: CAST(CAST('0x' || substr(sha256(query), CAST((i % 32) * 2 + 1 AS INTEGER), 2) AS INTEGER) AS DOUBLE)) AS q FROM a),
      de AS (SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({COSINE}, 12) DESC, chunk_id) AS INTEGER) AS rank FROM cv JOIN qv ON cv.zone_id = qv.zone_id) WHERE rank <= 50),
      m AS (SELECT coalesce(de.query_id, sp.query_id) AS query_id, coalesce(de.chunk_id, sp.chunk_id) AS chunk_id, de.rank AS dense_rank, sp.rank AS sparse_rank FROM de FULL JOIN sp ON de.query_id = sp.query_id AND de.chunk_id = sp.chunk_id),
      w AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS score FROM m),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, chunk_id) AS INTEGER) AS rank FROM w)
      SELECT query_id, chunk_id, round(score, 9) AS score, dense_rank, sparse_rank, rank FROM r WHERE rank <= 10""",
    "rrf_fuse": """WITH d AS (SELECT label AS query_id, vec_id AS chunk_id, CAST(row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS INTEGER) AS rank FROM embeddings),
      s AS (SELECT label AS query_id, vec_id AS chunk_id, CAST(row_number() OVER (PARTITION BY label ORDER BY embedding[2] DESC, vec_id) AS INTEGER) AS rank FROM embeddings),
      m AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank FROM (SELECT * FROM d WHERE rank <= 30) d FULL JOIN (SELECT * FROM s WHERE rank <= 30) s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
      w AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS score FROM m),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, chunk_id) AS INTEGER) AS rank FROM w)
      SELECT query_id, chunk_id, round(score, 9) AS score, dense_rank, sparse_rank, rank FROM r WHERE rank <= 20""",
}
