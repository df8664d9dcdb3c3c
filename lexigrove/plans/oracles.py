"""The catalog's queries as SQL for DuckDB, which derives them anew from the same Parquet tables."""

from __future__ import annotations

from lexigrove.functions.text import STOPWORDS
from lexigrove.operators import ranking
from lexigrove.operators.index import BLOCK
from lexigrove.plans.catalog import FORWARD_LIMIT, HEAVY_KB, LOOKUP_TERM, RANK_WORD, RANK_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))


def normalized(c: str) -> str:
    """NFKC and lower case of a column, for the compatibility characters that its texts hold: DuckDB has no NFKC.

    Canonical composition is DuckDB's own; full-width forms, ligatures, blanks and the micro sign are mapped here.
    """
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    out = f"translate({c}, '{wide}µ', '{plain}μ')"
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = f"replace({out}, '{ligature}', '{letters}')"
    return f"lower(nfc_normalize({out}))"


def token_list(c: str) -> str:
    return f"list_filter(regexp_extract_all({normalized(c)}, '[\\p{{L}}\\p{{N}}]+'), lambda t: t NOT IN ({_STOP}))"


_CTES = {
    "docs": ("", f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, CAST(doc_id AS VARCHAR) AS paper_id, toks FROM (SELECT doc_id, {token_list('text')} AS toks FROM documents) WHERE len(toks) > 0"),
    "occ": ("docs", "SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS token FROM docs"),
    "lex": ("occ", "SELECT row_number() OVER (ORDER BY m) - 1 AS token_id, token FROM (SELECT token, min(doc_id * 10000000 + pos) AS m FROM occ GROUP BY token)"),
    "post": ("lex", "SELECT token_id, doc_id, CAST(count(*) AS INTEGER) AS freq, list(pos ORDER BY pos) AS positions FROM occ JOIN lex USING (token) GROUP BY ALL"),
    "df": ("post", "SELECT token_id, count(*) AS doc_freq FROM post GROUP BY token_id"),
    "th": ("df", "SELECT greatest(1, CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT)) AS th FROM docs"),
    "bmap": ("th", """SELECT token_id, 16 AS barrel_id, doc_freq FROM df, th WHERE doc_freq >= th UNION ALL
        SELECT token_id, CAST(least(floor(pow((row_number() OVER (ORDER BY doc_freq, token_id) - 1)::DOUBLE / count(*) OVER (), 0.6::DOUBLE) * 16), 15) AS INTEGER), doc_freq
        FROM df, th WHERE doc_freq < th"""),
    "blk": ("bmap", "SELECT token_id, CAST(4 + sum(12 + 4 * freq) AS BIGINT) AS length, count(*) AS doc_count, CAST(sum(freq) AS BIGINT) AS total_freq FROM post GROUP BY token_id"),
    "big": ("blk", f"SELECT token_id, length AS bytes, doc_count, 'heavy/token_' || token_id || '.bin' AS path, count(*) OVER () AS total_heavy FROM blk WHERE length >= {HEAVY_KB * 1024} ORDER BY bytes DESC, token_id LIMIT 50"),
}


def over_index(last: str, select: str) -> str:
    """``select`` with the chain of common tables up to ``last``."""
    chain, at = [], last
    while at:
        parent, sql = _CTES[at]
        chain.append(f"{at} AS MATERIALIZED ({sql})")
        at = parent
    return f"WITH {', '.join(reversed(chain))} {select}"


def _hits(words: list[str]) -> str:
    fields = " UNION ALL ".join(
        f"SELECT doc_id, {code} AS code, {rank} AS field_rank, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token FROM (SELECT doc_id, {token_list(c)} AS toks FROM documents)"
        for rank, (c, code) in enumerate((("title", ranking.TITLE), ("text", ranking.TEXT), ("venue", ranking.TAGS)))
    )
    idx = " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(words))
    names = ", ".join(f"'{w}'" for w in words)
    visible = "CASE WHEN NOT list_contains(f, 1) THEN f ELSE list_concat(f[1:list_position(f, 1) - 1], list_reverse(list_reverse(f)[1:list_position(list_reverse(f), 1) - 1])) END"
    return f"""WITH fields AS ({fields}),
    hits AS MATERIALIZED (SELECT CASE token {idx} END AS word_idx, doc_id, list(pos * 10 + code ORDER BY field_rank, pos) AS h FROM fields WHERE token IN ({names}) GROUP BY token, doc_id),
    seen AS (SELECT *, list_transform(h, lambda x: x % 10) AS f FROM hits),
    word AS (SELECT word_idx, doc_id, f, f[1] <> 1 OR f[-1] <> 1 AS relevant, least(len(f), 20) AS base, {visible} AS v FROM seen),
    scored AS (SELECT *, 50 * list_contains(v, 0)::INT + 30 * list_contains(v, 2)::INT + 20 * list_contains(v, 3)::INT + 30 * list_contains(v, 5)::INT AS bonus FROM word),
    depths AS (SELECT doc_id, coalesce(min(i) FILTER (WHERE NOT present), {len(words)}) AS depth, coalesce(min(i) FILTER (WHERE NOT rel), {len(words)}) AS rel_depth
      FROM (SELECT d.doc_id, i, count(s.doc_id) > 0 AS present, coalesce(bool_or(s.relevant), false) AS rel
            FROM (SELECT DISTINCT doc_id FROM hits) d, range({len(words)}) r(i) LEFT JOIN scored s ON s.doc_id = d.doc_id AND s.word_idx = r.i GROUP BY ALL) GROUP BY doc_id),
    mult AS (SELECT *, CASE WHEN rel_depth >= 2 THEN rel_depth * 100 WHEN depth >= 2 THEN depth * 2 ELSE 1 END AS m FROM depths)"""


def _multi(words: list[str], divide: bool) -> str:
    n = len(words)
    return f"""{_hits(words)}, each AS (SELECT doc_id, word_idx, (base + CASE WHEN m > 1 THEN 10 ELSE 0 END + bonus) * m AS s, depth, rel_depth FROM scored JOIN mult USING (doc_id)),
    total AS (SELECT doc_id, CAST(sum(s) AS DOUBLE) * CASE WHEN any_value(rel_depth) = {n} THEN 3.0::DOUBLE WHEN any_value(depth) = {n} THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END / {n if divide else 1}.0::DOUBLE AS score,
      min(word_idx) AS w, arg_min(s, word_idx) AS f FROM each GROUP BY doc_id)
    SELECT row_number() OVER (ORDER BY score DESC, w, f DESC, doc_id) AS rank, doc_id, score FROM total"""


def _blocks(select: str) -> str:
    areas = " UNION ALL ".join(f"SELECT record_id, '{a}' AS area, CAST(unnest(range(len({a}))) AS INTEGER) AS block_no, unnest({a}) AS b FROM papers" for a in ("abstract", "body_text", "back_matter"))
    return f"WITH blocks AS ({areas}) {select}"


def _spans(kind: str, select: str) -> str:
    return _blocks(f"SELECT {select} FROM (SELECT record_id, area, block_no, b.section AS section, CAST(unnest(range(len(b.{kind}))) AS INTEGER) AS span_no, unnest(b.{kind}) AS s FROM blocks) x")


def _entries(kind: str, select: str) -> str:
    return f"SELECT record_id, e.key AS entry_key, {select} FROM (SELECT record_id, unnest(map_entries({kind})) AS e FROM papers)"


_MIDDLE = "CASE WHEN len(a.middle) > 0 THEN array_to_string(list_transform(a.middle, lambda x: coalesce(x, '')), '|') END AS middle"
_AUTHORS = "(SELECT record_id, CAST(unnest(range(len(metadata.authors))) AS INTEGER) AS author_no, unnest(metadata.authors) AS a FROM papers)"
_BIB = "SELECT record_id, e.key AS entry_key, CAST(unnest(range(len(e.value.authors))) AS INTEGER) AS author_no, unnest(e.value.authors) AS a FROM (SELECT record_id, unnest(map_entries(bib_entries)) AS e FROM papers)"
_PLACE = "a.affiliation.laboratory AS laboratory, a.affiliation.institution AS institution, a.affiliation.location.addrLine AS \"addrLine\", a.affiliation.location.country AS country"
_WHOLE_SPAN = 'record_id, area, block_no, span_no, section, s."start" AS "start", s."end" AS "end", s.text AS text, s.ref_id AS ref_id'

_TRUE_LEN = """SELECT shard_id, token_id, CAST(4 + sum(12 + 4 * freq) AS BIGINT) AS true_length FROM
    (SELECT shard_id, token_id, doc_id, max(freq) AS freq FROM postings GROUP BY ALL) GROUP BY ALL"""
_UNITS = "SELECT shard_id, token_id, doc_id, max(freq) AS freq FROM postings GROUP BY ALL"
_OBJECTS = r"""SELECT DISTINCT json_extract_string(o, '$.paper_id') AS paper_id, CAST(json_extract(o, '$.block_no') AS INTEGER) AS block_no,
    json_extract_string(o, '$.section') AS section, json_extract_string(o, '$.text') AS text
    FROM (SELECT unnest(regexp_extract_all(content, '\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}')) AS o FROM paper_files)"""


def oracle_sql() -> dict[str, str]:
    o = over_index
    stats = "count(*) AS documents_indexed"
    return {
        "tokens": o("occ", "SELECT doc_id, pos, token FROM occ"),
        "doc_ids": o("docs", "SELECT doc_id, paper_id FROM docs"),
        "lexicon": o("lex", "SELECT token_id, token FROM lex"),
        "lexicon_stats": o("lex", f"SELECT {stats}, (SELECT count(*) FROM lex) AS unique_terms, CAST(sum(len(toks)) AS DOUBLE) / count(*) AS avg_doc_length FROM docs"),
        "forward_index": o("lex", "SELECT doc_id, CAST(count(*) AS INTEGER) AS token_count, string_agg(token_id::VARCHAR, ',' ORDER BY pos) AS token_ids FROM occ JOIN lex USING (token) GROUP BY doc_id"),
        "forward_limit": o("lex", f"SELECT doc_id, CAST(count(*) AS INTEGER) AS token_count, string_agg(token_id::VARCHAR, ',' ORDER BY pos) AS token_ids FROM occ JOIN lex USING (token) WHERE doc_id < {FORWARD_LIMIT} GROUP BY doc_id"),
        "forward_stats": o("lex", f"SELECT {stats}, (SELECT count(*) FROM documents) - count(*) AS docs_skipped, (SELECT count(*) FROM lex) AS unique_terms, CAST(sum(len(toks)) AS BIGINT) AS total_tokens, CAST(sum(len(toks)) AS DOUBLE) / count(*) AS avg_doc_length, count(*) AS doc_ids_recorded FROM docs"),
        "inverted_index": o("post", f"SELECT token_id, CAST(sum(count(*)) OVER (PARTITION BY token_id) AS BIGINT) AS doc_freq, doc_id // {BLOCK} AS block_no, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM post GROUP BY token_id, doc_id // {BLOCK}"),
        "doc_freq": o("df", "SELECT token_id, doc_freq FROM df"),
        "inverted_stats": o("post", "SELECT (SELECT count(*) FROM lex) AS unique_tokens, count(*) AS total_postings, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lex) AS avg_postings_per_token, (SELECT count(*) FROM docs) AS documents_indexed, CAST(sum(freq) AS BIGINT) AS total_token_occurrences FROM post"),
        "frequent_tokens": o("th", "SELECT token_id, doc_freq FROM df, th WHERE doc_freq >= th"),
        "barrel_map": o("bmap", "SELECT token_id, barrel_id FROM bmap"),
        "barrel_stats": o("bmap", "SELECT barrel_id, count(*) AS token_count, CAST(sum(doc_freq) AS BIGINT) AS postings FROM bmap GROUP BY barrel_id"),
        "most_frequent_tokens": o("df", "SELECT CAST(row_number() OVER (ORDER BY doc_freq DESC, token_id) AS INTEGER) AS rank, token_id, doc_freq FROM df ORDER BY rank LIMIT 100"),
        "frequency_barrel": o("bmap", "SELECT token_id, token FROM bmap JOIN lex USING (token_id) WHERE barrel_id = 16"),
        "postings": o("post", "SELECT token_id, doc_id, freq, array_to_string(positions, ',') AS positions FROM post"),
        "barrel_build_stats": o("bmap", "SELECT (SELECT count(*) FROM docs) AS documents_indexed, count(*) AS tokens_assigned, count(*) AS unique_tokens_seen FROM bmap"),
        "postings_index": o("blk", "SELECT token_id, doc_count, total_freq FROM blk"),
        "postings_offsets": o("blk", "SELECT token_id, CAST(coalesce(sum(length) OVER (ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", length FROM blk"),
        "heavy_tokens": o("big", "SELECT token_id, bytes FROM big"),
        "heavy_postings": o("big", "SELECT token_id, doc_id, freq FROM post SEMI JOIN big USING (token_id)"),
        "heavy_manifest": o("big", "SELECT * FROM big"),
        "doc_only_postings": o("post", "SELECT token_id, doc_id, freq FROM post"),
        "term_lookup": o("post", f"SELECT '{LOOKUP_TERM}' AS term, token_id, count(*) OVER () AS doc_count, doc_id, freq FROM post JOIN lex USING (token_id) WHERE token = '{LOOKUP_TERM}' ORDER BY doc_id LIMIT 10"),
        "barrel_analysis": o("bmap", "SELECT barrel_id, count(*) AS token_count, CAST(sum(b) AS BIGINT) AS size_bytes, CAST(sum(b) AS DOUBLE) / count(*) AS avg_bytes_per_token FROM bmap JOIN (SELECT token_id, sum(16 + 4 * freq) AS b FROM post GROUP BY token_id) USING (token_id) GROUP BY barrel_id"),
        "block_stats": o("blk", """, s AS (SELECT length, row_number() OVER (ORDER BY length, token_id) AS i, count(*) OVER () AS n FROM blk),
            q AS (SELECT greatest(1, least((95 * (any_value(n) + 1)) // 100, any_value(n) - 1)) AS j, any_value(n) AS n FROM s)
            SELECT count(*) AS tokens, CAST(sum(length) AS BIGINT) AS total_bytes, CAST(sum(length) AS DOUBLE) / count(*) AS avg_bytes, CAST(median(length) AS DOUBLE) AS median_bytes,
            CAST(max(length) FILTER (WHERE i = q.j) * (100 - (95 * (any_value(q.n) + 1) - 100 * any_value(q.j))) + max(length) FILTER (WHERE i = q.j + 1) * (95 * (any_value(q.n) + 1) - 100 * any_value(q.j)) AS DOUBLE) / 100 AS p95_bytes,
            max(length) AS max_bytes FROM s, q"""),
        "largest_blocks": o("blk", "SELECT CAST(row_number() OVER (ORDER BY length DESC, token_id) AS INTEGER) AS rank, token_id, length AS bytes FROM blk ORDER BY rank LIMIT 10"),
        "artifact_sizes": o("bmap", """, v AS (SELECT count(*) AS v, sum(8 + strlen(token)) AS lex FROM lex), p AS (SELECT count(*) AS p, sum(12 + 4 * freq) AS blk FROM post), d AS (SELECT sum(8 + 4 * len(toks)) AS fwd FROM docs)
            SELECT 'lexicon.bin' AS artifact, CAST(4 + lex AS BIGINT) AS bytes FROM v UNION ALL SELECT 'forward_index.bin', CAST(4 + fwd AS BIGINT) FROM d
            UNION ALL SELECT 'inverted_index.bin', CAST(4 + 8 * v + 4 * p AS BIGINT) FROM v, p UNION ALL SELECT 'barrel_mapping.bin', 12 + 8 * v FROM v
            UNION ALL SELECT 'postings_index.bin', CAST(4 * v + blk AS BIGINT) FROM v, p UNION ALL SELECT 'postings_offsets.bin', 4 + 20 * v FROM v
            UNION ALL SELECT CASE WHEN barrel_id = 16 THEN 'barrel_freq.bin' ELSE 'barrel_' || lpad(barrel_id::VARCHAR, 2, '0') || '.bin' END, CAST(sum(16 + 4 * freq) AS BIGINT) FROM bmap JOIN post USING (token_id) GROUP BY barrel_id"""),
        "memory_estimate": o("lex", "SELECT 120 * count(*) AS offsets_bytes, 60 * count(*) AS lexicon_bytes, 180 * count(*) AS total_bytes FROM lex"),
        "validate_postings": o("post", "SELECT CAST(-1 AS BIGINT) AS token_id, 'compared' AS problem, 2 * count(*) AS rows FROM post"),
        "is_relevant": f"{_hits([RANK_WORD])} SELECT doc_id, relevant FROM scored",
        "rank_single": f"{_hits([RANK_WORD])} SELECT row_number() OVER (ORDER BY base + bonus DESC, doc_id) AS rank, doc_id, CAST(base + bonus AS DOUBLE) AS score FROM scored",
        "intersections": f"{_hits(RANK_WORDS)} SELECT CAST(i AS INTEGER) AS level, doc_id, rel_depth > i AS relevant FROM depths, range({len(RANK_WORDS)}) r(i) WHERE depth > i",
        "intersection_multiplier": f"{_hits(RANK_WORDS)} SELECT doc_id, CAST(m AS INTEGER) AS multiplier FROM mult",
        "rank_multi": _multi(RANK_WORDS, True),
        "rank_multi_raw": _multi(RANK_WORDS, False),
        "rank_query": _multi(RANK_WORDS, True),
        # General operators
        "p2_found": _spans("ref_spans", "x.record_id, area, block_no, span_no, CASE WHEN list_contains(map_keys((SELECT ref_entries FROM papers p WHERE p.record_id = x.record_id)), s.ref_id) THEN s.ref_id ELSE '' END AS entry_key"),
        "p2_records": "SELECT record_id, source_tag, paper_id, metadata.title AS title FROM papers",
        "p2_blocks": _blocks("SELECT record_id, area, block_no, b.section AS section, b.text AS text FROM blocks"),
        "p2_ref_spans": _spans("ref_spans", "record_id, area, block_no, span_no, section, s.\"start\" AS \"start\", s.ref_id AS ref_id"),
        "p2_cite_spans": _spans("cite_spans", "record_id, area, block_no, span_no, section, s.\"start\" AS \"start\", s.ref_id AS ref_id"),
        "p2_ref_entries": "SELECT record_id, e.key AS entry_key, e.value.text AS text, e.value.type AS type FROM (SELECT record_id, unnest(map_entries(ref_entries)) AS e FROM papers)",
        "p2_bib_entries": "SELECT record_id, e.key AS entry_key, e.value.title AS title, e.value.year AS year, e.value.venue AS venue FROM (SELECT record_id, unnest(map_entries(bib_entries)) AS e FROM papers)",
        "p2_whole_records": "SELECT record_id, source_tag, paper_id, metadata.title AS title, ingested_at FROM papers",
        "p2_whole_ref_spans": _spans("ref_spans", _WHOLE_SPAN),
        "p2_whole_cite_spans": _spans("cite_spans", _WHOLE_SPAN),
        "p2_whole_ref_entries": _entries("ref_entries", "e.value.text AS text, e.value.latex AS latex, e.value.type AS type"),
        "p2_whole_bib_entries": _entries("bib_entries", "e.value.ref_id AS ref_id, e.value.title AS title, e.value.year AS year, e.value.venue AS venue, e.value.volume AS volume, e.value.issn AS issn, e.value.pages AS pages"),
        "p2_authors": f"SELECT record_id, author_no, a.first AS first, {_MIDDLE}, a.last AS last, a.suffix AS suffix, {_PLACE}, a.email AS email FROM {_AUTHORS}",
        "p2_bib_authors": f"SELECT record_id, entry_key, author_no, a.first AS first, {_MIDDLE}, a.last AS last, a.suffix AS suffix FROM ({_BIB})",
        "p2_affiliations": f"SELECT record_id, author_no, {_PLACE} FROM {_AUTHORS} WHERE a.affiliation IS NOT NULL",
        "p3_found": f"SELECT DISTINCT o.shard_id, o.token_id FROM postings_offsets o LEFT JOIN ({_TRUE_LEN}) t USING (shard_id, token_id) WHERE o.length IS DISTINCT FROM coalesce(true_length, 4)",
        "p3_lengths": _TRUE_LEN,
        "p3_summary": f"""SELECT shard_id, token_id, CAST(sum(w) AS BIGINT) AS n, count(freq) AS distinct_values, CAST(sum(w * freq) AS BIGINT) AS total, arg_max(freq, w * 1000000000 - freq) AS mode
            FROM (SELECT shard_id, token_id, freq, count(*) AS w FROM ({_UNITS}) GROUP BY ALL) GROUP BY ALL""",
        "p3_percentiles": f"SELECT shard_id, token_id, quantile_disc(freq, 0.5) AS p50, quantile_disc(freq, 0.9) AS p90 FROM ({_UNITS}) GROUP BY ALL",
        "p7_found": f"SELECT DISTINCT paper_id, block_no FROM ({_OBJECTS})",
        "p7_records": _OBJECTS,
        "p7_totals": f"SELECT count(*) AS records FROM (SELECT DISTINCT paper_id, block_no FROM ({_OBJECTS}))",
    }
