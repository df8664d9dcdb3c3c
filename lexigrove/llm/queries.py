"""Queries of the text operators, and SQL for DuckDB where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import canonical, distinctive, frequency, leakage, packing, reading, scans
from lexigrove.plans.oracles import normalized, token_list
from lexigrove.sources.tables import spread, table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: spread(table(s, d, "documents").select("doc_id", "text"))
    return {
        "p1_found": lambda s, d: canonical.look_alike_pairs(docs(s, d)),
        "p1_canonical": lambda s, d: canonical.canonical(docs(s, d), to="text"),
        "p1_stable": lambda s, d: canonical.unstable(docs(s, d)),
        "p1_classes": lambda s, d: canonical.look_alike_classes(docs(s, d)),
        "p4_found": lambda s, d: frequency.marked_terms(docs(s, d)).where("mark IS NOT NULL").select("token", "mark"),
        "p4_terms": lambda s, d: frequency.marked_terms(docs(s, d)),
        "p5_found": lambda s, d: scans.cases(_repaired(s, d)),
        "p5_repaired": lambda s, d: _repaired(s, d).select("doc_id", "text"),
        "p6_found": lambda s, d: distinctive.Scores(docs(s, d)).most_weighted().select("doc_id", "token"),
        "p6_terms": lambda s, d: distinctive.distinctive_terms(docs(s, d)).select("doc_id", "token", "tf", "df", F.col("elite").between(0, 1).alias("scored")),
        "p6_agreement": lambda s, d: distinctive.Scores(docs(s, d)).agreement(),
        "p6_scores": lambda s, d: distinctive.distinctive_terms(docs(s, d)),
        "p8_packing": lambda s, d: packing.pack_documents(docs(s, d), table(s, d, "containers")),
        "p8_check": lambda s, d: packing.faults(packing.pack_documents(docs(s, d), table(s, d, "containers")), table(s, d, "containers")),
        "p9_found": lambda s, d: leakage.leaks(docs(s, d), table(s, d, "eval_items")).select("doc_id", "item_id").distinct(),
        "p9_passages": lambda s, d: leakage.leaks(docs(s, d), table(s, d, "eval_items")).select("doc_id", "item_id", "start", "end"),
        "p9_runs": lambda s, d: leakage.leaks(docs(s, d), table(s, d, "eval_items")).select("doc_id", "item_id", "first_word", "last_word"),
        "p10_found": lambda s, d: _bands(s, d).where(F.col("english") & F.col("band").isin(1, reading.BANDS)).select("doc_id", "band"),
        "p10_bands": _bands,
    }


def _bands(s: SparkSession, d: str) -> DataFrame:
    return reading.reading_bands(spread(table(s, d, "documents").select("doc_id", "text", "lang")), table(s, d, "reading_labels"))


def _repaired(s: SparkSession, d: str) -> DataFrame:
    return scans.repair_scans(spread(table(s, d, "documents").select("doc_id", "text", "title", "venue")))


_OCC = f"occ AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({token_list('text')}) AS token FROM documents) GROUP BY ALL)"
_TERMS = f"""WITH {_OCC} SELECT token, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS documents,
    CASE WHEN count(*) < 3 THEN 'rare' WHEN count(*) * 20 >= (SELECT count(*) FROM documents) THEN 'common' END AS mark FROM occ GROUP BY token"""


def _runs(t: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, i, array_to_string(w[i:i + 11], ' ') AS run FROM
        (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, regexp_extract_all({normalized('text')}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {t}))"""


_SHARED = f"SELECT DISTINCT doc_id, item_id, d.i AS i FROM ({_runs('documents', 'doc_id')}) d JOIN ({_runs('eval_items', 'item_id')}) e USING (run)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_stable": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS changed FROM documents",
        "p4_found": f"SELECT token, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
        "p4_terms": _TERMS,
        "p6_found": f"""WITH {_OCC}, d AS (SELECT token, count(*) AS df FROM occ GROUP BY token)
            SELECT doc_id, token FROM occ JOIN d USING (token) WHERE df >= 2
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln((SELECT count(*) FROM documents) / df), 6) DESC, token) = 1""",
        "p6_terms": f"WITH {_OCC}, d AS (SELECT token, count(*) AS df FROM occ GROUP BY token) SELECT doc_id, token, CAST(tf AS INTEGER) AS tf, df, true AS scored FROM occ JOIN d USING (token)",
        "p8_check": "SELECT container_kind, (SELECT count(*) FROM documents) AS texts, CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS divided_in_vain, CAST(0 AS BIGINT) AS gaps FROM containers WHERE capacity_tokens > 0",
        "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_SHARED})",
        "p9_runs": f"""SELECT doc_id, item_id, CAST(min(i) - 1 AS INTEGER) AS first_word, CAST(max(i) + 10 AS INTEGER) AS last_word
            FROM (SELECT *, sum(CASE WHEN i - before <= 11 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS stretch
                  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS before FROM ({_SHARED}))) GROUP BY doc_id, item_id, stretch""",
    }
