"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_extract, language_id, license_scan, line_dedup, packing, rans_io, simhash, topk, toxicity
from .common import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_io.token_output(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_license_scan, op2_language_id, op3_decontamination, op4_packing, op5_exact_topk, op6_html_extraction, op7_simhash, op8_toxicity, op9_token_output, op10_line_dedup, pipeline)
    return {f.__name__: f for f in own}


_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP10 = r"""
WITH l AS (SELECT doc_id, i - 1 AS i, lines[i] AS line, CAST(len(regexp_extract_all(lines[i], '\S+')) AS BIGINT) AS w
           FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
                 FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM l),
runs AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY 1, 2
         UNION
         SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY 1, 3),
texts AS (SELECT r.doc_id, r.s, r.e, string_agg(l.line, chr(10) ORDER BY l.i) AS t
          FROM runs r JOIN l ON r.doc_id = l.doc_id AND l.i BETWEEN r.s AND r.e GROUP BY 1, 2, 3),
heads AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM texts),
gone AS (SELECT DISTINCT h.doc_id, l.i FROM heads h JOIN l ON h.doc_id = l.doc_id AND l.i BETWEEN h.s AND h.e WHERE h.k > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INTEGER) AS n_lines,
       CAST(coalesce(n.n, 0) AS INTEGER) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_WORDS = r"string_split(trim(regexp_replace(regexp_replace(regexp_replace(text, '([0-9])[.,]([0-9])', '\1\2', 'g'), '([0-9])[.,]([0-9])', '\1\2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
_CANON = """list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i][1] BETWEEN '0' AND '9' THEN '<number>'
 WHEN lower(w[i]) IN (%s) AND i > 1 AND w[i - 1][1] BETWEEN '0' AND '9' THEN '<unit>'
 WHEN lower(w[i][1]) <> w[i][1] THEN '<name>' ELSE lower(w[i]) END)""" % ", ".join(f"'{u}'" for u in decontamination.UNITS)


def _canonical_sql(name: str, key: str, table: str) -> str:
    """Tokens ``t`` and kinds ``c``; neighbouring names are one token."""
    return f"""{name}1 AS (SELECT {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL),
{name}2 AS (SELECT *, {_CANON} AS k FROM {name}1),
{name}3 AS (SELECT *, list_append(list_filter(range(1, len(w) + 1), lambda i: NOT (k[i] = '<name>' AND i > 1 AND k[i - 1] = '<name>')), len(w) + 1) AS o FROM {name}2),
{name} AS (SELECT {key}, list_transform(range(1, len(o)), lambda i: CASE WHEN k[o[i]] = '<name>' THEN lower(array_to_string(w[o[i] : o[i + 1] - 1], ' ')) ELSE lower(w[o[i]]) END) AS t,
 list_transform(range(1, len(o)), lambda i: k[o[i]]) AS c FROM {name}3)"""


_OP3 = f"""
WITH {_canonical_sql('it', 'item_id', 'benchmark')},
ic AS (SELECT item_id, t, c, least(5, len(t)) AS n FROM it WHERE t[1] <> ''),
iw AS (SELECT item_id, t, c, n, len(c) - n + 1 AS windows, unnest(range(1, len(c) - n + 2)) AS q FROM ic),
ix AS (SELECT *, array_to_string(c[q : q + n - 1], ' ') AS h FROM iw WHERE len(list_filter(c[q : q + n - 1], lambda x: x NOT IN ('<number>', '<unit>', '<name>'))) > 0),
{_canonical_sql('dc', 'doc_id', 'documents')},
dw AS (SELECT doc_id, t, c, s.n AS n, unnest(range(1, len(c) - s.n + 2)) AS p FROM dc, (SELECT DISTINCT n FROM ix) s),
hit AS (SELECT DISTINCT w.doc_id, ix.item_id, ix.windows, p - q AS d FROM (SELECT doc_id, n, p, array_to_string(c[p : p + n - 1], ' ') AS h FROM dw) w JOIN ix ON w.h = ix.h AND w.n = ix.n),
seg AS (SELECT hit.doc_id, hit.item_id, windows, d, ic.t, ic.c, ic.n, list_transform(range(1, len(ic.c) + 1), lambda j: CASE WHEN j + d >= 1 AND dc.c[j + d] = ic.c[j] THEN dc.t[j + d] END) AS g
        FROM hit JOIN ic USING (item_id) JOIN dc ON hit.doc_id = dc.doc_id),
ok AS (SELECT *, list_filter(range(1, windows + 1), lambda q: len(list_filter(g[q : q + n - 1], lambda x: x IS NULL)) = 0) AS qs FROM seg),
sim AS (SELECT doc_id, item_id, any_value(windows) AS windows, len(list_distinct(flatten(list(qs)))) AS k, max(len(qs)) AS most FROM ok GROUP BY 1, 2),
pl AS (SELECT doc_id, item_id, d, c[j] AS kind, j, len(c) AS m, t[j] AS it, g[j] AS dt, len(qs) AS nq, len(list_filter(qs, lambda q: q <= j AND j < q + n)) > 0 AS held
       FROM (SELECT *, unnest(range(1, len(c) + 1)) AS j FROM ok) WHERE c[j] IN ('<number>', '<unit>', '<name>') AND g[j] IS NOT NULL),
rd AS (SELECT pl.*, dense_rank() OVER (PARTITION BY pl.doc_id, pl.item_id, j ORDER BY held DESC, nq DESC) AS best FROM pl JOIN sim ON pl.doc_id = sim.doc_id AND pl.item_id = sim.item_id WHERE held OR nq = most),
sl AS (SELECT DISTINCT doc_id, item_id, kind, CASE WHEN m > 1 AND j = 1 THEN string_split(it, ' ')[-1] WHEN m > 1 AND j = m THEN string_split(it, ' ')[1] ELSE it END AS item,
       CASE WHEN m > 1 AND j = 1 THEN string_split(dt, ' ')[-1] WHEN m > 1 AND j = m THEN string_split(dt, ' ')[1] ELSE dt END AS doc FROM rd WHERE best = 1),
sn AS (SELECT doc_id, item_id, count(*) AS n, count(DISTINCT kind || ' ' || item) AS own FROM sl GROUP BY 1, 2),
r AS (SELECT sim.doc_id, sim.item_id, round(k / windows, 6) AS similarity, round(coalesce(own / sn.n, 1.0), 6) AS slot_consistency, CAST(coalesce(sn.n, 0) AS INTEGER) AS n_slots
      FROM sim LEFT JOIN sn ON sim.doc_id = sn.doc_id AND sim.item_id = sn.item_id)
SELECT * FROM r WHERE similarity >= 0.8 AND slot_consistency >= 0.8
"""


def oracle_sql() -> dict[str, str]:
    """Licence scan, models, tokenizers, wrappers and 64-bit hashes have no counterpart in SQL."""
    return {"op3_decontamination": _OP3, "op5_exact_topk": _OP5, "op10_line_dedup": _OP10}
