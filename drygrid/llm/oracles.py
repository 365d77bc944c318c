"""DuckDB SQL for the rows of those queries that SQL can express."""

from drygrid.llm.filter_audit import OP13_SQL
from drygrid.llm.url_filter import OP10_SQL

SPACE = r"[\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}'), lambda x: x <> '')"


def _shingles(table: str, key: str, out: str) -> str:
    """Distinct runs of five lower-cased words, all words of a shorter text as one; texts without words give no row."""
    return f"""{out} AS (SELECT DISTINCT {key}, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT {key}, ws, UNNEST(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM (SELECT {key}, {_words(LOWER)} AS ws FROM {table}) WHERE len(ws) > 0))"""


OP6_SQL = f"""
WITH RECURSIVE {_shingles("documents", "doc_id", "sh")},
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) r ON r.doc_id = d.doc_id
"""

OP8_SQL = f"""
WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
words AS (SELECT doc_id, UNNEST(range(1, len(ws) + 1)) AS i, UNNEST(ws) AS word FROM w),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, UNNEST(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
marked AS (SELECT words.*, max(repeated.i) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS UNBOUNDED PRECEDING) AS last FROM words LEFT JOIN repeated ON repeated.doc_id = words.doc_id AND repeated.i = words.i),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (last IS NOT NULL AND i - last < 35) AS n_removed,
  string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR i - last >= 35) AS text FROM marked GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP9_SQL = f"""
WITH {_shingles("documents", "doc_id", "sh")}, {_shingles("benchmark", "item_id", "items")},
n AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY 1),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM sh JOIN items ON items.s = sh.s GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM shared JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

ORACLE_SQL = {"op6_near_duplicates": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op9_decontamination": OP9_SQL, "op10_url_filter": OP10_SQL, "op13_filter_audit": OP13_SQL}
