"""DuckDB SQL for the rows of those queries that SQL can express, over whole tables.

Each states its query's contract in the plainest way (all windows, all pairs with a common shingle), which a
database takes at the sizes of tests; the operators get the same rows by their own methods.
"""

from __future__ import annotations

import string

#: Words of the contracts: runs without ASCII white space, and runs of digits, small letters and whatever isn't ASCII.
_SPACE_WORDS = r"[^\x20\x09-\x0D]+"
_PLAIN_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str, fold: bool) -> str:
    text = "coalesce(text, '')"
    if fold:
        text = f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"regexp_extract_all({text}, '{pattern}')"


def _grams(n: str) -> str:
    """Each window of n words, joined by spaces (which no word holds)."""
    return f"[array_to_string(w[s : s + {n} - 1], ' ') for s in range(1, len(w) - {n} + 2)]"


OP5 = f"""
WITH d AS (SELECT doc_id, {_words(_PLAIN_WORDS, True)} AS w FROM documents),
i AS (SELECT item_id, {_words(_PLAIN_WORDS, True)} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, m, unnest({_grams("m")}) AS g FROM sized),
places AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS s, unnest({_grams("m")}) AS g
       FROM d, (SELECT DISTINCT m FROM wanted) WHERE len(w) >= m),
found AS (SELECT doc_id, item_id, m, s FROM places JOIN wanted USING (m, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_words(_SPACE_WORDS, False)} AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS s, unnest({_grams("13")}) AS g FROM d WHERE len(w) >= 13),
earliest AS (SELECT g, min(doc_id) AS f FROM places GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM places JOIN earliest USING (g) WHERE f < doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_SPACE_WORDS, True)} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN {_grams("4")} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common.n >= 80 * (p.n + q.n - common.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
