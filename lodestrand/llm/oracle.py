"""SQL forms of the queries, for those that SQL can express over whole tables.

The others have none: a conditional random field, belief propagation, a suffix automaton, lexers, similarity
hashes, byte-pair encoding, online packing and recomposition of characters aren't SQL. They are tested against
brute force, exact parsers, enumeration, round trips or held-out sentences (tests/llm).
"""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": """WITH RECURSIVE ties AS (SELECT DISTINCT lower(trim(repository_id)) AS r, lower(trim(dedup_cluster)) AS c FROM documents WHERE trim(repository_id) <> '' AND trim(dedup_cluster) <> ''),
          edges AS (SELECT DISTINCT a.r AS u, b.r AS v FROM ties a JOIN ties b ON a.c = b.c WHERE a.r <> b.r),
          reach AS (SELECT u, v FROM edges UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u)
          SELECT u AS repository_id, least(u, min(v)) AS family_id FROM reach GROUP BY u""",
    }
