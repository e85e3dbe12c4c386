"""SQL for the numbered operators whose results SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .url_filter import RULES, SOFT, STRICT

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(links: str, nodes: str) -> str:
    """CTEs ``part`` (id, component) over a table of directed links (src, dst) and one of nodes (id)."""
    return f"""reach AS (SELECT id AS src, id AS dst FROM {nodes} UNION SELECT reach.src, l.dst FROM reach JOIN {links} l ON l.src = reach.dst),
         part AS (SELECT src AS id, min(dst) AS component FROM reach GROUP BY 1)"""


def near_duplicates() -> str:
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
         u AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
         s AS MATERIALIZED (SELECT doc_id, g, 1 + ln(count(*)) AS x FROM u GROUP BY 1, 2),
         n AS MATERIALIZED (SELECT doc_id, count(*) AS n, sum(x) AS total FROM s GROUP BY 1),
         shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.x, b.x AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id),
         pair AS MATERIALIZED (SELECT a, b, na.total - sum(x) AS only_x, nb.total - sum(y) AS only_y FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
                   GROUP BY a, b, na.total, nb.total HAVING sum(least(x / na.total, y / nb.total)) >= 0.8 - 1e-6),
         run AS (SELECT a, b, x, y, only_x + sum(x) OVER (PARTITION BY a, b ORDER BY x / y DESC ROWS UNBOUNDED PRECEDING) AS over_x,
                        only_y, sum(y) OVER (PARTITION BY a, b ORDER BY x / y DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_y FROM shared JOIN pair USING (a, b)),
         hit AS MATERIALIZED (SELECT a, b FROM run GROUP BY a, b HAVING sum(1 / (over_x / x + (only_y + coalesce(after_y, 0)) / y)) >= 0.8 - 1e-9),
         link AS MATERIALIZED (SELECT a AS src, b AS dst FROM hit UNION ALL SELECT b, a FROM hit),
         node AS (SELECT DISTINCT src AS id FROM link), {_components("link", "node")}
    SELECT d.doc_id, coalesce(component, d.doc_id) AS class_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN part ON part.id = d.doc_id"""


def urls() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules)
    stands = "regexp_matches({}, '(^|[^0-9a-z])' || term || '($|[^0-9a-z])')"
    return f"""
    WITH term AS (SELECT unnest({list(STRICT)}) AS term, true AS strict UNION ALL SELECT unnest({list(SOFT)}), false),
         u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN {LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} ELSE '' END AS host,
                      CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path, {LOWER.format("coalesce(url, '')")} AS low FROM pages),
         h AS (SELECT page_id, host, path, count(term) FILTER (strict) AS strict_hits, count(term) FILTER (NOT strict) AS soft_hits
               FROM u LEFT JOIN term ON {stands.format("low")} GROUP BY page_id, host, path)
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict, CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits FROM h"""


def vectors() -> str:
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
         fine AS MATERIALIZED (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
         link AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
         node AS (SELECT DISTINCT src AS id FROM link), {_components("link", "node")}, n AS (SELECT src, count(*) AS n FROM link GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN n ON n.src = vec_id LEFT JOIN part ON part.id = vec_id"""


def merkle() -> str:
    framed = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(framed, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    nibbles = list(range(16))  # CRC-32 by half bytes: what remains of each under the reversed polynomial
    for _ in range(4):
        nibbles = [n >> 1 ^ (0xEDB88320 if n & 1 else 0) for n in nibbles]
    half = lambda c, b: f"xor(({c}) >> 4, {nibbles}[xor(({c}) & 15, {b}) + 1])"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, d: {half(half('c', 'd & 15'), 'd >> 4')}), 4294967295)"
    # the levels of all trees, the trees' roots with their proofs, then the same over the roots
    levels = lambda name, start: f"""{name} AS (SELECT tree, 0 AS level, place, size, digest FROM {start} UNION ALL
              SELECT tree, level + 1, place // 3, (min(size) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE size > 1 GROUP BY tree, level, place // 3)"""  # noqa: E731
    steps = lambda name, start, tree: f"""SELECT l.{tree}, l.place, u.level, coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (u.place < l.place // pow3), '') AS before,
              coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (u.place > l.place // pow3), '') AS after
              FROM (SELECT *, CAST(pow(3, k) AS BIGINT) AS pow3 FROM {start}, range(0, 39) AS r(k)) l
              JOIN {name} u ON u.tree = l.tree AND u.level = l.k AND u.size > 1 AND u.place // 3 = l.place // (3 * pow3) GROUP BY ALL"""  # noqa: E731
    return f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {leaf("text")} AS digest, {leaf(f"CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS tampered,
              dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, source FROM documents),
         leaves AS MATERIALIZED (SELECT doc_id, tampered, digest, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM d),
         {levels("low", "leaves")},
         subroots AS MATERIALIZED (SELECT 0 AS tree, tree AS place, digest, count(*) OVER () AS size FROM low WHERE size = 1),
         {levels("high", "subroots")},
         step AS (SELECT l.tree, l.place, 0 AS part, level, before, after FROM ({steps("low", "leaves", "tree")}) l UNION ALL
                  SELECT v.tree, v.place, 1, s.level, s.before, s.after FROM ({steps("high", "subroots", "tree")}) s JOIN leaves v ON v.tree = s.place),
         proof AS MATERIALIZED (SELECT tree, place, list(struct_pack(b := before, a := after) ORDER BY part, level) AS steps FROM step GROUP BY 1, 2),
         fold AS (SELECT tree, place, tampered AS digest, 0 AS done FROM leaves UNION ALL
                  SELECT f.tree, f.place, sha256(p.steps[done + 1].b || f.digest || p.steps[done + 1].a), done + 1 FROM fold f JOIN proof p USING (tree, place) WHERE done < len(p.steps))
    SELECT v.doc_id, v.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(list_aggregate(list_transform(p.steps, lambda x: x.b || x.a), 'string_agg', ''), '')) AS proof_sha256,
           f.digest AS folded_root, f.digest = r.digest AS verified
    FROM leaves v JOIN subroots s ON s.place = v.tree CROSS JOIN (SELECT digest FROM high WHERE size = 1) r LEFT JOIN proof p ON p.tree = v.tree AND p.place = v.place
    JOIN fold f ON f.tree = v.tree AND f.place = v.place AND f.done = coalesce(len(p.steps), 0)"""


SQL = {"op2_probminhash": near_duplicates(), "op7_url_vocabulary": urls(), "op10_vector_cells": vectors(), "op12_merkle_manifest": merkle()}
