"""SQL of the text queries that SQL can express, on the whole tables."""

from __future__ import annotations

from breakweave.llm.mixing import LARGEST_MEAN, TERMS
from breakweave.llm.url_trust import LINKED, LOWER, UPPER, URL

MIXING = f"""
WITH RECURSIVE sized AS (
  SELECT coalesce(source, '') AS s, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY 1
), total AS (
  SELECT sum(pow(size, 0.5)) AS w, sum(size) AS n FROM sized WHERE size > 0
), rate AS (
  SELECT s, CASE WHEN size > 0 THEN pow(size, 0.5) / w * n / size ELSE 0.0 END AS rate FROM sized, total
), split AS (
  SELECT s, rate, CAST(greatest(ceil(rate / {LARGEST_MEAN}), 1) AS BIGINT) AS parts, rate / greatest(ceil(rate / {LARGEST_MEAN}), 1) AS mean FROM rate WHERE rate > 0
), cdf AS (
  SELECT s, 0 AS k, mean, exp(-mean) AS p, exp(-mean) AS c FROM split
  UNION ALL
  SELECT s, k + 1, mean, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < {TERMS - 1}
), lists AS (
  SELECT s, list(c) AS cs FROM cdf GROUP BY s
), draws AS (
  SELECT d.*, rate, cs, unnest(range(1, parts + 1)) AS part FROM documents d JOIN split ON coalesce(d.source, '') = split.s JOIN lists ON lists.s = split.s
), counted AS (
  SELECT doc_id, text, lang, source, n_chars, rate,
    len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || part), 1, 13))::BIGINT / 4503599627370496.0)) AS n FROM draws
), whole AS (
  SELECT doc_id, text, lang, source, n_chars, rate, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY ALL
), copies AS (
  SELECT *, unnest(range(0, n)) AS copy FROM whole WHERE n > 0
)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS mix_rate, CAST(copy AS INTEGER) AS mix_copy,
  md5('42|order|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || copy) AS mix_order
FROM copies
"""

#: The table that a byte-wise crc32 looks up, as one list, and the crc32 of a short ASCII text by it.
CRC_TABLE = """
crc_steps AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8
)"""


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text; `t` of crc_table has to be in scope."""
    codes = f"list_transform(range(1, length(({text})) + 1), lambda k: ord(({text})[k])::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def _leaf(text: str) -> str:
    one = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(map(one, ("doc_id", "source", "lang", "n_chars", text))) + ")"


MERKLE = f"""
WITH RECURSIVE {CRC_TABLE}, leaf AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree, {_leaf("text")} AS d,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS found
  FROM documents, crc_table
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaf
), level AS (
  SELECT tree, 0 AS k, i, d, n FROM placed
  UNION ALL
  SELECT tree, k + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 2) // 3 FROM level WHERE n > 1 GROUP BY tree, k, i // 3
), run AS (
  SELECT tree, k, i // 3 AS p, list(d ORDER BY i) AS ds FROM level WHERE n > 1 GROUP BY tree, k, i // 3
), subroot AS (
  SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM level WHERE n = 1
), top AS (
  SELECT 0 AS k, i, d, n FROM subroot
  UNION ALL
  SELECT k + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY k, i // 3
), top_run AS (
  SELECT k, i // 3 AS p, list(d ORDER BY i) AS ds FROM top WHERE n > 1 GROUP BY k, i // 3
), up AS (
  SELECT doc_id, tree, i AS leaf_rank, d, 0 AS k, i, found AS acc, '' AS proof FROM placed
  UNION ALL
  SELECT doc_id, u.tree, leaf_rank, d, u.k + 1, i // 3, sha256(array_to_string(ds[:i % 3] || [acc] || ds[i % 3 + 2:], '')),
    proof || array_to_string(ds[:i % 3] || ds[i % 3 + 2:], '')
  FROM up u JOIN run r ON u.tree = r.tree AND u.k = r.k AND u.i // 3 = r.p
), under AS (
  SELECT doc_id, tree, d, acc, proof FROM (SELECT *, max(k) OVER (PARTITION BY tree, leaf_rank) AS last FROM up) WHERE k = last
), over_top AS (
  SELECT doc_id, u.tree, leaf_rank, u.d, s.d AS subroot, 0 AS k, s.i, acc, proof FROM (SELECT *, row_number() OVER () AS leaf_rank FROM under) u JOIN subroot s ON u.tree = s.tree
  UNION ALL
  SELECT doc_id, tree, leaf_rank, d, subroot, u.k + 1, i // 3, sha256(array_to_string(ds[:i % 3] || [acc] || ds[i % 3 + 2:], '')),
    proof || array_to_string(ds[:i % 3] || ds[i % 3 + 2:], '')
  FROM over_top u JOIN top_run r ON u.k = r.k AND u.i // 3 = r.p
)
SELECT doc_id, o.d AS leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.d AS verified
FROM (SELECT *, max(k) OVER () AS last FROM over_top) o, (SELECT d FROM top WHERE n = 1) t WHERE k = last
"""

TOP_K = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

TRIE = f"""
WITH RECURSIVE {CRC_TABLE}, turns AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS points
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'x': x, 'p': points}} ORDER BY turn NULLS FIRST, x) AS s FROM turns GROUP BY conv_id
), drawn AS (
  SELECT conv_id, s, {crc32("conv_id::VARCHAR")} % 6 AS h FROM own, crc_table
), rebuilt AS (
  SELECT d.conv_id, coalesce(b.s[:h], []) || d.s[h + 1:] AS s FROM drawn d LEFT JOIN own b ON b.conv_id = d.conv_id - d.conv_id % 100
), prefix AS (
  SELECT conv_id, depth, len(s) AS turns, sha256(array_to_string(list_transform(s[:depth], lambda e: e.x), '')) AS k,
    sha256(array_to_string(list_transform(s[:depth - 1], lambda e: e.x), '')) AS up, CASE WHEN depth > 0 THEN s[depth].p ELSE 0 END AS points
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt)
), node AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n, any_value(up) AS up, any_value(points) AS points,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
  FROM prefix GROUP BY depth, k
), kids AS (
  SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2
), full_node AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids c ON n.depth = c.depth AND n.k = c.k
), below AS (
  SELECT p.depth, p.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * f.points) AS saved
  FROM full_node f JOIN prefix p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY 1, 2
)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN below b ON f.depth = b.depth AND f.k = b.k LEFT JOIN node u ON f.depth > 0 AND u.depth = f.depth - 1 AND u.k = f.up
"""


def pages(rules: list[tuple[str, str, str]], rounds: int = 10, damping: float = 0.85) -> str:
    """Rules and both rankings, round by round."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rules)
    steps = ""
    for name, src, dst, weight in (("t", "src", "dst", "allowed"), ("d", "dst", "src", "blocked")):
        steps += f""", {name}seed AS (SELECT host, {weight} / (SELECT sum({weight}) FROM counted) AS rank FROM counted WHERE {weight} > 0),
        {name}share AS (SELECT {src} AS a, {dst} AS b, w / sum(w) OVER (PARTITION BY {src}) AS p FROM edges), {name}0 AS (SELECT * FROM {name}seed)"""
        for k in range(1, rounds + 1):
            steps += f""", {name}m{k} AS (SELECT b AS host, sum(rank * p) * {damping} AS rank FROM {name}{k - 1} r JOIN {name}share ON r.host = a GROUP BY b),
            {name}{k} AS (SELECT host, sum(rank) AS rank FROM (SELECT host, rank * (1 - coalesce((SELECT sum(rank) FROM {name}m{k}), 0)) AS rank FROM {name}seed UNION ALL SELECT * FROM {name}m{k}) GROUP BY host)"""
    return f"""
    WITH placed AS (
      SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages
    ), rules(h, p, v) AS (VALUES {values}), ruled AS (
      SELECT page_id, html, host, path,
        (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, h || p LIMIT 1) AS rule,
        (SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, h || p LIMIT 1) AS v FROM placed
    ), links AS (
      SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), {quoted(LINKED)}, 1), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS dst FROM placed
    ), edges AS (
      SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
    ), counted AS (
      SELECT host, CAST(count_if(v = 'allow') AS DOUBLE) AS allowed, CAST(count_if(v = 'block') AS DOUBLE) AS blocked FROM ruled WHERE v IS NOT NULL AND host <> '' GROUP BY host
    ){steps}, hosts AS (
      SELECT coalesce(t.host, d.host) AS host, coalesce(t.rank, 0) AS t, coalesce(d.rank, 0) AS d FROM t{rounds} t FULL JOIN d{rounds} d ON t.host = d.host
    )
    SELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN d > 0 AND d >= 0.5 * (t + d) THEN 'block' END, 'allow') AS verdict FROM ruled r LEFT JOIN hosts h ON r.host = h.host
    """
