"""DuckDB SQL for the queries of exact operators: plain forms over whole tables, without the operators' methods."""

from __future__ import annotations

from urbanflow.llm import decontamination

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT a AS doc_id, b AS o FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.o),
c AS (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.o, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
v AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) < doc_id AS again FROM x),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
m AS (SELECT t.*, coalesce(max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM t LEFT JOIN v ON v.doc_id = t.doc_id AND v.i = t.j),
k AS (SELECT doc_id, count(*) AS n, sum(gone) AS gone, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

NEIGHBOURS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
s AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM s q JOIN s c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""

HARD_NEGATIVES = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS q FROM e),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON b.vec_id <> a.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
g AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY p.score DESC, p.vec_id) AS INTEGER) AS rank, p.vec_id AS negative_id, positive_score, p.score AS negative_score
      FROM g JOIN p USING (anchor_id) WHERE NOT p.same AND 80 * positive_score <= 100 * p.score AND 100 * p.score <= 100 * positive_score)
SELECT * FROM r WHERE rank <= 5
"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """Levels of a tree for each ``grp`` over ``leaves`` (grp, i, h, ...), and each node's siblings: 16^levels leaves at most."""
    out = [f"{name}0 AS (SELECT grp, i, h FROM {leaves})"]
    for k in range(levels):
        up = "sha256(string_agg(h, '' ORDER BY i))"
        out.append(f"{name}{k + 1} AS (SELECT grp, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN {up} ELSE any_value(h) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}{k}) GROUP BY ALL)")
        side = "coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i {} a.i), '')"
        out.append(f"{name}s{k} AS (SELECT a.grp, a.i, {side.format('<')} AS l, {side.format('>')} AS r, (SELECT count(*) FROM {name}{k} c WHERE c.grp = a.grp) > 1 AS many FROM {name}{k} a JOIN {name}{k} b ON a.grp = b.grp AND a.i // 16 = b.i // 16 GROUP BY a.grp, a.i)")
    return ", ".join(out)


def _climb(name: str, frm: str, grp: str, levels: int) -> str:
    """Adds siblings (``proof``) and folds ``cur`` up the levels of one tree, level by level."""
    out, last = [], frm
    for k in range(levels):
        new = f"{name}c{k}"
        out.append(f"{new} AS (SELECT x.* REPLACE (proof || CASE WHEN s.many THEN s.l || s.r ELSE '' END AS proof, CASE WHEN s.many THEN sha256(s.l || cur || s.r) ELSE cur END AS cur) FROM {last} x JOIN {name}s{k} s ON s.grp = x.{grp} AND s.i = x.{name}i // {16**k})")
        last = new
    return ", ".join(out)


_CRC = """list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"""
_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "t"))

MANIFEST = f"""
WITH d AS (SELECT doc_id, source, lang, n_chars, text AS t, xor({_CRC}, 4294967295) % 5 = 0 AS bad FROM documents),
v AS (SELECT doc_id, source, bad, sha256({_FIELDS}) AS h FROM d),
b AS (SELECT doc_id, source, sha256({_FIELDS}) AS h FROM (SELECT * REPLACE ({_LOWER.replace("text", "t")} AS t) FROM d) WHERE bad),
p AS (SELECT v.*, coalesce('s' || source, 'n') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ti, dense_rank() OVER (ORDER BY coalesce('s' || source, 'n')) - 1 AS ui FROM v),
{_tree("t", "p", 4)}, tops AS (SELECT 'all' AS grp, row_number() OVER (ORDER BY grp) - 1 AS i, h, grp AS own FROM t4), {_tree("u", "tops", 3)},
st AS (SELECT p.doc_id, p.h AS leaf, p.grp, p.ti, p.ui, 'all' AS top, coalesce(b.h, p.h) AS cur, '' AS proof FROM p LEFT JOIN b ON b.doc_id = p.doc_id),
{_climb("t", "st", "grp", 4)}, {_climb("u", "tc3", "top", 3)}
SELECT x.doc_id, x.leaf, o.h AS subroot, u3.h AS root, sha256(x.proof) AS proof_sha256, x.cur AS folded_root, x.cur = u3.h AS verified
FROM uc2 x JOIN tops o ON o.own = x.grp CROSS JOIN u3
"""


#: op7_shards has none: DuckDB lacks CRC-32, and byte by byte in SQL it takes over ten minutes on the whole table.
ORACLES: dict[str, str] = {
    "op2_decontamination": decontamination.ORACLE,
    "op5_jaccard_join": JACCARD,
    "op8_neighbours": NEIGHBOURS,
    "op9_substring_dedup": SUBSTRINGS,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_manifest": MANIFEST,
}
