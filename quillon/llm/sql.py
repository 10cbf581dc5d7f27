"""SQL twins of the corpus queries that SQL can express.

Toxicity, quality and personal data rest on fitted models, byte-pair merges on an ordered rank file, fuzzy lines on
SimHashes, and the neighbours found are approximate; those are tested against brute force, exact round trips and held-out
labels instead.
"""

from __future__ import annotations

from quillon.llm import decontaminate, sharding, substring_dedup

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _words(pattern: str, lower: bool) -> str:
    text = "coalesce(text, '')"
    return f"regexp_extract_all({f'''translate({text}, '{_UPPER}', '{_LOWER}')''' if lower else text}, {pattern})"


def _crc_table() -> list[int]:
    """The checksum's table, from its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


def _draws(node: sharding.Node, path: str = "") -> str:
    """The tree as nested CASE expressions over the same draws."""
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _draws(node.children[0], f"{path}/{node.children[0].name}")
    draw = lambda c: f"-ln((CAST(('0x' || substr(md5(k || '{path}/{c.name}'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / {float(c.total)}::DOUBLE"
    won = f"list_min([{', '.join(f'''{{'d': {draw(c)}, 'i': {i}}}''' for i, c in enumerate(node.children))}]).i"
    return f"(CASE {won} {' '.join(f'''WHEN {i} THEN {_draws(c, f'{path}/{c.name}')}''' for i, c in enumerate(node.children))} END)"


def _sharding() -> str:
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(h), 2), lambda i: CAST(('0x' || h[i:i + 1]) AS BIGINT))), lambda c, b: xor(c >> 8, CAST(('0x' || substr('{''.join(f'{x:08x}' for x in _crc_table())}', 8 * (xor(c, b) & 255) + 1, 8)) AS BIGINT))), 4294967295::BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, CAST(length(h) // 2 + 8 AS BIGINT) AS size, {crc} AS text_crc32, 'key' AS law, CAST({_draws(sharding.tree(24))} AS INTEGER) AS shard, CAST({_draws(sharding.tree(25))} AS INTEGER) AS grown_shard,
CAST(('0x' || substr(md5(k || '/slot'), 1, 8)) AS BIGINT) % {sharding.BUCKETS} AS bucket FROM d)
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM p"""


_JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_SPACED, True)} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (SELECT a.doc_id AS p, b.doc_id AS q FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS p, doc_id AS q FROM s UNION SELECT r.p, l.q FROM r JOIN l ON r.q = l.p)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.m AS component_id FROM s JOIN (SELECT p, min(q) AS m FROM r GROUP BY p) c ON c.p = s.doc_id"""

_W = decontaminate.WINDOW
_BENCHMARK = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(_ALNUM, True)} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item, least(len(w), {_W}) AS n, unnest(list_transform(range(1, greatest(2, len(w) - {_W - 2})), lambda k: array_to_string(w[k:k + {_W - 1}], ' '))) AS x FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {_words(_ALNUM, True)} AS w FROM documents),
g AS (SELECT doc_id, n, list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' ')) AS xs FROM d, (SELECT DISTINCT n FROM v) AS sizes),
h AS (SELECT doc_id, g.n, k, item FROM (SELECT doc_id, n, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM g) AS g JOIN v USING (x)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) AS places GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) AS found GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_N = substring_dedup.WINDOW
_SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_words(_SPACED, False)} AS w FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(w) - {_N - 2}), lambda k: md5(array_to_string(w[k:k + {_N - 1}], ' '))) AS xs FROM d),
x AS (SELECT doc_id, unnest(xs) AS h, generate_subscripts(xs, 1) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + {_N})) AS k FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM e ANTI JOIN c USING (doc_id, k) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

TWINS: dict[str, str] = {
    "op2_sharding": _sharding(),
    "op6_jaccard_join": _JACCARD,
    "op7_decontaminate": _BENCHMARK,
    "op10_substring_dedup": _SUBSTRINGS,
}
