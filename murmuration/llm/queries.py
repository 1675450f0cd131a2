"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from murmuration.llm import bpe, codes, decontaminate, html, ngram_join, packing, sharding, shared, suffix_repeats, topk, toxicity, urlfilter, warc, whitening

OP5_SQL = """
WITH RECURSIVE keyed AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS body, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
names(tree, level, name, weight, shard, parent) AS (VALUES
  {names}),
drawn AS (
  SELECT doc_id, body, k, tree, level, parent, name, shard,
    ln((CAST(('0x' || substr(md5(k || '/' || name), 1, 12)) AS BIGINT) + 1)::DOUBLE / 281474976710656.0) / weight AS d
  FROM keyed CROSS JOIN names),
won AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, body, tree, level, parent ORDER BY d DESC, name DESC) AS r FROM drawn),
placed AS (
  SELECT a.doc_id, a.body, a.tree, c.shard
  FROM won a JOIN won b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.body = b.body AND a.tree = b.tree AND b.level = 2 AND b.parent = a.name AND b.r = 1
  JOIN won c ON a.doc_id IS NOT DISTINCT FROM c.doc_id AND a.body = c.body AND a.tree = c.tree AND c.level = 3 AND c.parent = b.name AND c.r = 1
  WHERE a.level = 1 AND a.r = 1),
hexed AS (SELECT doc_id, body, hex(encode(body)) AS h FROM keyed GROUP BY ALL),
nibbled AS (
  SELECT doc_id, body, list_transform(string_split(h, ''), lambda x: instr('0123456789ABCDEF', x) - 1) AS n FROM hexed),
crc AS (
  SELECT doc_id, body, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, len(n)), lambda i: CAST(n[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END] AS BIGINT))),
    lambda c, b: xor(c >> 4, {table}[(xor(c, b) & 15) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM nibbled WHERE body != '' UNION ALL SELECT doc_id, body, 0 FROM nibbled WHERE body = ''),
sums AS (
  SELECT x.doc_id, x.body, x.shard, y.shard AS grown_shard, CAST(strlen(x.body) + 1 AS BIGINT) AS size, CAST(c.text_crc32 AS BIGINT) AS text_crc32
  FROM placed x JOIN placed y ON x.doc_id IS NOT DISTINCT FROM y.doc_id AND x.body = y.body AND x.tree = 'now' AND y.tree = 'grown'
  JOIN crc c ON x.doc_id IS NOT DISTINCT FROM c.doc_id AND x.body = c.body)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM sums
"""


def _op5_sql() -> str:
    tree = sharding.even_tree(8)
    rows = []
    for label, t in (("now", tree), ("grown", sharding.with_shard(tree, 8))):
        for region, racks in t.items():
            rows.append((label, 1, region, sharding._weight(racks), None, ""))
            for rack, ends in racks.items():
                rows.append((label, 2, f"{region}/{rack}", sharding._weight(ends), None, region))
                rows += [(label, 3, f"{region}/{rack}/{s}", w, s, f"{region}/{rack}") for s, w in ends.items()]
    names = ",\n  ".join("({})".format(", ".join("NULL" if v is None else repr(v) for v in r)) for r in rows)
    table = [n for n in range(16)]
    for _ in range(4):
        table = [(x >> 1) ^ (0xEDB88320 * (x & 1)) for x in table]
    return OP5_SQL.replace("{names}", names).replace("{table}", f"({table}::BIGINT[])")


OP6_SQL = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to, true AS digest_ok
FROM r
"""

OP10_SQL = r"""
WITH RECURSIVE rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '', 's') AS own, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
own AS (
  SELECT page_id, {node own} AS node,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
ruled AS (
  SELECT o.*, (SELECT max_by(struct_pack(rule := h || p, action := action), length(h || p)) FROM rules
    WHERE (o.host = h OR ends_with(o.host, '.' || h)) AND starts_with(o.path, p)) AS r
  FROM own o),
bare AS (
  SELECT url, regexp_replace(html, {raw}, ' ', 'g') AS h FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
tags AS (SELECT url, unnest(regexp_extract_all(h, '(?is)<(?:link|meta|base)[\s/](?:[^"''>]|"[^"]*"|''[^'']*'')*>')) AS tag FROM bare),
said AS (SELECT url, lower(regexp_extract(tag, '^<(\w+)', 1)) AS kind, {rel} AS rel, {http-equiv} AS equiv, {href} AS href, {content} AS content FROM tags),
aims AS (
  SELECT url, kind, CASE WHEN kind = 'base' THEN href
    WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(trim(rel)), '\s+'), 'canonical') THEN href
    WHEN kind = 'meta' AND lower(trim(equiv)) = 'refresh' THEN regexp_extract(content, '(?is)^\s*(?:\d+(?:\.[\d.]*)?|\.[\d.]+)\s*[;,\s]\s*(?:url\s*=\s*)?["'']?([^"'']*)', 1) END AS coded
  FROM said),
decoded AS (
  SELECT url, kind, regexp_replace(trim(replace(replace(
    list_reduce(list_prepend(coded, list_distinct(regexp_extract_all(coded, '&#(\d+);', 1))), lambda x, c: replace(x, '&#' || c || ';', chr(CAST(c AS INTEGER)))),
    '&quot;', '"'), '&amp;', '&')), '#.*$', '', 's') AS link
  FROM aims WHERE coded != ''),
rooted AS (
  SELECT d.url, d.kind, d.link, coalesce(b.link, d.url) AS root
  FROM decoded d LEFT JOIN (SELECT url, any_value({against url}) AS link FROM decoded WHERE kind = 'base' GROUP BY url) b USING (url)),
found AS (SELECT url, {against root} AS dst FROM rooted WHERE kind != 'base'),
ends AS (SELECT regexp_replace(url, '#.*$', '', 's') AS s, regexp_replace(dst, '#.*$', '', 's') AS d FROM found WHERE dst IS NOT NULL),
links AS (SELECT DISTINCT {node s} AS src, {node d} AS dst FROM ends),
both_ways AS (SELECT src AS a, dst AS b FROM links WHERE dst != '' AND src != dst UNION SELECT dst, src FROM links WHERE dst != '' AND src != dst),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
outside AS (SELECT node, component, CASE WHEN instr(node, '://') > 0 THEN substr(node, instr(node, '://') + 3) ELSE '' END AS rest FROM comp),
blocked AS (
  SELECT DISTINCT coalesce(c.component, x.node) AS component FROM ruled x LEFT JOIN comp c ON c.node = x.node WHERE x.r.action = 'block' AND x.node IS NOT NULL
  UNION
  SELECT DISTINCT component FROM outside o WHERE (SELECT max_by(action, length(h || p)) FROM rules
    WHERE (lower(regexp_extract(o.rest, '^([^/?#]*)', 1)) = h OR ends_with(lower(regexp_extract(o.rest, '^([^/?#]*)', 1)), '.' || h)) AND starts_with(regexp_extract(o.rest, '^[^/?#]*([^?#]*)', 1), p)) = 'block')
SELECT x.page_id, x.host, x.path, x.r.rule AS rule, coalesce(x.r.action, CASE WHEN b.component IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled x LEFT JOIN comp c ON c.node = x.node LEFT JOIN blocked b ON b.component = coalesce(c.component, x.node)
"""


def _op10_sql() -> str:
    """The parts that occur several times: raw elements, attributes, a link against its base, and a url as a node."""
    attrs = """(?:[^"''>]|"[^"]*"|''[^'']*'')*>"""
    raw = "|".join([r"<!--.*?(?:-->|$)", *(rf"<{n}\b{attrs}.*?(?:</{n}\s*>|$)" for n in ("script", "style")), *(rf"<{n}\b{attrs}.*?</{n}\s*>" for n in sorted(html.RAW - {"script", "style"}))])
    value = lambda n: " || ".join(rf"""coalesce(regexp_extract(tag, '(?is)\s{n}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^"''\s>]+))', {i}), '')""" for i in (1, 2, 3))
    site = "regexp_extract({u}, '^([^:/?#]+://[^/?#]*)', 1)"
    against = (
        "CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN link = '' OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') OR " + site + " = '' THEN NULL "
        "WHEN starts_with(link, '//') THEN regexp_extract({u}, '^([^:/?#]+:)//', 1) || link WHEN starts_with(link, '/') THEN " + site + " || link "
        "WHEN starts_with(link, '?') THEN regexp_extract({u}, '^([^?#]*)', 1) || link "
        "ELSE " + site + " || coalesce(nullif(regexp_extract({u}, '^[^:/?#]+://[^/?#]*(/[^?#]*/|/)', 1), ''), '/') || link END"
    )
    path = r"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1)"
    steps = "list_transform(string_split(" + path + ", '/')[2:], lambda s: [s])"
    walked = "list_reduce(list_prepend(CAST([] AS VARCHAR[]), " + steps + "), lambda acc, s: CASE WHEN s = ['..'] THEN acc[:-2] WHEN s = ['.'] THEN acc ELSE list_concat(acc, s) END)"
    node = (
        r"CASE WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN translate(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || "
        "CASE WHEN regexp_matches(" + path + r", '/\.\.?(/|$)') THEN '/' || array_to_string(" + walked + ", '/') || CASE WHEN regexp_matches(" + path + r", '/\.\.?$') AND len(" + walked + ") > 0 THEN '/' ELSE '' END ELSE " + path + " END || "
        r"regexp_extract({u}, '^[^?]*(\?.*)$', 1) ELSE {u} END"
    )
    parts = {"{raw}": f"'(?is){raw}'"} | {f"{{{n}}}": value(n) for n in ("rel", "http-equiv", "href", "content")}
    parts |= {f"{{against {u}}}": against.replace("{u}", u) for u in ("url", "root")} | {f"{{node {u}}}": node.replace("{u}", u) for u in ("own", "s", "d")}
    out = OP10_SQL
    for name, by in parts.items():
        out = out.replace(name, by)
    return out


OP9_SQL = """
WITH good AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.id AS query_id, c.id AS vec_id, max(CAST(list_inner_product(q.v, c.v) AS BIGINT)) AS score
  FROM good q JOIN good c ON q.id % 50 = 0 AND c.id != q.id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


OP12_SQL = """
WITH good AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, CAST(vec_id AS BIGINT) AS vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, CAST(part AS INTEGER) AS part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS x FROM good, range(8) t(part)),
c0 AS MATERIALIZED (
  SELECT part, r - 1 AS e, x FROM p JOIN (
    SELECT rid, row_number() OVER (ORDER BY vec_id, v) AS r FROM good WHERE vec_id IS NOT NULL QUALIFY r <= 16) f USING (rid)),
{rounds}
coded AS (SELECT rid, CAST(sum(de // 16) AS BIGINT) AS error, string_agg(printf('%02x', CAST(de % 16 AS INTEGER)), '' ORDER BY part) AS code FROM a6 GROUP BY rid),
book AS (SELECT sha256(string_agg(CAST(x[pos] AS VARCHAR), ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM c6, range(1, len(x) + 1) t(pos))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN good USING (rid), book
"""
OP12_ASSIGN = """a{i} AS MATERIALIZED (
  SELECT rid, p.part, min(16 * CAST(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT) + e) AS de
  FROM p JOIN c{i} c USING (part) GROUP BY rid, p.part),"""
OP12_MEANS = """m{i} AS (
  SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x FROM (
    SELECT a.part, de % 16 AS e, pos, CAST(sum(p.x[pos]) AS BIGINT) AS s, count(*) AS n
    FROM a{i} a JOIN p USING (rid, part), range(1, len(p.x) + 1) t(pos) GROUP BY ALL) GROUP BY part, e),
c{next} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (part, e)),"""


def _op12_sql() -> str:
    rounds = [t.replace("{i}", str(i)).replace("{next}", str(i + 1)) for i in range(6) for t in (OP12_ASSIGN, OP12_MEANS)]
    return OP12_SQL.replace("{rounds}", "\n".join([*rounds, OP12_ASSIGN.replace("{i}", "6")]))


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared.prepare(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_html_text": html.query,
        "op2_toxicity_crf": toxicity.query,
        "op3_ngram_jaccard": ngram_join.query,
        "op4_suffix_repeats": suffix_repeats.query,
        "op5_hash_tree_sharding": sharding.query,
        "op6_warc": warc.query,
        "op7_spaced_seeds": decontaminate.query,
        "op8_best_fit_packing": packing.query,
        "op9_topk": topk.query,
        "op10_url_filter": urlfilter.query,
        "op11_bpe": bpe.query,
        "op12_vector_codes": codes.query,
        "op13_whitening": whitening.query,
    }
    return {name: _prepared(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op5_hash_tree_sharding": _op5_sql(), "op6_warc": OP6_SQL, "op9_topk": OP9_SQL, "op10_url_filter": _op10_sql(), "op12_vector_codes": _op12_sql()}
