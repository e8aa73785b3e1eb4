"""DuckDB SQL of the operators that SQL can express, spelled out on its own."""

from __future__ import annotations

from tablekin.llm import placement, urls

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"


def _number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def sharding(shards: int, slots: int) -> str:
    table = ",".join(map(str, placement.fill(placement.names(shards), slots)))
    return f"""
        SELECT doc_id, slot, ([{table}]::INTEGER[])[slot + 1] AS shard
        FROM (SELECT doc_id, {_number("coalesce(doc_id::VARCHAR, '')")} % {slots} AS slot FROM documents)"""


def mixing(repeats: float, block: int, grid: int, seed: int = 7) -> str:
    """Repetition limit with the natural number of tokens as the budget."""
    steps = grid.bit_length()
    return f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, {_WORDS}::BIGINT AS words,
                {_number(f"'mix-{seed}:' || coalesce(doc_id::VARCHAR, '')")} AS key FROM documents),
        s AS (SELECT source, sum(words)::BIGINT AS tokens, count(*) AS n FROM d GROUP BY source),
        t AS (SELECT sum(tokens)::DOUBLE AS total FROM s),
        r AS (SELECT source, tokens, n, tokens / total AS share FROM s, t),
        b(step, low, high) AS (
            SELECT 0, 0, {grid}
            UNION ALL
            SELECT step + 1, CASE WHEN fits THEN low ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE high END
            FROM (SELECT step, low, high, (low + high) // 2 AS mid,
                    (SELECT max(pow(share, x / {grid}.0 - 1)) / sum(share * pow(share, x / {grid}.0 - 1)) <= {repeats}
                     FROM (SELECT share, (low + high) // 2 AS x FROM r WHERE tokens > 0)) AS fits
                  FROM b WHERE low < high AND step < {steps + 2})),
        a AS (SELECT max_by(low, step) / {grid}.0 - 1 AS e FROM b),
        z AS (SELECT sum(share * pow(share, e)) AS z FROM r, a WHERE tokens > 0),
        p AS (SELECT *, greatest(ceil(n / {block}.0), 1)::BIGINT AS blocks,
                CASE WHEN tokens = 0 THEN 1 ELSE wanted // tokens END AS passes,
                CASE WHEN tokens = 0 THEN 0 ELSE wanted % tokens END AS rest
              FROM (SELECT source, tokens, n, CASE WHEN tokens = 0 THEN 0
                        ELSE floor(tokens * pow(share, e) / z)::BIGINT END AS wanted FROM r, a, z)),
        k AS (SELECT d.*, p.passes, p.rest, d.key % p.blocks AS block
              FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
        o AS (SELECT *, {_number(f"'block-{seed}:' || block::VARCHAR")} AS place FROM k),
        q AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place, block, key
                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                sum(words) OVER (PARTITION BY source ORDER BY place, block
                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block_end FROM o),
        l AS (SELECT source, min(block_end) FILTER (block_end >= rest) AS last_end FROM q GROUP BY source)
        SELECT q.doc_id, q.source,
            (passes + CASE WHEN rest > 0 AND upto <= rest AND block_end <= last_end THEN 1 ELSE 0 END)::BIGINT AS copies
        FROM q JOIN l ON q.source IS NOT DISTINCT FROM l.source"""


def decontamination(window: int, misses: int, least: int) -> str:
    """Any two windows that agree in all but a few places share four words in a row."""
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    gram = "w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4]"
    return f"""
        WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
        i AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
        dg AS (SELECT doc_id, p, {gram} AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 3)) AS p FROM d WHERE len(w) > 3)),
        ig AS (SELECT item_id, p AS q, {gram} AS g FROM (SELECT item_id, w, unnest(range(len(w) - 3)) AS p FROM i WHERE len(w) >= {least})),
        h AS (SELECT DISTINCT doc_id, item_id, p - q AS lag, q - b AS q
              FROM dg JOIN ig USING (g), range({window}) AS t(b)),
        c AS (SELECT h.doc_id, h.item_id, h.lag + h.q AS p, least({window}, len(i.w)) AS width,
                len(list_filter(range(least({window}, len(i.w))),
                    lambda x: d.w[h.lag + h.q + x + 1] = i.w[h.q + x + 1])) AS matched
              FROM h JOIN d USING (doc_id) JOIN i USING (item_id)
              WHERE h.q >= 0 AND h.lag + h.q >= 0 AND h.q + least({window}, len(i.w)) <= len(i.w)
                AND h.lag + h.q + least({window}, len(i.w)) <= len(d.w))
        SELECT doc_id, item_id, max(matched)::INTEGER AS matched, min(p)::INTEGER AS first_word
        FROM c WHERE matched >= CASE WHEN width < {window} THEN width ELSE {window - misses} END
        GROUP BY doc_id, item_id"""


def url_verdicts(rules: tuple[urls.Rule, ...], tree: urls.Tree) -> str:
    """The template tree with one block of subqueries a level."""
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    order = sorted(rules, key=lambda r: -len(r.text))
    pick = {
        k: "CASE " + " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{getattr(r, k)}'" for r in order) + " END"
        for k in ("text", "verdict")
    }
    levels = ""
    for k in range(tree.levels + 1):
        last = f"array_to_string(pieces[{k + 1}:], '/')" if k == tree.levels else f"pieces[{k + 1}]"
        levels += f"""
        a{k} AS (SELECT *, CASE WHEN len(pieces) > {k} THEN {last} END AS piece FROM n{k}),
        c{k} AS (SELECT host, node, piece, sum(n) AS n, sum(labels) AS labels, sum(blocked) AS blocked
                 FROM a{k} WHERE piece IS NOT NULL GROUP BY ALL),
        w{k} AS (SELECT *, sum(labels) OVER (PARTITION BY host, node) AS al, sum(blocked) OVER (PARTITION BY host, node) AS ab FROM c{k}),
        k{k} AS (SELECT host, node, piece FROM w{k} WHERE n >= {tree.support} AND labels > 0 AND al > labels
                 AND abs(blocked / labels - (ab - blocked) / (al - labels))
                     > {tree.errors} * sqrt(ab / al * (1 - ab / al) * (1 / labels + 1 / (al - labels)))),
        m{k} AS (SELECT a.host, a.path, a.n, a.labels, a.blocked, a.pieces, a.purity, a.piece IS NOT NULL AS deeper,
                    a.node || CASE WHEN a.piece IS NULL THEN '' WHEN k.piece IS NULL THEN '/*' ELSE '/' || k.piece END AS node
                 FROM a{k} a LEFT JOIN k{k} k ON a.host = k.host AND a.node = k.node AND a.piece = k.piece),
        f{k} AS (SELECT host, node, sum(labels) AS l, sum(blocked) AS b FROM m{k} WHERE deeper GROUP BY ALL),
        n{k + 1} AS (SELECT m.host, m.path, m.n, m.labels, m.blocked, m.pieces, m.node,
                    CASE WHEN deeper THEN (f.b + {tree.prior} * m.purity) / (f.l + {tree.prior}) ELSE m.purity END AS purity
                 FROM m{k} m LEFT JOIN f{k} f ON m.deeper AND m.host = f.host AND m.node = f.node),"""
    return f"""
        WITH u AS (SELECT page_id, strpos(coalesce(url, ''), '://') AS mark, coalesce(url, '') AS url FROM pages),
        v AS (SELECT page_id, CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^([^/?#]*)', 1) ELSE '' END AS raw,
                CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
        j AS (SELECT page_id, path, translate(raw, '{urls.UPPER}', '{urls.LOWER}') AS host FROM v),
        r AS (SELECT *, {pick["text"]} AS rule, {pick["verdict"]} AS ruled FROM j),
        p AS (SELECT host, path, count(*) AS n, count(ruled)::DOUBLE AS labels,
                count(*) FILTER (ruled = 'block')::DOUBLE AS blocked FROM r GROUP BY ALL),
        g AS (SELECT (sum(blocked) + 1) / (sum(labels) + 2) AS base FROM p),
        n0 AS (SELECT host, path, n, labels, blocked,
                CASE WHEN path = '' THEN []::VARCHAR[] ELSE string_split(substr(path, 2), '/') END AS pieces, '' AS node,
                (sum(blocked) OVER (PARTITION BY host) + {tree.prior} * base)
                    / (sum(labels) OVER (PARTITION BY host) + {tree.prior}) AS purity FROM p, g),{levels}
        z AS (SELECT host, path, node AS template, purity FROM n{tree.levels + 1})
        SELECT page_id, host, path, rule, template, purity,
            coalesce(ruled, CASE WHEN purity >= {tree.threshold} THEN 'block' ELSE 'allow' END) AS verdict
        FROM r JOIN z USING (host, path)"""
