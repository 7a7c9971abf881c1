"""SQL for the queries of this subpackage that SQL can state on whole tables."""

from __future__ import annotations

import functools
import unicodedata

from lodestrand.llm.confusables import tables
from lodestrand.plans.text_queries import mapped_sql

_BLANKS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"

_BODIES = f"""b AS (SELECT id, regexp_replace(lower(content), '{_BLANKS}', '', 'g') AS t FROM pages WHERE content IS NOT NULL),
m AS (SELECT id, t, min(id) OVER (PARTITION BY t) AS rep FROM b WHERE length(t) >= 200),
g AS (SELECT DISTINCT rep, substr(t, CAST(i AS BIGINT), 5) AS gram FROM (SELECT rep, t, unnest(generate_series(1, length(t) - 4)) AS i FROM m WHERE id = rep)),
n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
s AS (SELECT x.rep AS a, y.rep AS b, count(*) AS both FROM g x JOIN g y ON x.gram = y.gram AND x.rep < y.rep GROUP BY x.rep, y.rep),
l AS (SELECT s.a, s.b FROM s JOIN n na ON na.rep = s.a JOIN n nb ON nb.rep = s.b WHERE 10 * s.both >= 7 * (na.n + nb.n - s.both))"""

ORACLES: dict[str, str] = {
    "p4_found": f"""WITH {_BODIES}, p AS (SELECT x.id AS i, y.id AS j FROM l JOIN m x ON x.rep = l.a JOIN m y ON y.rep = l.b
UNION ALL SELECT x.id, y.id FROM m x JOIN m y ON x.rep = y.rep AND x.id < y.id)
SELECT least(i, j) AS id_a, greatest(i, j) AS id_b FROM p""",
    "p4_classes": f"""WITH {_BODIES}, d AS (SELECT rep, count(*) AS k FROM (SELECT a AS rep FROM l UNION ALL SELECT b FROM l) GROUP BY rep)
SELECT m.id, m.rep AS class_id, coalesce(d.k, 0) AS links FROM m LEFT JOIN d ON d.rep = m.rep""",
    # the text comes back from its ids
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p8_bounds": "SELECT DISTINCT t.source, true AS at_share, true AS within_repeats FROM mix_targets t JOIN documents d ON d.source = t.source WHERE d.text <> '' AND t.target_share > 0 AND t.max_repeats > 0",
}


@functools.lru_cache(maxsize=1)
def late_oracles(spark) -> dict[str, str]:
    """SQL of problem 2 with the table of look-alikes, which a running session gives, as a table of single characters."""
    fold, alike = tables(spark)
    table = {}
    for point in range(0x20, 0x110000):
        if not 0xD800 <= point <= 0xDFFF:
            ch = chr(point)
            form = unicodedata.normalize("NFD", unicodedata.normalize("NFD", ch.translate(fold)).translate(alike))
            if unicodedata.normalize("NFC", form) != ch:
                table[ch] = form
    texts = "SELECT id, 'title' AS name, title AS text FROM pages UNION ALL SELECT id, 'normalizedTitle', normalizedTitle FROM pages"
    forms = f"SELECT t.id, t.name, t.text, trim(f.text, ' ') AS look FROM ({texts}) t JOIN {mapped_sql(f'SELECT id || name AS key, text FROM ({texts})', table)} f ON f.key = t.id || t.name"
    compared = f"f AS MATERIALIZED ({forms}), g AS (SELECT * FROM f WHERE text <> '' AND look <> '')"
    return {
        "p2_forms": f'SELECT id, name AS "column", text, look AS skeleton FROM ({forms})',
        "p2_found": f"WITH {compared} SELECT DISTINCT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM g a JOIN g b ON a.name = b.name AND a.look = b.look AND a.text < b.text AND a.id <> b.id",
        "p2_classes": f"""WITH {compared}, c AS (SELECT name, text, min(id) AS class_id, any_value(look) AS look FROM g GROUP BY name, text), n AS (SELECT name, look, count(*) - 1 AS links FROM c GROUP BY name, look)
SELECT g.id, g.name AS "column", c.class_id, n.links FROM g JOIN c ON c.name = g.name AND c.text = g.text JOIN n ON n.name = g.name AND n.look = g.look""",
    }
