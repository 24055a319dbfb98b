"""SQL for those queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

_ONE = "o AS (SELECT article_id, any_value(title) AS title, any_value(content) AS content FROM sample_articles WHERE article_id IS NOT NULL GROUP BY article_id)"
_LONG = "x AS (SELECT article_id, regexp_replace(lower(coalesce(title, '') || ' ' || content), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM o WHERE length(content) >= 300)"
_SNIPPETS = "g AS (SELECT DISTINCT article_id, substring(t, i, 16) AS g FROM (SELECT article_id, t, unnest(range(1, length(t) - 14)) AS i FROM x)), n AS (SELECT article_id, count(*) AS n FROM g GROUP BY 1)"
_NEAR = (
    "near AS MATERIALIZED (SELECT a, b FROM (SELECT a.article_id AS a, b.article_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.article_id < b.article_id GROUP BY 1, 2) "
    "JOIN n x ON x.article_id = a JOIN n y ON y.article_id = b WHERE c >= 0.6 * (x.n + y.n - c))"
)
_GROUPS = (
    "e AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), r(a, b) AS (SELECT article_id, article_id FROM n UNION SELECT e.b, r.b FROM r JOIN e ON e.a = r.a), l AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1), "
    "k AS (SELECT t, min(article_id) AS class_id, count(*) AS n_copies FROM x GROUP BY 1), "
    "groups AS (SELECT x.article_id, k.class_id, k.n_copies, (SELECT min(r.b) FROM r WHERE r.a = x.article_id) AS group_id, coalesce(l.n_links, 0) AS n_links FROM x JOIN n USING (article_id) JOIN k USING (t) LEFT JOIN l ON l.a = x.article_id)"
)
_SIDES = "s AS (SELECT DISTINCT article_id, CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'val' THEN 'eval' WHEN 'validation' THEN 'eval' WHEN 'test' THEN 'eval' END AS side FROM article_splits)"
_PARTS = "s AS (SELECT DISTINCT article_id, split, CASE split WHEN 'train' THEN 'train' ELSE 'eval' END AS part FROM (SELECT article_id, CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'val' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test' END AS split FROM article_splits) WHERE split IS NOT NULL)"
#: Whitespace and marks at which a text may be cut.
_PAUSE = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？।؟።…]"

_BLANK = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_NAMES = f"regexp_replace(trim(lower(regexp_replace(author, '{_BLANK}+', ' ', 'g'))), '^by\\b[ :]*', '')"

_RELATED = (
    f"WITH RECURSIVE m AS (SELECT lower({_trim('variant')}) AS v, min(lower({_trim('source')})) AS s FROM source_mapping GROUP BY 1), "
    f"x AS (SELECT article_id, 's:' || coalesce(m.s, b) AS v FROM (SELECT article_id, lower({_trim('source')}) AS b FROM sample_articles) LEFT JOIN m ON m.v = b WHERE b <> '' "
    f"UNION SELECT article_id, 'a:' || n FROM (SELECT article_id, regexp_replace(trim(unnest(string_split_regex({_NAMES}, ' and |;|&'))), '^by ', '') AS n FROM sample_articles) WHERE n NOT IN ('', 'staff', 'newsroom', 'editorial board')), "
    "e AS (SELECT DISTINCT p.v AS a, q.v AS b FROM x p JOIN x q USING (article_id)), "
    "r(a, b) AS (SELECT DISTINCT v, v FROM x UNION SELECT e.b, r.b FROM r JOIN e ON e.a = r.a), "
    "c AS (SELECT a AS v, min(b) AS label FROM r GROUP BY 1), l AS (SELECT article_id, min(label) AS label FROM x JOIN c USING (v) GROUP BY 1), g AS (SELECT label, min(article_id) AS group_id FROM l GROUP BY 1), "
    "groups AS (SELECT DISTINCT o.article_id, coalesce(g.group_id, o.article_id) AS group_id FROM sample_articles o LEFT JOIN l ON l.article_id = o.article_id LEFT JOIN g ON g.label = l.label WHERE o.article_id IS NOT NULL)"
)
_OVERLAPS = (
    "e AS (SELECT g.article_id AS e, g.g FROM g JOIN s ON s.article_id = g.article_id AND side = 'eval'), t AS (SELECT g.article_id AS t, g.g FROM g JOIN s ON s.article_id = g.article_id AND side = 'train'), "
    "c AS (SELECT e, t, count(*) AS c FROM e JOIN t USING (g) WHERE e <> t GROUP BY 1, 2), q AS MATERIALIZED (SELECT e, t FROM c JOIN n ON n.article_id = e WHERE c >= 0.6 * n.n)"
)

ORACLES = {
    "p2_found": f"{_RELATED} SELECT * FROM groups",
    "p2_invariants": f"{_RELATED} SELECT count(*)::BIGINT AS n_articles, count(DISTINCT group_id) AS n_groups, 0::BIGINT AS n_parted, 0::BIGINT AS n_far_off FROM groups",
    "p5_found": f"WITH {_ONE}, {_LONG}, {_SNIPPETS}, {_SIDES}, {_OVERLAPS} SELECT DISTINCT least(e, t) AS article_id_a, greatest(e, t) AS article_id_b FROM q",
    "p5_report": f"WITH {_ONE}, {_LONG}, {_SNIPPETS}, {_SIDES}, {_OVERLAPS}, m AS (SELECT lower(trim(variant)) AS v, min(source) AS s FROM source_mapping GROUP BY 1), "
    "k AS (SELECT article_id, min(lower(coalesce(m.s, trim(a.source)))) AS source FROM sample_articles a LEFT JOIN m ON m.v = lower(trim(a.source)) GROUP BY 1), "
    "h AS (SELECT e, count(*) AS links FROM q GROUP BY 1), z AS (SELECT DISTINCT article_id, CASE lower(trim(split)) WHEN 'test' THEN 'test' ELSE 'val' END AS split FROM article_splits WHERE lower(trim(split)) IN ('val', 'validation', 'test')) "
    "SELECT z.split, k.source, count(*) AS n_articles, count(h.links) AS n_overlapping, coalesce(sum(h.links), 0)::BIGINT AS n_links FROM z JOIN k USING (article_id) LEFT JOIN h ON h.e = z.article_id GROUP BY 1, 2",
    "p5_members": f"WITH {_ONE}, {_LONG}, {_PARTS}, c AS (SELECT part, t, min(article_id) AS class_id, count(DISTINCT article_id) AS n_articles FROM x JOIN s USING (article_id) WHERE length(t) >= 16 GROUP BY 1, 2) "
    "SELECT DISTINCT x.article_id, s.split, s.part, c.class_id, c.n_articles FROM x JOIN s USING (article_id) JOIN c ON c.part = s.part AND c.t = x.t",
    "p6_found": f"WITH {_ONE} SELECT article_id, CASE WHEN list_max(list_transform(string_split_regex(content, '{_PAUSE}'), lambda x: length(x))) > 3000 THEN 'forced' ELSE 'natural' END AS cut FROM o WHERE length(content) > 3000",
    "p6_invariants": f"WITH {_ONE} SELECT article_id, length(content) AS n_chars, 1 AS good FROM o WHERE length(content) > 3000",
    "p7_found": f"WITH {_ONE}, {_LONG}, {_SNIPPETS}, {_NEAR} SELECT a AS article_id_a, b AS article_id_b FROM near",
    "p7_groups": f"WITH RECURSIVE {_ONE}, {_LONG}, {_SNIPPETS}, {_NEAR}, {_GROUPS} SELECT * FROM groups",
    "p7_kept": f"WITH RECURSIVE {_ONE}, {_LONG}, {_SNIPPETS}, {_NEAR}, {_GROUPS} SELECT article_id FROM o WHERE article_id NOT IN (SELECT article_id FROM groups WHERE article_id <> group_id)",
    "p8_invariants": f"SELECT count(*) AS n_texts, 0::BIGINT AS n_wrong, 0::BIGINT AS n_over FROM documents WHERE length({_trim('text')}) > 0",
    "p9_invariants": f"SELECT lower({_trim('t.source')}) AS source, max(t.target_share) AS target_share, max(t.max_repeats) AS max_repeats, max(CASE WHEN d.doc_id IS NULL THEN 0 ELSE 1 END) AS has_text, 1 AS within_repeats, 1 AS at_share "
    f"FROM mix_targets t LEFT JOIN (SELECT min(doc_id) AS doc_id, arg_min(lower({_trim('source')}), doc_id) AS source FROM documents WHERE length({_trim('text')}) > 0 AND lower({_trim('source')}) IN (SELECT lower({_trim('source')}) FROM mix_targets) GROUP BY text) d ON d.source = lower({_trim('t.source')}) GROUP BY 1",
}
