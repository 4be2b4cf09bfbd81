"""SQL (DuckDB) for operators that SQL can express; plain joins over whole tables, for small scale factors."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR_DUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACES}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
x AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT r, i, x.m, item_id FROM x JOIN p ON x.m = p.m AND x.k = p.k),
c AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(i, i + m)) AS q FROM (SELECT DISTINCT r, i, m FROM h)) GROUP BY 1),
t AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS x FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(x), 0) AS n_items, sha256(coalesce(array_to_string(x, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN t ON t.r = d.r
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), {_SPACES}) AS w FROM documents),
x AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM x GROUP BY 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS q FROM x JOIN f ON x.k = f.k WHERE first < doc_id),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
v AS (SELECT u.r, count(g.q) AS gone, string_agg(word, ' ' ORDER BY u.q) FILTER (WHERE g.q IS NULL) AS kept FROM u LEFT JOIN g ON u.r = g.r AND u.q = g.q GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN v ON v.r = d.r
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON a = vec_id LEFT JOIN n ON x = vec_id
"""

# the table of the cyclic redundancy check, and the check of a string's UTF-8 bytes
_CRC_TABLE = """tab AS (SELECT list(c ORDER BY i) AS tab FROM
(SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def _crc(s: str) -> str:
    octets = f"list_transform(range(strlen({s})), lambda i: CAST('0x' || substr(hex({s}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


_OTHER = "CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
_BEFORE = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))


def _tree(up: str, start: str, runs: str) -> str:
    return f"""
{up} AS ({start} UNION ALL SELECT level + 1, tree, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {up} WHERE n > 1 GROUP BY level, tree, n, pos // 8),
{runs} AS (SELECT level, tree, pos // 8 AS run, string_agg(h, '' ORDER BY pos) AS s FROM {up} WHERE n > 1 GROUP BY ALL)"""


def _path(path: str, start: str, runs: str) -> str:
    left, right = "substr(s, 1, 64 * (pos % 8))", "substr(s, 64 * (pos % 8) + 65)"
    return f"""
{path} AS ({start} UNION ALL
SELECT r, {path}.level + 1, {path}.tree, pos // 8, (n + 7) // 8, proof || {left} || {right}, sha256({left} || h || {right}) FROM {path} JOIN {runs} x ON x.level = {path}.level AND x.tree = {path}.tree AND run = pos // 8 WHERE n > 1)"""


MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
c AS (SELECT *, {_crc("CAST(doc_id AS VARCHAR)")} AS crc FROM documents, tab),
l AS (SELECT doc_id, lang, sha256({_BEFORE} || {_field("text")}) AS leaf, sha256({_BEFORE} || {_field(f"({_OTHER})")}) AS other FROM c),
d AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM l),
{_tree("u", "SELECT 0 AS level, tree, pos, n, leaf AS h FROM d", "x1")},
t AS (SELECT tree, h AS subroot, count(*) OVER () AS trees FROM u WHERE n = 1),
{_tree("v", "SELECT 0 AS level, 0 AS tree, tree AS pos, trees AS n, subroot AS h FROM t", "x2")},
{_path("p", "SELECT r, 0 AS level, tree, pos, n, '' AS proof, other AS h FROM d", "x1")},
{_path("q", "SELECT r, 0 AS level, 0 AS tree, p.tree AS pos, trees AS n, proof, h FROM p JOIN t ON t.tree = p.tree WHERE n = 1", "x2")}
SELECT doc_id, leaf, subroot, v.h AS root, sha256(proof) AS proof_sha256, q.h AS folded_root, q.h = v.h AS verified
FROM d JOIN t ON t.tree = d.tree JOIN q ON q.r = d.r AND q.n = 1 JOIN v ON v.n = 1
"""

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
w AS (SELECT CAST(doc_id AS VARCHAR) || ':' || run AS k, run, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, m, {_crc("k")} AS h FROM w, tab),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h),
d AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY 1 HAVING sum(m) >= 5),
g AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM d)),
s AS (SELECT word AS a, cut AS b FROM g WHERE cut IN (SELECT word FROM d)),
p AS (SELECT x.word AS a, y.word AS b FROM g x JOIN g y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word UNION SELECT a, b FROM s UNION SELECT b, a FROM s),
q AS (SELECT a, count(*) OVER (PARTITION BY a) AS n_near, b, n AS m, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM p JOIN d ON word = b),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN b END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM d LEFT JOIN q ON a = word AND k = 1),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, form FROM r JOIN f ON f.word = r.at WHERE form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.at AND e.form IS NULL
"""
