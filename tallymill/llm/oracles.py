"""DuckDB SQL for the queries that SQL can express. Written from the contracts, not from the operators."""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, array_to_string(w[k + 1:k + 10], ' ') AS line, least(len(w), 10) AS n
    FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS k FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
    SELECT doc_id, n, k, array_to_string(w[k + 1:k + n], ' ') AS line
    FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT p.doc_id, p.k, p.n, i.item FROM places p JOIN windows i ON p.line = i.line AND p.n = i.n),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM found) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN who USING (doc_id)
"""

OP4 = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
places AS (
    SELECT doc_id, i, hex(raw[i + 1:i + 1]) AS b, CASE WHEN i + 100 <= octet_length(raw) THEN md5(raw[i + 1:i + 100]) END AS piece
    FROM (SELECT doc_id, raw, unnest(range(octet_length(raw))) AS i FROM docs)
),
lead AS (SELECT piece, min((doc_id, i)) AS at FROM places WHERE piece IS NOT NULL GROUP BY piece HAVING count(*) > 1),
starts AS (
    SELECT p.doc_id, p.i, p.b, CASE WHEN l.at IS NOT NULL AND l.at <> (p.doc_id, p.i) THEN 1 END AS again
    FROM places p LEFT JOIN lead l ON p.piece = l.piece
),
bytes AS (
    SELECT doc_id, i, b, coalesce(max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 0) AS gone
    FROM starts
),
marked AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM bytes),
summed AS (
    SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_spans,
           string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs d LEFT JOIN summed USING (doc_id)
"""

OP9 = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digests AS (
    SELECT *, sha1(body) AS h, min(page_id) OVER (PARTITION BY sha256(body)) AS home FROM payloads
)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((((strpos('0123456789abcdef', substr(h, 5 * k // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 5 * k // 4 + 2, 1)) - 1)
             >> (3 - 5 * k % 4)) & 31) + 1, 1) for k in range(32)], '') AS payload_digest,
       CASE WHEN page_id = home THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> home THEN home END AS refers_to
FROM digests
"""

_CONTROL = r"(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])"


def _escaped(column: str) -> str:
    return rf"regexp_replace({column}, '([<\[])(\\*){_CONTROL}', '\1\2\\\3', 'g')"


OP11 = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, k, ['user', 'assistant'][k + 1], '</s>[INST] ok [/INST]' FROM range(2) t(k)
),
whole AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST) AS said,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS learned,
           sum(length({_escaped('role')}) + length({_escaped('text')}) + length('<|im_start|><|im_sep|><|im_end|>')) AS size
    FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(size AS BIGINT) AS formatted_chars
FROM whole
"""

# crc32 bit by bit: DuckDB has no function for it.
OP12 = """
WITH RECURSIVE own AS (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
crc AS (
    SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM own
    UNION ALL
    SELECT conv_id, s, k + 1, list_reduce(list_prepend(xor(c, CAST(ascii(substr(s, k + 1, 1)) AS BIGINT)), range(8)),
        lambda x, b: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
    FROM crc WHERE k < length(s)
),
heads AS (SELECT conv_id, CAST(xor(c, 4294967295) % 9 AS INT) AS h FROM crc WHERE k = length(s)),
rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
    FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
),
steps AS (SELECT conv_id, turns, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
keyed AS (
    SELECT conv_id, n, depth, sha256(CAST(turns[1:depth] AS VARCHAR) || to_json(turns[1:depth])) AS key,
           CASE WHEN depth > 0 THEN sha256(CAST(turns[1:depth - 1] AS VARCHAR) || to_json(turns[1:depth - 1])) END AS parent,
           CASE WHEN depth > 0 THEN octet_length(encode(turns[depth].t)) ELSE 0 END AS size
    FROM steps
),
nodes AS (
    SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = n), '') AS ended
    FROM keyed GROUP BY key, depth
),
children AS (SELECT parent AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (key, depth)),
below AS (  -- every node once for each of its ancestors and itself, by the prefixes of its smallest member
    SELECT a.key, a.depth, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.size) AS saved
    FROM full_nodes d JOIN keyed a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.key, a.depth
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens,
       sha256(n.ended) AS ends_sha256
FROM full_nodes n JOIN below b USING (key, depth) LEFT JOIN nodes p ON p.key = n.parent AND p.depth = n.depth - 1
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH docs AS (SELECT doc_id, len(w) AS n, w FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
sums AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS total FROM docs),
wanted AS (SELECT item_id, term, count(*) AS often FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
postings AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs)
    WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), sums
),
impacts AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // total))) AS part
    FROM postings JOIN weights USING (term), sums
),
scores AS (SELECT item_id, doc_id, CAST(sum(part * often) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL),
places AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM places WHERE rank <= 10
"""
