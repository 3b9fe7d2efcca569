"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

SPACE_CLASS = r"[\x20\x09-\x0D]"


def crc32(text: str) -> str:
    """SQL for the checksum of an ASCII text, bit by bit."""
    bit = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: {bit})"
    letters = f"list_transform(string_split({text}, ''), lambda l: CAST(ord(l) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda c, b: {byte}), 4294967295)"


def _field(x: str) -> str:
    return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


_HEAD = " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars"))
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Nodes ``(tree, level, pos)``; languages are trees 1, 2, .. and their roots the leaves of tree 0.
MANIFEST = f"""
WITH RECURSIVE raw AS (
    SELECT doc_id, lang, sha256({_HEAD} || {_field("text")}) AS leaf, sha256({_HEAD} || {_field(_LOW)}) AS low,
           coalesce({crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0, false) AS tampered
    FROM documents),
leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, count(*) OVER (PARTITION BY lang) AS n,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM raw),
forest AS (
    SELECT tree, 0 AS level, pos, leaf AS node, n FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8
    FROM forest WHERE n > 1 GROUP BY tree, level, pos // 8),
roots AS (SELECT tree, node, level FROM forest WHERE n = 1),
top AS (
    SELECT 0::BIGINT AS tree, 0 AS level, tree - 1 AS pos, node, count(*) OVER () AS n FROM roots
    UNION ALL
    SELECT 0, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8
    FROM top WHERE n > 1 GROUP BY level, pos // 8),
nodes AS (SELECT * FROM forest UNION ALL SELECT * FROM top),
steps AS (
    SELECT a.tree, a.level, a.pos, a.tree AS up_tree, a.level + 1 AS up_level, a.pos // 8 AS up_pos,
           coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
           coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
    UNION ALL
    SELECT tree, level, 0, 0, 0, tree - 1, NULL, NULL FROM roots),
walk AS (
    SELECT tree AS home, pos AS place, tree, 0 AS level, pos, CASE WHEN tampered THEN low ELSE leaf END AS node, '' AS proof FROM leaves
    UNION ALL
    SELECT w.home, w.place, s.up_tree, s.up_level, s.up_pos,
           CASE WHEN s.before IS NULL THEN w.node ELSE sha256(s.before || w.node || s.after) END, w.proof || coalesce(s.before || s.after, '')
    FROM walk w JOIN steps s ON w.tree = s.tree AND w.level = s.level AND w.pos = s.pos),
final AS (SELECT level, node FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, r.node AS subroot, f.node AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = f.node AS verified
FROM leaves l JOIN roots r ON r.tree = l.tree JOIN walk w ON w.home = l.tree AND w.place = l.pos JOIN final f ON w.tree = 0 AND w.level = f.level
"""

_TEXT = "regexp_replace(text, '[.!?]', '', 'g')"
_FULL = f"regexp_replace(regexp_replace(text, '^{SPACE_CLASS}+', ''), '{SPACE_CLASS}+$', '')"

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. ``c0`` to ``c3`` are the costs from a row on.
REPAIR = f"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS draw
    FROM conversations),
hurt AS (
    SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
           CASE draw WHEN 1 THEN '' WHEN 2 THEN {_TEXT} ELSE text END AS text
    FROM keyed, range(2) r(i) WHERE draw <> 0 AND (i = 0 OR draw = 3)),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
    SELECT c, turn, role, text, left(role, 1) AS initial, {_FULL} AS trimmed,
           row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY c) AS n
    FROM hurt h JOIN ids ON h.conv_id IS NOT DISTINCT FROM ids.conv_id WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text))),
coded AS (
    SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'duplicate'
                   WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
           lag(initial) OVER (PARTITION BY c ORDER BY pos) AS earlier FROM placed),
priced AS (
    SELECT c, pos, n, role, text, initial, fault, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM coded),
back AS (
    SELECT DISTINCT c, n AS pos, 0 AS c0, 10 AS c1, 5 AS c2, 0 AS c3 FROM priced
    UNION ALL
    SELECT c, pos, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3, 10 + b2), least(b3, 5 + b2, 10 + b3) FROM (
        SELECT p.c, p.pos,
            least(2 + c0, CASE WHEN must THEN 99999999 ELSE extra + least(1 + c2, CASE initial WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 99999999 END) END) AS b0,
            least(2 + c1, CASE WHEN must THEN 99999999 ELSE extra + least(1 + c2, CASE initial WHEN 'u' THEN c2 ELSE 99999999 END) END) AS b1,
            least(2 + c2, CASE WHEN must THEN 99999999 ELSE extra + least(1 + c3, CASE initial WHEN 'a' THEN c3 ELSE 99999999 END) END) AS b2,
            least(2 + c3, CASE WHEN must THEN 99999999 ELSE extra + least(1 + c2, CASE initial WHEN 'u' THEN c2 ELSE 99999999 END) END) AS b3
        FROM back JOIN priced p ON p.c = back.c AND p.pos = back.pos - 1)),
costs AS (
    SELECT b.c, b.pos, [c0, c1, c2, c3] AS now, p.role, p.text, p.initial, p.must, p.extra,
           lead([c0, c1, c2, c3]) OVER (PARTITION BY b.c ORDER BY b.pos) AS next
    FROM back b LEFT JOIN priced p ON p.c = b.c AND p.pos = b.pos),
walk AS (
    SELECT c, 0 AS pos, 1 AS state, '' AS audit, '' AS lines, false AS over FROM costs WHERE pos = 0
    UNION ALL
    SELECT c, CASE WHEN letter IN ('I', '') THEN pos ELSE pos + 1 END,
           CASE letter WHEN 'D' THEN state WHEN '' THEN state WHEN 'K' THEN CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE fits END,
           audit || letter,
           CASE WHEN letter IN ('D', '') THEN lines ELSE lines || CASE WHEN lines = '' THEN '' ELSE chr(10) END
                || CASE letter WHEN 'K' THEN role || ':' || text WHEN 'R' THEN name || ':' || text ELSE name || ':' END END,
           letter = ''
    FROM (
        SELECT w.*, k.initial, k.role, k.text, fits, name,
            CASE WHEN next IS NOT NULL AND 2 + next[state] = now[state] THEN 'D'
                 WHEN 5 + now[fits] = now[state] THEN 'I'
                 WHEN next IS NULL THEN ''
                 WHEN (initial = 's' AND state = 1 AND extra + next[2] = now[state]) OR (initial = 'u' AND fits = 3 AND extra + next[3] = now[state])
                      OR (initial = 'a' AND fits = 4 AND extra + next[4] = now[state]) THEN 'K'
                 ELSE 'R' END AS letter
        FROM (SELECT *, CASE WHEN state = 3 THEN 4 ELSE 3 END AS fits, CASE WHEN state = 3 THEN 'assistant' ELSE 'user' END AS name FROM walk WHERE NOT over) w
        JOIN costs k ON k.c = w.c AND k.pos = w.pos)),
facts AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pos > 0 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM coded GROUP BY c)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(k.now[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM ids i LEFT JOIN facts f ON f.c = i.c LEFT JOIN costs k ON k.c = i.c AND k.pos = 0 LEFT JOIN (SELECT * FROM walk WHERE over) w ON w.c = i.c
"""

_WORD = r"'[^\x20\x09-\x0D]+'"


def _dropped(pattern: str) -> str:
    """SQL for the number of characters of one class."""
    return f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"


#: Windows of five words, found by a look ahead; words under a window that occurs twice are counted once.
RULES = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
    SELECT r, doc_id, text, regexp_extract_all(text, {_WORD}) AS words,
           list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {_WORD})) AS lines FROM docs),
placed AS (
    SELECT r, unnest(words) AS w, unnest(range(len(words))) AS pos FROM parts),
windows AS (
    SELECT r, pos, [w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d] AS five FROM placed
    WINDOW d AS (PARTITION BY r ORDER BY pos)),
found AS (
    SELECT r, pos FROM windows WHERE five[5] IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
covered AS (
    SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(pos, pos + 5)) AS place FROM found) GROUP BY r),
measures AS (
    SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{SPACE_CLASS}+', '', 'g')) AS word_chars,
           {_dropped("[#*$%&|<>]")} AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(n, 0) AS n_repeat_words, {_dropped("!")} AS n_exclamations, {_dropped("[A-Z]")} AS n_capitals
    FROM parts LEFT JOIN covered USING (r)),
base AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_exclamations > n_words OR 2 * n_capitals > word_chars) AS kept
FROM base
"""

#: Every two sets that share a shingle are compared, sets that are equal once; then labels spread until none changes.
NEAR = f"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all({_LOW.replace("text", "coalesce(text, '')")}, {_WORD}) AS w FROM documents),
shingles AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                        ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM cut),
known AS (
    SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id, s FROM shingles),
classes AS (
    SELECT class_id, n, unnest(s) AS shingle FROM known WHERE class_id = doc_id),
links AS (
    SELECT a.class_id AS a, b.class_id AS b FROM classes a JOIN classes b USING (shingle)
    WHERE a.class_id <> b.class_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
    GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
    SELECT class_id AS a, class_id AS label FROM known
    UNION
    SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.a),
labels AS (
    SELECT a, min(label) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept, class_id
FROM known JOIN labels ON a = class_id
"""
