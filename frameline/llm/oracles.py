"""SQL for DuckDB of the training-data queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _crc32(value: str) -> str:
    """crc32 of a number's decimal digits, bit by bit."""
    digits = f"list_transform(range(1, length(CAST({value} AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST({value} AS VARCHAR), CAST(i AS INTEGER), 1)) AS UBIGINT))"
    bit = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END"
    byte = f"list_reduce(list_prepend(xor(c, b), list_value(0::UBIGINT, 0, 0, 0, 0, 0, 0, 0)), lambda x, k: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {digits}), lambda c, b: {byte}), 4294967295::UBIGINT)"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode({f})) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


ORACLE_SQL: dict[str, str] = {
    # Every prefix is its whole text here, and every node meets all its ancestors.
    "op13_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL
        ), n AS (SELECT conv_id, said, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS i FROM t
        ), c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
        ), r AS (
            SELECT c.conv_id, n.i, n.said, n.chars FROM c JOIN n ON n.conv_id = c.base AND n.i <= c.h
            UNION ALL SELECT c.conv_id, n.i, n.said, n.chars FROM c JOIN n ON n.conv_id = c.conv_id AND n.i > c.h
        ), p AS (SELECT conv_id, chars, row_number() OVER w AS depth, string_agg(said, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)
        ), a AS (
            SELECT conv_id, depth, prefix, chars, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
            UNION ALL SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS chars, conv_id NOT IN (SELECT conv_id FROM p) AS ends FROM c
        ), g AS (
            SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM a GROUP BY depth, prefix
        ), up AS (SELECT g.conv_id, g.depth, o.conv_id AS parent_conv_id FROM g JOIN a ON a.conv_id = g.conv_id AND a.depth = g.depth - 1 JOIN g o ON o.depth = a.depth AND o.prefix = a.prefix
        ), kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY parent_conv_id, depth - 1
        ), f AS (SELECT g.*, up.parent_conv_id, coalesce(kids.n_children, 0) AS n_children FROM g LEFT JOIN up ON up.conv_id = g.conv_id AND up.depth = g.depth LEFT JOIN kids ON kids.conv_id = g.conv_id AND kids.depth = g.depth
        ), s AS (SELECT a.depth, a.prefix, count(CASE WHEN f.n_children = 0 THEN 1 END) AS n_leaves, CAST(sum(f.saved) AS BIGINT) AS saved_tokens FROM f JOIN a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.depth, a.prefix)
        SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256 FROM f JOIN s ON s.depth = f.depth AND s.prefix = f.prefix
    """,
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT *, {_leaf("text")} AS leaf, CASE WHEN {_crc32("doc_id")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents
        ), leaves AS (
            SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
        ), low AS (
            SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
            UNION ALL SELECT tree, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM low WHERE n > 1 GROUP BY tree, level, pos // 16, n
        ), high AS (
            SELECT 0 AS level, tree AS pos, h, count(*) OVER () AS n FROM low WHERE n = 1
            UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM high WHERE n > 1 GROUP BY level, pos // 16, n
        ), sides AS (
            SELECT tree, level, pos, coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
            FROM (SELECT tree, level, pos, h FROM low WHERE n > 1 UNION ALL SELECT -1 AS tree, level, pos, h FROM high WHERE n > 1)
        ), steps AS (
            SELECT l.tree, l.pos, s.level AS step, s.a, s.b FROM leaves l JOIN sides s ON s.tree = l.tree AND s.pos = l.pos // CAST(16 ** s.level AS BIGINT)
            UNION ALL SELECT l.tree, l.pos, 100 + s.level AS step, s.a, s.b FROM leaves l JOIN sides s ON s.tree = -1 AND s.pos = l.tree // CAST(16 ** s.level AS BIGINT)
        ), path AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY step) AS k FROM steps
        ), fold AS (
            SELECT tree, pos, coalesce(changed, leaf) AS h, CAST(0 AS BIGINT) AS k FROM leaves
            UNION ALL SELECT f.tree, f.pos, sha256(p.a || f.h || p.b), p.k FROM fold f JOIN path p ON p.tree = f.tree AND p.pos = f.pos AND p.k = f.k + 1
        ), folded AS (SELECT tree, pos, arg_max(h, k) AS folded_root FROM fold GROUP BY tree, pos
        ), proofs AS (SELECT tree, pos, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256 FROM path GROUP BY tree, pos
        ), roots AS (SELECT tree, h AS subroot FROM low WHERE n = 1)
        SELECT l.doc_id, l.leaf, r.subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.h AS verified
        FROM leaves l JOIN roots r ON r.tree = l.tree JOIN (SELECT h FROM high WHERE n = 1) t ON TRUE JOIN folded f ON f.tree = l.tree AND f.pos = l.pos LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
    """,
    "op3_preference_format": r"""
        WITH said AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS k,
                '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
            FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
        ), c AS (SELECT conv_id, turn, string_agg(role || chr(1) || text, chr(2) ORDER BY k) AS said FROM said GROUP BY conv_id, turn
        ), opening AS (SELECT conv_id, arg_min(said, turn) AS said FROM c GROUP BY conv_id
        ), g AS (SELECT said, min(conv_id) AS chosen_id, count(*) AS many FROM opening GROUP BY said
        ), pairs AS (
            SELECT g.chosen_id, CASE WHEN many > 1 THEN o.conv_id END AS rejected_id FROM opening o JOIN g ON o.said = g.said WHERE o.conv_id <> g.chosen_id OR many = 1
        ), both_sides AS (
            SELECT p.chosen_id, p.rejected_id, c.turn, c.said FROM pairs p JOIN c ON c.conv_id = p.chosen_id WHERE p.rejected_id IS NOT NULL
            UNION ALL SELECT p.chosen_id, p.rejected_id, c.turn, c.said FROM pairs p JOIN c ON c.conv_id = p.rejected_id
        ), met AS (SELECT chosen_id, rejected_id, turn, count(*) AS n, min(said) AS a, max(said) AS b FROM both_sides GROUP BY chosen_id, rejected_id, turn
        ), cut AS (SELECT chosen_id, rejected_id, min(CASE WHEN n < 2 OR a <> b THEN turn END) AS at_turn FROM met GROUP BY chosen_id, rejected_id
        ), marked AS (
            SELECT p.chosen_id, p.rejected_id, cut.at_turn FROM pairs p LEFT JOIN cut ON p.chosen_id = cut.chosen_id AND p.rejected_id = cut.rejected_id
        ), parts AS (
            SELECT m.chosen_id, m.rejected_id, s.turn, s.k, s.role, s.text, s.shown,
                CASE WHEN m.rejected_id IS NOT NULL AND (m.at_turn IS NULL OR s.turn < m.at_turn) THEN 'prompt' ELSE 'chosen' END AS part
            FROM marked m JOIN said s ON s.conv_id = m.chosen_id
            UNION ALL
            SELECT m.chosen_id, m.rejected_id, s.turn, s.k, s.role, s.text, s.shown, 'rejected' AS part
            FROM marked m JOIN said s ON s.conv_id = m.rejected_id WHERE m.at_turn IS NOT NULL AND s.turn >= m.at_turn
        ), placed AS (
            SELECT *, sum(length(shown)) OVER (PARTITION BY chosen_id, rejected_id, part ORDER BY turn, k ROWS UNBOUNDED PRECEDING) AS stop FROM parts
        ), spans AS (
            SELECT *, CASE WHEN role = 'assistant' THEN CAST(CAST(stop AS BIGINT) - length(text) - 8 AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR) END AS span FROM placed
        )
        SELECT chosen_id, rejected_id, count(DISTINCT CASE WHEN part = 'prompt' THEN turn END) AS prompt_turns,
            coalesce(string_agg(CASE WHEN part = 'prompt' THEN shown END, '' ORDER BY turn, k), '') AS prompt,
            coalesce(string_agg(CASE WHEN part = 'chosen' THEN shown END, '' ORDER BY turn, k), '') AS chosen,
            coalesce(string_agg(CASE WHEN part = 'chosen' THEN span END, ',' ORDER BY turn, k), '') AS chosen_spans,
            CASE WHEN rejected_id IS NOT NULL THEN coalesce(string_agg(CASE WHEN part = 'rejected' THEN shown END, '' ORDER BY turn, k), '') END AS rejected,
            CASE WHEN rejected_id IS NOT NULL THEN coalesce(string_agg(CASE WHEN part = 'rejected' THEN span END, ',' ORDER BY turn, k), '') END AS rejected_spans
        FROM spans GROUP BY chosen_id, rejected_id
    """,
    # Every two different sets that share a shingle are compared, and links are followed until nothing new is reached.
    "op5_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM d
        ), n AS (SELECT doc_id, count(*) AS n_shingles, md5(string_agg(g, chr(10) ORDER BY g)) AS body FROM s GROUP BY doc_id
        ), b AS (SELECT body, min(doc_id) AS a, any_value(n_shingles) AS n FROM n GROUP BY body
        ), h AS (SELECT b.a, b.n, s.g FROM b JOIN s ON s.doc_id = b.a
        ), l AS (SELECT x.a, y.a AS z FROM h x JOIN h y ON x.g = y.g AND x.a <> y.a GROUP BY x.a, y.a, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
        ), r AS (SELECT a, a AS z FROM b UNION SELECT r.a, l.z FROM r JOIN l ON r.z = l.a
        ), c AS (SELECT a, min(z) AS component_id FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n.n_shingles, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN b ON b.body = n.body LEFT JOIN c ON c.a = b.a
    """,
    "op6_warc": """
        WITH r AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), w AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM r
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
        FROM w
    """,
    # All windows of all documents: a window without a shingle of the item has a similarity of 0 and needs no row.
    "op7_decontamination": f"""
        WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
        ds AS (SELECT doc_id, body, len(w) AS m, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS h FROM (SELECT doc_id, w, hash(w) AS body, unnest(range(0, len(w) - 4)) AS pos FROM d WHERE len(w) >= 5)),
        bs AS (SELECT item_id, body, len(w) AS size, array_to_string(w[ofs + 1:ofs + 5], ' ') AS h FROM (SELECT item_id, w, hash(w) AS body, unnest(range(0, len(w) - 4)) AS ofs FROM b WHERE len(w) >= 5)),
        bw AS (SELECT item_id, body AS item, size, h, count(*) AS weight FROM bs GROUP BY item_id, body, size, h),
        hits AS (SELECT doc_id, body, m, item_id, item, size, weight, pos, ds.h, least(size - 4, m - 4) AS width, greatest(m - size, 0) AS final FROM ds JOIN bw ON ds.h = bw.h),
        placed AS (SELECT *, unnest(range(greatest(pos - width + 1, 0), least(pos, final) + 1)) AS start FROM hits),
        have AS (SELECT doc_id, body, item_id, item, size, width, start, h, weight, count(*) AS c FROM placed GROUP BY ALL),
        com AS (SELECT doc_id, body, item_id, item, size, width, start, sum(least(c, weight)) AS s FROM have GROUP BY ALL),
        sim AS (SELECT doc_id, item_id, start, CAST(s AS DOUBLE) / CAST(width + size - 4 - s AS DOUBLE) AS similarity FROM com)
        SELECT doc_id, item_id, similarity, CAST(start AS BIGINT) AS word_start FROM sim WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
    """,
}
