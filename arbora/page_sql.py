"""The page plan in SQL, for DuckDB, over a table ``contents_pages`` (doc_id, physical_index, text).

It compares every title with every page, and follows gaps by recursion: for small tables.
"""

from __future__ import annotations

_SQUEEZED = r"lower(regexp_replace({}, '[ \t\n\r\f\v]+', '', 'g'))"
_HEAD = r"regexp_replace(string_split(text, chr(10))[1], '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"
_ENDING = r"(?m)[0-9][ \t]*$"
_LINE = r"^\s*((?:\d+\.)*\d+)?\.?\s*(.*?)[\s.:]*(\d+)?\s*$"
_BEFORE, _AFTER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"


def _accepted(name: str, items: str, pages: str, counts: str) -> list[str]:
    """Tables up to ``name`` (d, k, structure, title, pg): the ``items`` of documents d whose items are right, or mostly and mended."""
    parts = [
        f"{name}_i AS (SELECT i.d, k, structure, title, {_SQUEEZED.format('title')} AS t, CASE WHEN pg <= n_pages THEN pg END AS pg, n_pages FROM {items} i JOIN {counts} c ON c.d = i.d WHERE pg IS NOT NULL)",
        f"{name}_v AS MATERIALIZED (SELECT i.*, pg IS NOT NULL AND NOT coalesce(contains(g.s, i.t), false) AS wrong FROM {name}_i i LEFT JOIN {pages} g ON g.d = i.d AND g.physical_index = i.pg)",
        f"""{name}_g AS (SELECT d, CASE WHEN last IS NULL OR last < n_pages / 2 THEN 'no' WHEN w = 0 THEN 'accept' WHEN (n - w) / n > 0.6 THEN 'repair' ELSE 'no' END AS decision
  FROM (SELECT d, any_value(n_pages) AS n_pages, count(pg) AS n, count(*) FILTER (wrong) AS w, arg_max(pg, k) FILTER (pg IS NOT NULL) AS last FROM {name}_v GROUP BY d))""",
        f"{name}_r0 AS (SELECT v.* FROM {name}_v v JOIN {name}_g g ON g.d = v.d AND decision = 'repair')",
    ]
    for r in range(3):
        parts += [
            f"""{name}_x{r} AS (SELECT *, coalesce(last_value(CASE WHEN NOT wrong THEN pg END IGNORE NULLS) OVER (PARTITION BY d ORDER BY k {_BEFORE}), 0) AS low,
  coalesce(first_value(CASE WHEN NOT wrong THEN pg END IGNORE NULLS) OVER (PARTITION BY d ORDER BY k {_AFTER}), n_pages) AS high FROM {name}_r{r})""",
            f"{name}_f{r} AS (SELECT x.d, x.k, min(g.physical_index) AS fixed FROM {name}_x{r} x JOIN {pages} g ON g.d = x.d AND g.physical_index BETWEEN low AND high AND contains(g.s, x.t) WHERE wrong GROUP BY x.d, x.k)",
            f"{name}_r{r + 1} AS MATERIALIZED (SELECT x.d, x.k, structure, title, t, coalesce(fixed, pg) AS pg, n_pages, wrong AND fixed IS NULL AS wrong FROM {name}_r{r} x LEFT JOIN {name}_f{r} f ON f.d = x.d AND f.k = x.k)",
        ]
    return [*parts, f"{name} AS MATERIALIZED (SELECT v.d, k, structure, title, pg FROM {name}_v v JOIN {name}_g g ON g.d = v.d AND decision = 'accept' UNION ALL SELECT d, k, structure, title, pg FROM {name}_r3)"]


def _spans(name: str, items: str, pages: str, ends: str) -> list[str]:
    """Table ``name``: the items that have a page, with s and e; ``ends`` (d, last) has where documents end."""
    return [
        f"{name}_b AS (SELECT i.*, coalesce(starts_with(g.s, {_SQUEEZED.format('i.title')}), false) AS begins FROM {items} i LEFT JOIN {pages} g ON g.d = i.d AND g.physical_index = i.pg WHERE pg IS NOT NULL)",
        f"""{name} AS MATERIALIZED (SELECT b.d, k, structure, title, pg AS s, CASE WHEN lead(k) OVER w IS NULL THEN last WHEN lead(begins) OVER w THEN lead(pg) OVER w - 1 ELSE lead(pg) OVER w END AS e
  FROM {name}_b b JOIN {ends} z ON z.d = b.d WINDOW w AS (PARTITION BY b.d ORDER BY k))""",
    ]


def page_plan(toc_limit: int, most_pages: int, most_tokens: int, summary: int = 200) -> str:
    parts = [
        f"pages AS MATERIALIZED (SELECT doc_id AS d, physical_index, text, {_SQUEEZED.format('text')} AS s, {_HEAD} AS head, length(text) // 4 AS n_tokens, len(regexp_extract_all(text, '{_ENDING}')) >= 3 AS toc FROM contents_pages)",
        "counts AS (SELECT d, count(*) AS n_pages FROM pages GROUP BY d)",
        # Tables of contents: of all runs of such pages that begin within the limit the first with page numbers, else the first.
        "marked AS (SELECT *, sum(CASE WHEN toc THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY physical_index) AS run FROM pages)",
        rf"""tocs AS (SELECT d, run, max(physical_index) AS last_page, regexp_replace(regexp_replace(string_agg(text, '' ORDER BY physical_index), '\.{{5,}}', ': ', 'g'), '(?:\. ){{5,}}\.?', ': ', 'g') AS toc_text
  FROM marked WHERE toc GROUP BY d, run HAVING min(physical_index) <= {toc_limit})""",
        rf"""judged AS (SELECT *, 2 * len(regexp_extract_all(toc_text, '{_ENDING}')) > len(regexp_extract_all(toc_text, '(?m)\S[ \t]*$')) AS numbered FROM tocs)""",
        "chosen AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY d ORDER BY numbered DESC, run) = 1)",
        f"""lines AS (SELECT d, last_page, i, regexp_extract(line, '{_LINE}', ['structure', 'title', 'page']) AS x FROM (SELECT d, last_page, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT d, last_page, string_split(toc_text, chr(10)) AS l FROM chosen WHERE numbered)))""",
        """listed AS MATERIALIZED (SELECT d, last_page, row_number() OVER (PARTITION BY d ORDER BY i) - 1 AS k, nullif(x.structure, '') AS structure, x.title AS title, try_cast(x.page AS INT) AS page
  FROM lines WHERE x.title <> '' AND (x.structure <> '' OR x.page <> ''))""",
        f"named AS (SELECT *, {_SQUEEZED.format('title')} AS t FROM listed)",
        # By numbers: the usual difference of page and number, and what has no number between its neighbours, one after another.
        f"shown AS (SELECT n.d, n.k, n.title, n.last_page, min(physical_index) AS pg FROM named n JOIN pages p ON p.d = n.d AND physical_index > last_page AND physical_index <= last_page + {toc_limit} AND contains(p.s, n.t) GROUP BY ALL)",
        "differences AS (SELECT x.d, x.pg - y.page AS difference, count(*) AS n, min([x.k, y.k]) AS first FROM shown x JOIN listed y ON y.d = x.d AND y.title = x.title AND y.page IS NOT NULL WHERE x.pg >= x.last_page GROUP BY ALL)",
        "offsets AS (SELECT d, difference FROM differences QUALIFY row_number() OVER (PARTITION BY d ORDER BY n DESC, first) = 1)",
        "numbered AS (SELECT n.d, n.k, n.structure, n.title, n.t, n.page + o.difference AS pg FROM named n LEFT JOIN offsets o ON o.d = n.d)",
        f"waiting AS (SELECT n.*, first_value(n.pg IGNORE NULLS) OVER (PARTITION BY n.d ORDER BY k {_AFTER}) AS next FROM numbered n)",
        "hits AS (SELECT w.d, w.k, list(physical_index ORDER BY physical_index) AS on_pages FROM waiting w JOIN pages p ON p.d = w.d AND contains(p.s, w.t) WHERE w.pg IS NULL AND next IS NOT NULL GROUP BY w.d, w.k)",
        "steps AS MATERIALIZED (SELECT w.*, on_pages FROM waiting w LEFT JOIN hits h ON h.d = w.d AND h.k = w.k)",
        """walked(d, k, found, low) AS (
  SELECT DISTINCT d, CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM steps
  UNION ALL SELECT s.d, s.k, coalesce(s.pg, list_filter(s.on_pages, lambda p: p BETWEEN w.low AND s.next)[1]), coalesce(s.pg, list_filter(s.on_pages, lambda p: p BETWEEN w.low AND s.next)[1], w.low) FROM walked w JOIN steps s ON s.d = w.d AND s.k = w.k + 1)""",
        "by_numbers AS (SELECT n.d, n.k, n.structure, n.title, w.found AS pg FROM numbered n JOIN walked w ON w.d = n.d AND w.k = n.k)",
        *_accepted("way_1", "by_numbers", "pages", "counts"),
        "by_titles AS (SELECT n.d, n.k, n.structure, n.title, min(physical_index) AS pg FROM named n LEFT JOIN pages p ON p.d = n.d AND physical_index > last_page AND contains(p.s, n.t) WHERE n.d NOT IN (SELECT d FROM way_1) GROUP BY ALL)",
        *_accepted("way_2", "by_titles", "pages", "counts"),
        """by_heads AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY physical_index) - 1 AS k, CAST(row_number() OVER (PARTITION BY d ORDER BY physical_index) AS VARCHAR) AS structure, head AS title, physical_index AS pg
  FROM pages WHERE head <> '' AND length(head) <= 80 AND d NOT IN (SELECT d FROM way_1) AND d NOT IN (SELECT d FROM way_2))""",
        *_accepted("way_3", "by_heads", "pages", "counts"),
        "sections AS MATERIALIZED (SELECT * FROM way_1 UNION ALL SELECT * FROM way_2 UNION ALL SELECT * FROM way_3)",
        # The tree: a preface, spans, parents by code.
        """prefaced AS (SELECT d, k, structure, title, pg FROM sections UNION ALL SELECT d, k - 1, '0', 'Preface', 1 FROM (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY d ORDER BY k) = 1) WHERE pg > 1)""",
        "ends AS (SELECT d, n_pages AS last FROM counts)",
        *_spans("spanned", "prefaced", "pages", "ends"),
        r"""parented AS MATERIALIZED (SELECT x.*, (SELECT max(y.k) FROM spanned y WHERE y.d = x.d AND y.k < x.k AND contains(x.structure, '.') AND y.structure = regexp_replace(x.structure, '\.[^.]*$', '')) AS parent FROM spanned x)""",
        """paths(d, k, path) AS (SELECT d, k, [k] FROM parented WHERE parent IS NULL UNION ALL SELECT c.d, c.k, list_append(p.path, c.k) FROM paths p JOIN parented c ON c.d = p.d AND c.parent = p.k)""",
        "flat AS MATERIALIZED (SELECT p.d, path, title, s, e FROM paths p JOIN parented x ON x.d = p.d AND x.k = p.k)",
        # What is too large is split by its pages, each such node being a document of its own.
        f"large AS MATERIALIZED (SELECT f.d, path, title, f.s, f.e FROM flat f JOIN pages p ON p.d = f.d AND physical_index BETWEEN f.s AND f.e WHERE f.e - f.s > {most_pages} GROUP BY ALL HAVING sum(n_tokens) >= {most_tokens})",
        "part_pages AS MATERIALIZED (SELECT {'d': l.d, 'path': l.path} AS d, physical_index, p.s, head FROM large l JOIN pages p ON p.d = l.d AND physical_index BETWEEN l.s AND l.e)",
        "part_counts AS (SELECT d, max(physical_index) AS n_pages FROM part_pages GROUP BY d)",
        "part_heads AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY physical_index) - 1 AS k, NULL AS structure, head AS title, physical_index AS pg FROM part_pages WHERE head <> '' AND length(head) <= 80)",
        *_accepted("parts", "part_heads", "part_pages", "part_counts"),
        "part_items AS (SELECT p.*, l.e AS last, l.title AS own, row_number() OVER (PARTITION BY p.d ORDER BY k) AS n FROM parts p JOIN large l ON l.d = p.d.d AND l.path = p.d.path WHERE pg IS NOT NULL)",
        "part_rest AS (SELECT d, k, structure, title, pg FROM part_items WHERE NOT (n = 1 AND trim(title) = trim(own)))",
        "part_ends AS (SELECT {'d': d, 'path': path} AS d, e AS last FROM large)",
        *_spans("part_spans", "part_rest", "part_pages", "part_ends"),
        "begun AS (SELECT d, arg_min(s, k) AS s FROM part_spans GROUP BY d)",
        """nodes AS MATERIALIZED (
  SELECT f.d, f.path, f.title, f.s, coalesce(b.s, f.e) AS e FROM flat f LEFT JOIN begun b ON b.d = {'d': f.d, 'path': f.path}
  WHERE NOT EXISTS (SELECT 1 FROM large l WHERE l.d = f.d AND len(f.path) > len(l.path) AND f.path[1:len(l.path)] = l.path)
  UNION ALL SELECT p.d.d, list_append(p.d.path, p.k), title, p.s, p.e FROM part_spans p)""",
        """ordered AS (SELECT *, row_number() OVER w - 1 AS node_ord, coalesce(lead(len(path)) OVER w > len(path), false) AS inner_node FROM nodes WINDOW w AS (PARTITION BY d ORDER BY path))""",
        "texts AS (SELECT n.d, n.path, string_agg(p.text, '' ORDER BY physical_index) AS text FROM nodes n JOIN pages p ON p.d = n.d AND physical_index BETWEEN n.s AND n.e GROUP BY ALL)",
    ]
    return (
        "WITH RECURSIVE "
        + ",\n".join(parts)
        + f"""
SELECT o.d AS doc_id, o.path, o.title, CAST(o.s AS INT) AS start_index, CAST(o.e AS BIGINT) AS end_index, CAST(len(o.path) - 1 AS INT) AS depth, NOT inner_node AS is_leaf, CAST(node_ord AS BIGINT) AS node_ord,
  lpad(CAST(node_ord AS VARCHAR), CAST(greatest(4, length(CAST(node_ord AS VARCHAR))) AS INT), '0') AS node_id, substr(coalesce(t.text, ''), 1, {summary}) AS summary
FROM ordered o LEFT JOIN texts t ON t.d = o.d AND t.path = o.path"""
    )
