"""Independent SQL statements of the registered queries, for DuckDB.

They follow the definitions and not the Spark code: chunks by a fold over strings, K-means by a
recursive query, neighbours by comparing all pairs.
"""

from __future__ import annotations

from textwrap import dedent

DIM = 64


def paragraphs(t: str) -> str:
    lines = f"list_transform(string_split({t}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)))"
    joined = f"trim(array_to_string({lines}, chr(10)), chr(10))"
    parts = f"string_split_regex({joined}, '\\n\\n+')"
    return f"list_filter(list_transform({parts}, lambda x: replace(x, chr(10), ' ')), lambda x: x <> '')"


def sentences(p: str) -> str:
    marked = rf"regexp_replace({p}, '([.!?。？！])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda x: x <> '')"


def pack(p: str, size: int) -> str:
    fold = (
        f"list_reduce({sentences(p)}, lambda a, s: CASE WHEN a.c = '' THEN {{'b': a.b, 'c': s}} "
        f"WHEN length(a.c) + 1 + length(s) <= {size} THEN {{'b': a.b, 'c': a.c || ' ' || s}} "
        "ELSE {'b': list_append(a.b, a.c), 'c': s} END, {'b': []::VARCHAR[], 'c': ''})"
    )
    packed = f"list_transform([{fold}], lambda r: list_append(r.b, r.c))[1]"
    return f"CASE WHEN length({p}) <= {size} THEN [{p}] ELSE {packed} END"


def blocks(t: str, size: int) -> str:
    return f"flatten(list_transform({paragraphs(t)}, lambda p: {pack('p', size)}))"


def assemble(b: str, lo: int, hi: int, overlap: int) -> str:
    tail = f"trim(right(a.b, {overlap}) || ' ' || s)"
    shrunk = (
        f"CASE WHEN {hi} - length(s) - 1 > 0 THEN trim(right(a.b, {hi} - length(s) - 1) || ' ' || s) ELSE s END"
    )
    fold = (
        f"list_reduce({b}, lambda a, s: CASE WHEN a.b = '' THEN {{'o': a.o, 'b': s}} "
        f"WHEN length(a.b) + 1 + length(s) <= {hi} THEN {{'o': a.o, 'b': a.b || ' ' || s}} "
        f"WHEN length(a.b) < {lo} THEN {{'o': list_append(a.o, a.b), 'b': s}} "
        f"ELSE {{'o': list_append(a.o, a.b), 'b': CASE WHEN length({tail}) <= {hi} THEN {tail} ELSE {shrunk} END}} END, "
        "{'o': []::VARCHAR[], 'b': ''})"
    )
    return f"list_transform([{fold}], lambda r: CASE WHEN r.b = '' THEN r.o ELSE list_append(r.o, r.b) END)[1]"


def chunks(t: str, size: tuple[int, int, int]) -> str:
    lo, hi, overlap = size
    return assemble(blocks(t, hi), lo, hi, overlap)


def words(t: str) -> str:
    return rf"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')"


def counts(t: str, dim: int = DIM) -> str:
    found = f"list_transform({words(t)}, lambda w: ('0x' || substr(md5(w), 1, 7))::INT % {dim})"
    return (
        f"list_transform([{found}], lambda f: list_transform(range({dim}), "
        "lambda b: len(list_filter(f, lambda x: x = b))::DOUBLE))[1]"
    )


def normalized(v: str) -> str:
    norm = "greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12)"
    return (
        f"list_transform([{v}], lambda v: list_transform([{norm}], "
        "lambda n: list_transform(v, lambda x: x / n))[1])[1]"
    )


def embed(t: str, dim: int = DIM) -> str:
    return normalized(counts(t, dim))


def keywords(t: str, limit: int = 5) -> str:
    """First distinct words of two or more characters, joined with spaces."""
    kept = f"list_filter({words(t)}, lambda w: length(w) >= 2)"
    first = f"list_transform([{kept}], lambda k: list_filter(k, lambda w, i: list_position(k, w) = i))[1]"
    return f"array_to_string(list_slice({first}, 1, {limit}), ' ')"


def language(t: str) -> str:
    return (
        f"CASE WHEN regexp_matches({t}, '[가-힣]') THEN 'ko' "
        f"WHEN regexp_matches({t}, '[a-zA-Z]') THEN 'en' END"
    )


CLUSTER_COUNT = "least(12, greatest(1, ceil(sqrt(n))::INT), n::INT)"
EMBEDDED = (
    "src AS (SELECT vec_id % 20 AS doc_id, (vec_id // 20)::INT AS i, "
    "embedding::DOUBLE[] AS v FROM embeddings)"
)


def first_centroids() -> str:
    return dedent(f"""
        sizes AS (SELECT doc_id, count(*) AS n FROM src GROUP BY doc_id),
        init AS (
          SELECT doc_id, i AS c, v AS m FROM src JOIN sizes USING (doc_id) WHERE i < {CLUSTER_COUNT}
        )""").strip()


def nearest(centroids: str, rows: str = "src") -> str:
    return (
        f"SELECT s.doc_id, s.i, min({{'d': round(list_distance(s.v, k.m) ** 2, 9), 'c': k.c}}) AS b "
        f"FROM {rows} s JOIN {centroids} k USING (doc_id) GROUP BY s.doc_id, s.i"
    )


def means(assigned: str) -> str:
    return (
        "SELECT doc_id, c, list(x ORDER BY j) AS m FROM ("
        f"SELECT a.doc_id, a.c, g.j, avg(s.v[g.j]) AS x FROM {assigned} a JOIN src s USING (doc_id, i), "
        f"range(1, {DIM + 1}) g(j) GROUP BY a.doc_id, a.c, g.j) GROUP BY doc_id, c"
    )


def kmeans() -> str:
    """CTEs up to ``placed(doc_id, i, c, d)``; they read ``src(doc_id, i, v)``."""
    return first_centroids() + "," + dedent(f"""
        steps AS (
          SELECT 1 AS r, doc_id, i, b.c AS c, b.c <> 0 AS moved FROM ({nearest('init')})
          UNION ALL (
            WITH act AS (
              SELECT * FROM steps WHERE r < 50 AND doc_id IN (SELECT doc_id FROM steps WHERE moved)
            ),
            upd AS (
              SELECT k.doc_id, k.c, coalesce(q.m, k.m) AS m
              FROM init k LEFT JOIN ({means('act')}) q USING (doc_id, c)
              WHERE k.doc_id IN (SELECT doc_id FROM act)
            )
            SELECT a.r + 1, a.doc_id, a.i, n.b.c, n.b.c <> a.c
            FROM act a JOIN ({nearest('upd')}) n USING (doc_id, i)
          )
        ),
        last AS (SELECT doc_id, max(r) AS r FROM steps GROUP BY doc_id),
        fin AS (SELECT s.doc_id, s.i, s.c, s.r, s.moved FROM steps s JOIN last USING (doc_id, r)),
        still AS (SELECT doc_id FROM fin GROUP BY doc_id HAVING max(r) = 1 AND NOT bool_or(moved)),
        centre AS (
          SELECT k.doc_id, k.c,
                 CASE WHEN k.doc_id IN (SELECT doc_id FROM still) THEN k.m ELSE coalesce(q.m, k.m) END AS m
          FROM init k LEFT JOIN ({means('fin')}) q USING (doc_id, c)
        ),
        placed AS (
          SELECT f.doc_id, f.i, f.c, round(list_distance(s.v, k.m) ** 2, 9) AS d
          FROM fin f JOIN src s USING (doc_id, i) JOIN centre k ON k.doc_id = f.doc_id AND k.c = f.c
        )""")


def representatives(least: int = 2, top: int = 3, ratio: float = 1.2) -> str:
    """CTEs from ``placed`` and ``src`` (with text ``t``) to ``chosen``: one row per representative."""
    return dedent(f"""
        sized AS (SELECT doc_id, c, count(*) AS n, list(i ORDER BY i) AS members FROM placed GROUP BY doc_id, c),
        ranked AS (
          SELECT p.*, s.t, z.n,
                 row_number() OVER (PARTITION BY p.doc_id, p.c ORDER BY p.d, length(s.t), p.i) AS rank,
                 min(p.d) OVER (PARTITION BY p.doc_id, p.c) AS best
          FROM placed p JOIN src s USING (doc_id, i) JOIN sized z ON z.doc_id = p.doc_id AND z.c = p.c
          WHERE z.n >= {least}
        ),
        topk AS (
          SELECT * FROM ranked
          WHERE rank <= {top} AND (d <= best * {ratio}::DOUBLE OR abs(d - best) <= 1e-9 * greatest(abs(d), abs(best)))
        ),
        seen AS (
          SELECT *, row_number() OVER (PARTITION BY doc_id, trim(t, ' ' || chr(9) || chr(10) || chr(13))
                                       ORDER BY n DESC, c, rank) AS nth
          FROM topk WHERE trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> ''
        ),
        chosen AS (SELECT doc_id, c, rank, i, t, d FROM seen WHERE nth = 1)""")


def document_results(size: tuple[int, int, int], min_sentences: int = 8) -> str:
    """CTEs up to ``result``; the whole document pipeline on the hashed-words embedder."""
    return "WITH RECURSIVE " + dedent(f"""
        base AS (
          SELECT doc_id, text, strlen(text) AS bytes,
                 CASE WHEN text IS NULL THEN 'ERROR' WHEN strlen(text) > 5242880 THEN 'TEXT_TOO_LARGE'
                      WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'NO_CONTENT' ELSE 'OK' END AS status
          FROM documents
        ),
        cut AS (
          SELECT doc_id, status, bytes,
                 CASE WHEN status = 'OK' THEN {chunks('text', size)} ELSE []::VARCHAR[] END AS cs
          FROM base
        ),
        pieces AS (
          SELECT doc_id, len(cs) AS n, (g.j - 1)::INT AS i, cs[g.j] AS t
          FROM cut, unnest(range(1, len(cs) + 1)) g(j)
        ),
        src AS (SELECT doc_id, i, t, {embed('t')} AS v FROM pieces WHERE n >= {min_sentences}),
        """) + kmeans() + "," + representatives() + "," + dedent(f"""
        clustered AS (
          SELECT q.doc_id, q.c, list(q.i ORDER BY q.rank) AS ids, list(q.t ORDER BY q.rank) AS ts,
                 any_value(z.members) AS members
          FROM chosen q JOIN sized z ON z.doc_id = q.doc_id AND z.c = q.c GROUP BY q.doc_id, q.c
        ),
        samples AS (
          SELECT doc_id, (u.j - 1)::INT AS c,
                 round_even((u.j - 1) * (len(cs) - 1) / greatest(least(len(cs), 12) - 1, 1), 0)::INT AS i
          FROM cut, unnest(range(1, least(len(cs), 12) + 1)) u(j)
          WHERE len(cs) < {min_sentences}
        ),
        blocks AS (
          SELECT doc_id, c, ids, ts, members FROM clustered
          UNION ALL
          SELECT s.doc_id, s.c, [s.i], [p.t], [s.i] FROM samples s JOIN pieces p ON p.doc_id = s.doc_id AND p.i = s.i
        ),
        summed AS (
          SELECT doc_id, string_agg(array_to_string(ts, ' '), ' / ' ORDER BY c) AS short,
                 string_agg(array_to_string(ts, ' '), chr(10) ORDER BY c) AS long, count(*) AS n
          FROM blocks GROUP BY doc_id
        ),
        result AS (
          SELECT c.doc_id, c.status, c.bytes, len(c.cs) AS n_chunks, coalesce(s.n, 0) AS n_blocks,
                 CASE WHEN c.status = 'OK' THEN coalesce(s.short, '') END AS short, s.long
          FROM cut c LEFT JOIN summed s USING (doc_id)
        )
        """)


def pairs_ranked() -> str:
    return (
        "pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d "
        "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM pairs)"
    )


def mst_weights(min_samples: int) -> str:
    """Prim's algorithm as a recursive query: the weights of a minimum spanning tree, ascending."""
    return f"""
        WITH RECURSIVE {pairs_ranked()},
        core AS (SELECT a, d AS core FROM ranked WHERE rank = {min_samples}),
        reach AS (
          SELECT p.a, p.b, greatest(x.core, y.core, p.d) AS w
          FROM pairs p JOIN core x ON x.a = p.a JOIN core y ON y.a = p.b
        ),
        grow AS (
          SELECT 0 AS step, vec_id AS id, CASE WHEN vec_id = f.first THEN 0.0::DOUBLE ELSE 'infinity'::DOUBLE END AS w,
                 false AS done
          FROM embeddings, (SELECT min(vec_id) AS first FROM embeddings) f
          UNION ALL (
            WITH pick AS (SELECT min({{'w': w, 'id': id}}) AS p FROM grow WHERE NOT done)
            SELECT g.step + 1, g.id,
                   CASE WHEN g.done OR g.id = pick.p.id THEN g.w ELSE least(g.w, r.w) END,
                   g.done OR g.id = pick.p.id
            FROM grow g, pick LEFT JOIN reach r ON r.a = pick.p.id AND r.b = g.id
            WHERE pick.p IS NOT NULL
          )
        ),
        ended AS (SELECT id, w FROM grow WHERE step = (SELECT max(step) FROM grow))
        SELECT row_number() OVER (ORDER BY w)::INT AS place, round(w, 6) AS weight
        FROM ended WHERE id <> (SELECT min(vec_id) FROM embeddings)"""


def density_labels(points: str, min_cluster_size: int, min_samples: int, digits: int) -> str:
    """CTEs up to ``labels(id, label)`` for the statement ``points``, which gives ``id`` and ``v``.

    Prim's algorithm visits the points in an order in which every component, at every weight, is an interval: a point and
    its neighbour in that order are apart by the weight at which the later one was reached. So components are the widest
    intervals without a longer weight inside, their clusters follow from sizes, and sums are taken in whole numbers.
    """
    return f"""
        RECURSIVE pts AS MATERIALIZED ({points}),
        pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM pts a JOIN pts b ON a.id <> b.id),
        ranked AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS rank, count(*) OVER (PARTITION BY a) AS n FROM pairs),
        core AS MATERIALIZED (SELECT a, d AS core FROM ranked WHERE rank = least({min_samples}, n)),
        reach AS MATERIALIZED (SELECT p.a, p.b, greatest(x.core, y.core, p.d) AS w FROM pairs p JOIN core x ON x.a = p.a JOIN core y ON y.a = p.b),
        grow AS (
          SELECT 0 AS step, id, CASE WHEN id = f.first THEN -1.0::DOUBLE ELSE 'infinity'::DOUBLE END AS w, NULL::INT AS place
          FROM pts, (SELECT min(id) AS first FROM pts) f
          UNION ALL (
            WITH pick AS (SELECT min({{'w': w, 'id': id}}) AS p FROM grow WHERE place IS NULL)
            SELECT g.step + 1, g.id,
                   CASE WHEN g.place IS NOT NULL OR g.id = pick.p.id THEN g.w ELSE least(g.w, r.w) END,
                   CASE WHEN g.id = pick.p.id THEN g.step ELSE g.place END
            FROM grow g, pick LEFT JOIN reach r ON r.a = pick.p.id AND r.b = g.id
            WHERE pick.p IS NOT NULL
          )
        ),
        raw AS (SELECT place, id, CASE WHEN place > 0 THEN round(w, {digits}) END AS w FROM grow WHERE step = (SELECT max(step) FROM grow)),
        far AS (SELECT CASE WHEN max(w) > 0 THEN max(w) ELSE 1.0 END AS far FROM raw),
        seq AS MATERIALIZED (SELECT place, id, w, round(far / greatest(w, far * 1e-12) / 1e-9)::HUGEINT AS d FROM raw, far),
        spans AS (
          SELECT DISTINCT coalesce((SELECT max(l.place) FROM seq l WHERE l.place < s.place AND l.w > s.w), 0) AS s,
                 coalesce((SELECT min(r.place) FROM seq r WHERE r.place > s.place AND r.w > s.w) - 1, (SELECT max(place) FROM seq)) AS e, d
          FROM seq s WHERE w IS NOT NULL
        ),
        big AS MATERIALIZED (SELECT s, e, d, e - s + 1 AS n FROM spans WHERE e - s + 1 >= {min_cluster_size}),
        up AS (
          SELECT c.s, c.e, min({{'n': p.n, 's': p.s}}) AS p FROM big c JOIN big p ON p.s <= c.s AND p.e >= c.e AND p.n > c.n GROUP BY c.s, c.e
        ),
        kids AS (SELECT p.s AS s, p.n AS n, count(*) AS kids FROM up GROUP BY ALL),
        born AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY b.n, b.s) AS no, b.s, b.e, b.n, b.d
          FROM big b LEFT JOIN kids k ON k.s = b.s AND k.n = b.n WHERE coalesce(k.kids, 0) <> 1
        ),
        owned AS (SELECT g.s, g.e, g.n, g.d, max({{'n': c.n, 'no': c.no}}).no AS no FROM big g JOIN born c ON c.s >= g.s AND c.e <= g.e GROUP BY ALL),
        gains AS (SELECT no, n, d, n - coalesce(lag(n) OVER (PARTITION BY no ORDER BY n), 0) AS more FROM owned),
        mass AS (SELECT no, sum(more::HUGEINT * d)::HUGEINT AS mass, max(n) AS own FROM gains GROUP BY no),
        above AS (SELECT c.no, min({{'n': p.n, 'no': p.no}}).no AS parent FROM born c JOIN born p ON p.s <= c.s AND p.e >= c.e AND p.n > c.n GROUP BY c.no),
        ended AS MATERIALIZED (
          SELECT a.no, a.parent, m.mass - m.own::HUGEINT * p.d AS worth FROM above a JOIN mass m USING (no) JOIN born p ON p.no = a.parent
        ),
        below AS MATERIALIZED (
          SELECT list_reduce(
            [(SELECT list_transform(range(1, 1 + count(*)), lambda i: 0::HUGEINT) FROM born)]
              || coalesce((SELECT list([no::HUGEINT, parent::HUGEINT, worth] ORDER BY no) FROM ended), []::HUGEINT[][]),
            lambda known, c: list_transform(known, lambda x, i: x + CASE WHEN i = c[2] THEN greatest(c[3], known[c[1]::INT]) ELSE 0 END)
          ) AS known
        ),
        chosen AS (SELECT c.no, b.s, b.e, b.n FROM ended c JOIN born b USING (no), below WHERE c.worth >= known[c.no]),
        inner_most AS (SELECT q.id, min({{'n': g.n, 'no': g.no}}).no AS no FROM seq q JOIN owned g ON q.place BETWEEN g.s AND g.e GROUP BY q.id),
        tops AS (
          SELECT i.id, max({{'n': c.n, 'no': c.no}}).no AS top FROM inner_most i JOIN born b USING (no) JOIN chosen c ON c.s <= b.s AND c.e >= b.e GROUP BY i.id
        ),
        numbers AS (SELECT top, row_number() OVER (ORDER BY min(id)) - 1 AS label FROM tops GROUP BY top),
        labels AS (SELECT q.id, coalesce(n.label, -1)::INT AS label FROM pts q LEFT JOIN tops USING (id) LEFT JOIN numbers n USING (top))"""
