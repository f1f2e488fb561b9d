"""DuckDB text of the slate rules, for oracles: each takes a table (session_id, rank, item_id, score, queue) and adds CTEs
that end in one of that shape. Facts of items come from a table `attr` (item_id, fam, mod, var, src, ok, tk, ret, url)."""

from __future__ import annotations

_ROW = "struct_pack(item_id := s.item_id, score := s.score, queue := s.queue, fam := a.fam, mod := a.mod, var := a.var, src := a.src, ok := a.ok, tk := a.tk, ret := a.ret, url := a.url)"


def r4(c: str) -> str:
    return f"floor(({c}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0.0::DOUBLE END"


def closest(tk: str, rows: str, places: str) -> str:
    """Least distance of a row's tokens to those of some rows."""
    return (f"CASE WHEN len({tk}) >= 2 THEN {r4(f'list_min(list_transform(list_filter({places}, lambda k: len({rows}[k].tk) >= 2), lambda k: 1.0::DOUBLE - {jaccard(tk, f'{rows}[k].tk')}))')} END")


def packed(name: str, src: str) -> str:
    return f"{name}_x AS MATERIALIZED (SELECT session_id, list({_ROW} ORDER BY s.rank) AS rows, count(*)::INT AS n FROM {src} s JOIN attr a USING (item_id) GROUP BY 1)"


def near(name: str, src: str, o) -> str:
    same = "(coalesce(rows[k].fam = r.fam, false) OR coalesce(rows[k].mod = r.mod, false))"
    twins = f"list_filter(placed, lambda k: {same})"
    return f"""{packed(name, src)},
  {name}_f AS (SELECT session_id, 0 AS i, []::INT[] AS placed, []::INT[] AS late, 0 AS reps FROM {name}_x
    UNION ALL SELECT session_id, i + 1, CASE WHEN v > 0 THEN list_append(placed, i + 1) ELSE placed END, CASE WHEN v = 0 THEN list_append(late, i + 1) ELSE late END, reps + CASE WHEN v = 2 THEN 1 ELSE 0 END
    FROM (SELECT *, CASE WHEN place > greatest({o.soft_window}, least(n, {max(0, o.limit) + o.soft_repeats})) THEN 1
        WHEN gap IS NULL THEN CASE WHEN place <= {o.hard_window} AND coalesce(list_contains(list_transform(placed[1:{o.hard_window}], lambda k: rows[k].var), r.var), false) THEN 0 ELSE 1 END
        WHEN place <= {o.hard_window} THEN 0 WHEN reps < {o.soft_repeats} AND coalesce(r.ok, false) AND gap >= {o.min_gap} AND coalesce(dist >= {o.min_distance}, true) THEN 2 ELSE 0 END AS v
      FROM (SELECT *, list_min(list_transform(list_filter(range(1, place), lambda j: list_contains(twins, placed[j])), lambda j: place - j)) AS gap, {closest('r.tk', 'rows', 'twins')} AS dist
        FROM (SELECT *, {twins} AS twins FROM (SELECT f.*, x.rows, x.n, x.rows[f.i + 1] AS r, len(f.placed) + 1 AS place FROM {name}_f f JOIN {name}_x x USING (session_id) WHERE f.i < x.n))))),
  {name}_d AS MATERIALIZED (SELECT f.session_id, f.placed, f.late, x.rows FROM {name}_f f JOIN {name}_x x USING (session_id) WHERE f.i = x.n),
  {name}_l AS (SELECT session_id, len(placed) AS base, k, rows[late[k]] AS r FROM {name}_d, LATERAL (SELECT unnest(range(1, len(late) + 1)) AS k)),
  {name}_b AS (SELECT *, coalesce(r.mod, r.fam, 'row ' || k) AS key FROM {name}_l),
  {name}_s AS (SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY k) AS turn, count(*) OVER (PARTITION BY session_id, key) AS cnt, min(k) OVER (PARTITION BY session_id, key) AS fst FROM {name}_b),
  {name} AS MATERIALIZED (SELECT session_id, k AS rank, r.item_id, r.score, r.queue FROM (SELECT session_id, k, rows[placed[k]] AS r FROM {name}_d, LATERAL (SELECT unnest(range(1, len(placed) + 1)) AS k))
    UNION ALL SELECT session_id, base + row_number() OVER (PARTITION BY session_id ORDER BY turn, cnt DESC, fst), r.item_id, r.score, r.queue FROM {name}_s)"""


def cap(name: str, src: str, key: str, most: int, window: int, limit: int) -> str:
    return f"""{name}_x AS MATERIALIZED (SELECT s.*, CAST(a.{key} AS VARCHAR) AS k, greatest({window}, least(count(*) OVER (PARTITION BY session_id), {limit})) AS reach FROM {src} s JOIN attr a USING (item_id)),
  {name}_a AS (SELECT *, k IS NULL OR row_number() OVER (PARTITION BY session_id, k ORDER BY rank) <= {most} AS fits FROM {name}_x),
  {name}_b AS (SELECT *, coalesce(sum(fits::INT) OVER (PARTITION BY session_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}_a),
  {name}_c AS (SELECT *, NOT fits AND before < reach AS late FROM {name}_b),
  {name}_n AS (SELECT *, row_number() OVER (PARTITION BY session_id, late, k ORDER BY rank) AS turn, count(*) OVER (PARTITION BY session_id, late, k) AS cnt, min(rank) OVER (PARTITION BY session_id, late, k) AS fst FROM {name}_c),
  {name} AS MATERIALIZED (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY late, CASE WHEN late THEN turn ELSE rank END, CASE WHEN late THEN -cnt END, CASE WHEN late THEN fst END) AS rank, item_id, score, queue FROM {name}_n)"""


def featured(name: str, src: str, flag: str, limit: int, every: str, cooldown: int) -> str:
    """`flag`: condition on a row r that makes it featured."""
    return f"""{packed(name, src)},
  {name}_q AS MATERIALIZED (SELECT session_id, n, list_filter(rows, lambda r: NOT ({flag})) AS org, list_filter(rows, lambda r: {flag}) AS pro, greatest(2, {every}) AS gap, least({limit}, n) AS size FROM {name}_x),
  {name}_f AS (SELECT session_id, 0 AS i, 0 AS used, 0 AS taken, pro, []::VARCHAR[] AS recent, true AS going, NULL::BIGINT AS won, false AS slot, CAST(NULL AS STRUCT(item_id BIGINT, score DOUBLE, queue INT)) AS own FROM {name}_q
    UNION ALL SELECT session_id, i + 1, used + CASE WHEN pick IS NULL AND used < len(org) THEN 1 ELSE 0 END, taken + CASE WHEN pick IS NULL THEN 0 ELSE 1 END,
      CASE WHEN pick IS NULL THEN pro ELSE list_filter(pro, lambda r: r.item_id <> pick.item_id) END,
      CASE WHEN pick IS NULL OR pick.ret IS NULL THEN recent ELSE list_concat([pick.ret], recent)[1:{cooldown}] END, pick IS NOT NULL OR used < len(org), pick.item_id, pick IS NOT NULL,
      CASE WHEN pick IS NOT NULL THEN struct_pack(item_id := pick.item_id, score := pick.score, queue := pick.queue) WHEN used < len(org) THEN struct_pack(item_id := org[used + 1].item_id, score := org[used + 1].score, queue := org[used + 1].queue) END
    FROM (SELECT f.session_id, f.i, f.used, f.taken, f.pro, f.recent, q.org,
        CASE WHEN (f.i + 1) % q.gap = 0 AND f.taken < q.size // q.gap THEN list_filter(f.pro, lambda r: r.ret IS NULL OR NOT list_contains(f.recent, r.ret))[1] END AS pick
      FROM {name}_f f JOIN {name}_q q USING (session_id) WHERE f.i < q.size AND f.going)),
  {name} AS MATERIALIZED (SELECT session_id, i::BIGINT AS rank, own.item_id AS item_id, own.score AS score, own.queue AS queue FROM {name}_f WHERE i > 0 AND own IS NOT NULL)"""


def accept(name: str, src: str, most: int, head: int, first: int, distance: float | None) -> str:
    known = lambda c: f"coalesce(list_contains(list_transform(placed, lambda k: rows[k].{c}), r.{c}), false)"
    far = f" OR (len(placed) < {first} AND coalesce({closest('r.tk', 'rows', 'placed')} < {distance}, false))" if distance is not None else ""
    return f"""{packed(name, src)},
  {name}_f AS (SELECT session_id, 0 AS i, []::INT[] AS placed FROM {name}_x
    UNION ALL SELECT session_id, i + 1, CASE WHEN len(placed) >= {most} OR {known('url')} OR (len(placed) < {head} AND ({known('fam')} OR {known('mod')})){far} THEN placed ELSE list_append(placed, i + 1) END
    FROM (SELECT f.*, x.rows, x.rows[f.i + 1] AS r FROM {name}_f f JOIN {name}_x x USING (session_id) WHERE f.i < x.n)),
  {name} AS MATERIALIZED (SELECT session_id, k AS rank, rows[placed[k]].item_id AS item_id, rows[placed[k]].score AS score, rows[placed[k]].queue AS queue
    FROM (SELECT f.session_id, f.placed, x.rows FROM {name}_f f JOIN {name}_x x USING (session_id) WHERE f.i = x.n), LATERAL (SELECT unnest(range(1, len(placed) + 1)) AS k))"""


def mmr(name: str, src: str, lam: float, top: int) -> str:
    worth = f"{lam}::DOUBLE * rel[i] - (1.0::DOUBLE - {lam}::DOUBLE) * sim[i]"
    return f"""{packed(name, src)},
  {name}_h AS MATERIALIZED (SELECT session_id, rows, n, m, list_transform(range(1, m + 1), lambda i: CASE WHEN hi > lo THEN (rows[i].score - lo) / (hi - lo) ELSE 0.0::DOUBLE END) AS rel
    FROM (SELECT *, least(n, {top})::INT AS m, list_max(list_transform(rows[1:{top}], lambda r: r.score)) AS hi, list_min(list_transform(rows[1:{top}], lambda r: r.score)) AS lo FROM {name}_x)),
  {name}_f AS (SELECT session_id, 0 AS j, []::BIGINT[] AS done, list_transform(range(1, m + 1), lambda i: 0.0::DOUBLE) AS sim FROM {name}_h
    UNION ALL SELECT session_id, j + 1, list_append(done, pick), list_transform(range(1, m + 1), lambda i: greatest(sim[i], {jaccard('rows[i].tk', 'rows[pick].tk')}))
    FROM (SELECT *, -list_sort(list_transform(list_filter(range(1, m + 1), lambda i: NOT list_contains(done, i)), lambda i: struct_pack(w := {worth}, r := rel[i], t := -i)), 'DESC')[1].t AS pick
      FROM (SELECT f.*, h.rows, h.m, h.rel FROM {name}_f f JOIN {name}_h h USING (session_id) WHERE f.j < h.m))),
  {name} AS MATERIALIZED (SELECT session_id, k AS rank, rows[p].item_id AS item_id, rows[p].score AS score, rows[p].queue AS queue
    FROM (SELECT session_id, rows, k, CASE WHEN k <= m THEN done[k] ELSE k END AS p FROM (SELECT f.session_id, f.done, h.rows, h.n, h.m FROM {name}_f f JOIN {name}_h h USING (session_id) WHERE f.j = h.m), LATERAL (SELECT unnest(range(1, n + 1)) AS k)))"""


def explore(name: str, src: str, rates: str, limit: int, seed: int) -> str:
    """`rates`: table (session_id, rate)."""
    want = "floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, rate)) * nb * 1e9 + 0.5) / 1e9"
    return f"""{name}_p AS (SELECT s.*, z.rate, rank <= {limit} AS base FROM {src} s JOIN {rates} z USING (session_id) WHERE rank <= {2 * limit}),
  {name}_n AS (SELECT *, row_number() OVER (PARTITION BY session_id, base ORDER BY sha256('{seed}:' || session_id || ':' || item_id)) AS pick, count(*) FILTER (WHERE base) OVER (PARTITION BY session_id) AS nb FROM {name}_p),
  {name}_c AS (SELECT *, floor({want}) + CASE WHEN CAST('0x' || substr(sha256('{seed}:' || session_id || ':draw'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < {want} - floor({want}) THEN 1 ELSE 0 END AS cnt FROM {name}_n),
  {name}_s AS (SELECT *, max(CASE WHEN base THEN rank END) OVER (PARTITION BY session_id, pick) AS slot, max(CASE WHEN NOT base THEN 1 END) OVER (PARTITION BY session_id, pick) AS has_new FROM {name}_c),
  {name}_z AS (SELECT *, pick <= cnt AND slot IS NOT NULL AND has_new IS NOT NULL AS sw FROM {name}_s),
  {name} AS MATERIALIZED (SELECT session_id, CASE WHEN base THEN rank ELSE slot END AS rank, item_id, score, queue FROM {name}_z WHERE CASE WHEN base THEN NOT sw ELSE sw END)"""


def shape(name: str, src: str, flag: str, every: str, o) -> str:
    """All shaping rules in their order."""
    steps = [near(f"{name}1", src, o), cap(f"{name}2", f"{name}1", "src", o.source_cap, o.source_window, o.limit), near(f"{name}3", f"{name}2", o),
             featured(f"{name}4", f"{name}3", flag, o.limit, every, o.retailer_cooldown), cap(f"{name}5", f"{name}4", "src", o.source_cap, o.source_window, o.limit),
             near(f"{name}6", f"{name}5", o), cap(name, f"{name}6", "mod", o.model_cap, o.model_window, o.limit)]
    return ",\n  ".join(steps)
