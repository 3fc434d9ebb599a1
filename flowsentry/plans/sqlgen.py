"""SQL (DuckDB dialect) twins of the sampling rules, for oracle queries.

They spell out in plain SQL what ``operators.sampling`` computes with
bucketed ranks: class counts -> largest-remainder quotas -> plain
``row_number`` over the hash order.
"""

from __future__ import annotations


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def split_quota_ctes(counts: str, cls: str, frac: float, out: str) -> str:
    """CTEs ending in ``out(cls, q)``: per-class size of the test side.

    ``counts`` is a CTE with columns (cls, n).
    """
    return f"""{out}_t AS (SELECT sum(n) AS total,
        CAST(ceil({dbl(frac)} * sum(n)) AS BIGINT) AS n_test FROM {counts}),
{out}_a AS (SELECT c.{cls} AS cls, c.n, CAST(c.n AS DOUBLE) / t.total * (t.total - t.n_test) AS cont,
        t.total - t.n_test AS draws FROM {counts} c, {out}_t t),
{out}_b AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM {out}_a),
{out}_c AS (SELECT *, draws - sum(fl) OVER () AS need,
        row_number() OVER (ORDER BY rem DESC, cls) AS rr FROM {out}_b),
{out} AS (SELECT cls AS {cls}, CAST(n - (CAST(fl AS BIGINT)
        + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS BIGINT) AS q FROM {out}_c)"""


def split_ctes(src: str, y: str = "y", seed: int = 42, test: float = 0.15,
               val: float = 0.15, out: str = "splitted") -> str:
    """CTEs ending in ``out`` = src + split ('train'/'val'/'test')."""
    rel = val / round(1.0 - test, 12)
    return f"""{out}_h AS (SELECT *, md5(concat('{seed}:', row_id)) AS h FROM {src}),
{out}_n AS (SELECT {y}, count(*) AS n FROM {src} GROUP BY {y}),
{split_quota_ctes(out + '_n', y, test, out + '_tq')},
{out}_rest AS (SELECT n.{y}, n.n - q.q AS n FROM {out}_n n JOIN {out}_tq q USING ({y})),
{split_quota_ctes(out + '_rest', y, rel, out + '_vq')},
{out}_r AS (SELECT x.*, row_number() OVER (PARTITION BY x.{y} ORDER BY x.h, x.row_id) AS rn
        FROM {out}_h x),
{out} AS (SELECT r.* EXCLUDE (h, rn), CASE WHEN r.rn <= t.q THEN 'test'
        WHEN r.rn <= t.q + v.q THEN 'val' ELSE 'train' END AS split
        FROM {out}_r r JOIN {out}_tq t USING ({y}) JOIN {out}_vq v USING ({y}))"""


def kfold_ctes(src: str, k: int = 3, y: str = "y", seed: int = 42, out: str = "folded") -> str:
    """CTEs ending in ``out`` = src + fold (0..k-1)."""
    return f"""{out}_n AS (SELECT {y}, count(*) AS n FROM {src} GROUP BY {y}),
{out}_o AS (SELECT {y}, coalesce(sum(n) OVER (ORDER BY {y} ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS off FROM {out}_n),
{out}_r AS (SELECT x.*, row_number() OVER (PARTITION BY x.{y}
        ORDER BY md5(concat('{seed}:', x.row_id)), x.row_id) AS rn FROM {src} x),
{out} AS (SELECT r.* EXCLUDE (rn), CAST((o.off + r.rn - 1) % {k} AS INTEGER) AS fold
        FROM {out}_r r JOIN {out}_o o USING ({y}))"""


def balanced_ctes(src: str, y: str = "y", seed: int = 42, out: str = "bal") -> str:
    """CTEs ending in ``out`` = src + in_balanced (all anomalies + as many normals)."""
    return f"""{out}_a AS (SELECT count(*) AS a FROM {src} WHERE {y} = 1),
{out}_r AS (SELECT x.*, row_number() OVER (PARTITION BY x.{y}
        ORDER BY md5(concat('{seed}:', x.row_id)), x.row_id) AS rn FROM {src} x),
{out} AS (SELECT r.* EXCLUDE (rn), CAST(CASE WHEN r.rn <= a.a THEN 1 ELSE 0 END AS INTEGER)
        AS in_balanced FROM {out}_r r, {out}_a a)"""


# ------------------------------------------------------- isolation forest

def iforest_nodes_ctes(src: str, features: list[str], n_trees: int, psi: int = 256, seed: int = 42,
                       key: str = "row_id", out: str = "nodes", by: str | None = None,
                       n_feat: int | None = None) -> str:
    """CTEs ending in ``out`` ([by,] tree, node, f (0-based, -1: leaf), thr, n, depth): the
    forest that ``iforest.fit_iforest`` grows on ``src`` (with ``n_feat`` features a tree), one for each
    value of ``by``. For tables of at least ``psi`` rows."""
    b, g = (f"{by}, ", f"{by}, tree, node") if by else ("", "tree, node")
    depth = max(1, (psi - 1).bit_length())
    names = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    values = "[" + ", ".join(f"CAST({f} AS DOUBLE)" for f in features) + "]"
    same = f"s.{by} = n.{by} AND " if by else ""
    join = f"JOIN {out}_c c ON x.{by} = c.{by}" if by else f"CROSS JOIN {out}_c c"
    ctes = [f"""{out}_c AS (SELECT {b}count(*) // {psi} AS pr FROM {src} {f'GROUP BY {by}' if by else ''}),
{out}_d AS (SELECT x.*, c.pr, unnest(range(CAST(({n_trees} + c.pr - 1) // c.pr AS BIGINT))) AS rd FROM {src} x {join}),
{out}_r AS (SELECT {b}{values} AS v, pr, rd, row_number() OVER (PARTITION BY {b}rd ORDER BY
  md5(concat('{seed}:', rd, ':', {key})), {key}) - 1 AS rn FROM {out}_d),
{out}_s0 AS (SELECT {b}CAST(rd * pr + rn // {psi} AS INTEGER) AS tree, 0 AS node, v FROM {out}_r
  WHERE rn < pr * {psi} AND rd * pr + rn // {psi} < {n_trees})"""]
    subset = ""
    if n_feat is not None and n_feat < len(features):
        ctes.append(f"""{out}_a AS (SELECT t.range AS tree, f.i AS f FROM range({n_trees}) t,
  (SELECT unnest(range(1, {len(features) + 1})) AS i) f QUALIFY row_number() OVER (PARTITION BY t.range
  ORDER BY md5(concat('{seed}:', t.range, ':f:', {names}[f.i]))) <= {n_feat})""")
        subset = f" SEMI JOIN {out}_a USING (tree, f)"
    levels = []
    for d in range(depth + 1):
        split = "hi > lo" if d < depth else "false"
        ctes.append(f"""{out}_x{d} AS (SELECT {b}tree, node, unnest(v) AS x, generate_subscripts(v, 1) AS f FROM {out}_s{d}),
{out}_m{d} AS (SELECT {g}, f, min(x) AS lo, max(x) AS hi, count(*) AS n FROM {out}_x{d}{subset} GROUP BY {g}, f),
{out}_p{d} AS (SELECT {g}, any_value(n) AS n, arg_min(struct_pack(f := f, lo := lo, hi := hi),
  md5(concat('{seed}:', tree, ':', node, ':', {names}[f]))) FILTER ({split}) AS p FROM {out}_m{d} GROUP BY {g}),
{out}_u{d} AS (SELECT *, p.lo + CAST(concat('0x', substr(md5(concat('{seed}:', tree, ':', node, ':t')), 1, 13)) AS BIGINT)
  / 4503599627370496.0::DOUBLE * (p.hi - p.lo) AS t FROM {out}_p{d}),
{out}_n{d} AS (SELECT {g}, n, coalesce(p.f, 0) - 1 AS f, coalesce(CASE WHEN t >= p.hi THEN p.lo ELSE t END, 0.0) AS thr,
  {d} AS depth FROM {out}_u{d})""")
        levels.append(f"SELECT * FROM {out}_n{d}")
        if d < depth:
            ctes.append(f"""{out}_s{d + 1} AS (SELECT {'s.' + by + ', ' if by else ''}s.tree,
  CASE WHEN s.v[n.f + 1] <= n.thr THEN 2 * s.node + 1 ELSE 2 * s.node + 2 END AS node, s.v
  FROM {out}_s{d} s JOIN {out}_n{d} n ON {same}s.tree = n.tree AND s.node = n.node WHERE n.f >= 0)""")
    return ",\n".join(ctes) + f",\n{out} AS (" + " UNION ALL ".join(levels) + ")"


def iforest_score_ctes(src: str, features: list[str], keep: str, n_trees: int, nodes: str = "nodes",
                       psi: int = 256, out: str = "ifs", by: str | None = None) -> str:
    """CTEs ending in ``out`` (keep, ss): score_samples of the rows of ``src`` (keyed by row_id);
    ``out``_h has the path length of each row in each tree."""
    values = "[" + ", ".join(f"CAST({f} AS DOUBLE)" for f in features) + "]"
    depth = max(1, (psi - 1).bit_length())
    same = f"w.{by} = n.{by} AND " if by else ""
    c = lambda n: f"(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} END)"
    ctes = [f"""{out}_w0 AS (SELECT {keep}, {values} AS v, CAST(t.range AS INTEGER) AS tree, 0 AS node
  FROM {src}, range({n_trees}) t)"""]
    leaves = []
    for d in range(depth + 1):
        join = f"{out}_w{d} w JOIN {nodes} n ON {same}w.tree = n.tree AND w.node = n.node"
        cols = ", ".join("w." + k.strip() for k in keep.split(","))
        leaves.append(f"SELECT {cols}, w.tree, n.depth + {c('CAST(n.n AS DOUBLE)')} AS h FROM {join} WHERE n.f < 0")
        if d < depth:
            ctes.append(f"""{out}_w{d + 1} AS (SELECT {cols}, w.v, w.tree,
  CASE WHEN w.v[n.f + 1] <= n.thr THEN 2 * w.node + 1 ELSE 2 * w.node + 2 END AS node FROM {join} WHERE n.f >= 0)""")
    return ",\n".join(ctes) + f""",
{out}_h AS ({' UNION ALL '.join(leaves)}),
{out} AS (SELECT {keep}, {iforest_ss(psi)} AS ss FROM {out}_h GROUP BY {keep})"""


def iforest_ss(psi: int = 256, where: str = "") -> str:
    """score_samples as an aggregate of the path lengths ``h``."""
    c = f"(2.0 * (ln({float(psi)} - 1.0) + 0.5772156649015329) - 2.0 * ({float(psi)} - 1.0) / {float(psi)})"
    return f"-round(power(2.0, -(avg(h){where}) / {c}), 12)"
