"""SQL for the transforms of signals: warping, window annealing, wavelets and scalograms, written from their definitions."""

from __future__ import annotations

from math import pi

# Low-pass analysis taps of two orthogonal wavelets.
TAPS = {
    "db4": (-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523),
    "db6": (-0.00107730108499558, 0.004777257511010651, 0.0005538422009938016, -0.031582039318031156, 0.02752286553001629, 0.09750160558707936, -0.12976686756709563, -0.22626469396516913, 0.3152503517092432, 0.7511339080215775, 0.4946238903983854, 0.11154074335008017),
}


def warping(size: int, band: int) -> str:
    """Windows of ``size`` values of a user against the next: costs by anti-diagonals, then the path back from the end.

    A row of ``c`` is a cell (i, d - i); ``cost`` is its own and ``prev`` that of the same i one diagonal before.
    """
    return f"""
WITH RECURSIVE s AS (SELECT user_id, value AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events),
w AS (SELECT user_id, p // {size} AS win, list(z ORDER BY p) AS a FROM s GROUP BY ALL),
q AS (SELECT x.user_id, x.win, x.a, y.a AS b, len(x.a) AS na, len(y.a) AS nb, greatest({band}, abs(len(x.a) - len(y.a))) AS band FROM w x JOIN w y ON y.user_id = x.user_id AND y.win = x.win + 1),
c AS (
  SELECT user_id, win, 0::BIGINT AS d, i, CASE WHEN i = 0 THEN 0::DOUBLE ELSE 'inf'::DOUBLE END AS cost, 'inf'::DOUBLE AS prev, 0 AS move FROM q, LATERAL (SELECT unnest(range(0, na + 1)) AS i)
  UNION ALL
  SELECT user_id, win, d, i, CASE WHEN inside THEN gap * gap + least(diag, up, side) ELSE 'inf'::DOUBLE END, side, CASE WHEN diag <= up AND diag <= side THEN 0 WHEN up <= side THEN 1 ELSE 2 END
  FROM (SELECT c.user_id, c.win, c.d + 1 AS d, c.i, c.i >= 1 AND c.d + 1 - c.i BETWEEN 1 AND q.nb AND abs(2 * c.i - c.d - 1) <= q.band AS inside, q.a[c.i] - q.b[c.d + 1 - c.i] AS gap,
      coalesce(lag(c.prev) OVER (PARTITION BY c.user_id, c.win ORDER BY c.i), 'inf'::DOUBLE) AS diag, coalesce(lag(c.cost) OVER (PARTITION BY c.user_id, c.win ORDER BY c.i), 'inf'::DOUBLE) AS up, c.cost AS side
    FROM c JOIN q ON q.user_id = c.user_id AND q.win = c.win WHERE c.d < q.na + q.nb)),
path AS (
  SELECT q.user_id, q.win, q.na AS i, q.nb AS j, c.move, c.cost FROM q JOIN c ON c.user_id = q.user_id AND c.win = q.win AND c.i = q.na AND c.d = q.na + q.nb
  UNION ALL
  SELECT c.user_id, c.win, c.i, c.d - c.i, c.move, path.cost FROM path JOIN c ON c.user_id = path.user_id AND c.win = path.win
    AND c.i = path.i - CASE WHEN path.move <> 2 THEN 1 ELSE 0 END AND c.d - c.i = path.j - CASE WHEN path.move <> 1 THEN 1 ELSE 0 END WHERE c.i >= 1 AND c.d - c.i >= 1),
r AS (SELECT user_id, win, round(any_value(cost), 4) AS distance, round(avg(abs(i - j)), 6) AS lag_mean, round(stddev_pop(i - j), 6) AS lag_std, count(*)::BIGINT AS steps FROM path GROUP BY ALL)
SELECT w.user_id, w.win::BIGINT AS "window", distance, lag_mean, lag_std, steps FROM w LEFT JOIN r ON r.user_id = w.user_id AND r.win = w.win WHERE r.win IS NOT NULL OR w.win = 0
"""


def window_annealing(size: int, step: int, q: float, r: float, p0: float, betas: list[float], shared: bool, prob_cut: float = 1e-3, settled: float = 1e-3) -> str:
    """Joint annealing of count windows: for each temperature a pass over the window by its last weights, then new weights.

    New weights are compared with those of the pass before the last, and the first that hardly differ stand.
    """
    num = lambda x: f"{x!r}::DOUBLE"
    parts = [
        f"s AS (SELECT user_id, value::DOUBLE AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events)",
        f"e AS (SELECT user_id, unnest(range(0, p // {step} + 1)) AS window_id, p, z FROM s)",
        f"g AS (SELECT user_id, window_id, p - window_id * {step} AS i, z FROM e WHERE p < window_id * {step} + {size})",
        f"n AS (SELECT user_id, window_id, count(*) AS n, arg_min(z, i) AS x0 FROM g GROUP BY ALL HAVING count(*) = {size} OR window_id = 0 OR count(*) > {size - step})",
        "w0 AS (SELECT g.user_id, g.window_id, g.i, g.z, n.x0, 1::DOUBLE AS w, 1::DOUBLE AS before FROM g JOIN n ON n.user_id = g.user_id AND n.window_id = g.window_id)",
    ]
    def gained(ahead: str, w: str) -> str:
        return f"CASE WHEN {w} > 0 THEN {ahead} * {w} / ({ahead} * {w} + {num(r)}) ELSE 0 END"
    for k, beta in enumerate(betas):
        walk = f"SELECT user_id, window_id, i, w, before, (z - x) * (z - x) / (ahead + {num(r)}) AS chi2, ahead + {num(r)} AS total, x + gain * (z - x) AS x, (1 - gain) * ahead AS spread FROM (SELECT *, {gained('ahead', 'w')} AS gain FROM ({{rows}}))"
        first = f"SELECT user_id, window_id, i, z, w, before, x0 AS x, {num(p0)} + {num(q)} AS ahead FROM w{k} WHERE i = 0"
        later = f"SELECT t.user_id, t.window_id, t.i, t.z, t.w, t.before, c.x, c.spread + {num(q)} AS ahead FROM k{k} c JOIN w{k} t ON t.user_id = c.user_id AND t.window_id = c.window_id AND t.i = c.i + 1"
        parts.append(f"k{k} AS ({walk.format(rows=first)} UNION ALL {walk.format(rows=later)})")
        inside, outside = f"total ** -0.5 * exp(-least(chi2 / (2 * {num(beta)}), 50))", f"total ** -0.5 * exp(-least(-2 * ln({num(prob_cut)}) / (2 * {num(beta)}), 50))"
        norm = num((2 * pi) ** -0.5)
        scores = f"SELECT *, {norm} * {inside} AS a, {norm} * {outside} AS b FROM k{k}"
        if shared:
            fresh = "CASE WHEN sum(a + b) OVER o >= 1e-12 THEN a / sum(a + b) OVER o ELSE 0 END"
        else:
            fresh = "CASE WHEN a + b >= 1e-12 THEN a / (a + b) ELSE 1 END"
        parts.append(f"f{k} AS (SELECT *, max(abs(fresh - before)) OVER (PARTITION BY user_id, window_id) < {num(settled)} AS ok FROM (SELECT user_id, window_id, i, w, before, {fresh} AS fresh FROM ({scores}) WINDOW o AS (PARTITION BY user_id, window_id)))")
        if k + 1 < len(betas):
            parts.append(f"w{k + 1} AS (SELECT f.user_id, f.window_id, f.i, v.z, v.x0, f.fresh AS w, f.w AS before FROM f{k} f JOIN w{k} v ON v.user_id = f.user_id AND v.window_id = f.window_id AND v.i = f.i WHERE NOT ok)")
    last = len(betas) - 1
    ends = " UNION ALL ".join(f"SELECT user_id, window_id, fresh, ok, {k + 1} AS iterations FROM f{k} WHERE ok{f' OR {k} = {last}' if k == last else ''}" for k in range(len(betas)))
    return f"WITH RECURSIVE {', '.join(parts)}, z AS ({ends}) SELECT user_id, window_id::BIGINT AS window_id, count(*) AS n, count(*) FILTER (fresh < 0.1) AS n_outliers, any_value(ok) AS converged, any_value(iterations)::BIGINT AS iterations, round(sum(fresh), 6) AS weight FROM z GROUP BY user_id, window_id"


def _blocks(n: int, mapped: str = "event_type") -> str:
    return f"""s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS p, greatest(count(*) OVER (PARTITION BY event_type) // {n} - 1, 0) AS last FROM events),
g AS (SELECT event_type, least(p // {n}, last) AS block, list(value::DOUBLE ORDER BY p) AS x FROM s GROUP BY ALL)"""


def _denoised(name: str, rows: str, wavelet: str, level: int, method: str) -> tuple[list[str], str]:
    """CTEs that denoise ``rows(event_type, block, x)`` by ``level`` periodised steps, and the last one's name."""
    low = TAPS[wavelet]
    high = [(-1) ** (k + 1) * t for k, t in enumerate(reversed(low))]
    size, half = len(low), len(low) // 2
    lists = {"lo": str([*low]), "hi": str(high)}
    at = lambda xs, n: f"{xs}[((({half} + 2 * k - t) % {n} + {n}) % {n}) + 1]"
    out = [f"{name}0 AS (SELECT event_type, block, len(x) AS n, x AS a FROM ({rows}))"]
    for j in range(1, level + 1):
        even = "CASE WHEN len(a) % 2 = 1 THEN list_append(a, a[len(a)]) ELSE a END"
        band = lambda taps: f"list_transform(range(0, len(e) // 2), lambda k: list_sum(list_transform(range(0, {size}), lambda t: {at('e', 'len(e)')} * {lists[taps]}[t + 1])))"  # noqa: B023, E731
        kept = "".join(f", d{i}" for i in range(1, j))
        out.append(f"{name}{j} AS (SELECT event_type, block, n{kept}, {band('hi')} AS d{j}, {band('lo')} AS a FROM (SELECT *, {even} AS e FROM {name}{j - 1}))")
    sigma = "list_median(list_transform(d1, lambda v: abs(v - m))) / 0.6745::DOUBLE"
    cut = "sqrt(2 * ln(n))" if method == "universal" else "sqrt(ln(n))"
    shrunk = ", ".join(f"list_transform(d{i}, lambda v: sign(v) * greatest(abs(v) - t0, 0)) AS d{i}" for i in range(1, level + 1))
    details = "".join(f", d{i}" for i in range(1, level + 1))
    out.append(f"{name}r{level} AS (SELECT event_type, block, n, a, {shrunk} FROM (SELECT *, {sigma} * {cut} AS t0 FROM (SELECT event_type, block, n, a{details}, list_median(d1) AS m FROM {name}{level})))")
    for j in range(level, 0, -1):
        spot = f"(((i + t - {half}) % (2 * len(d{j})) + 2 * len(d{j})) % (2 * len(d{j}))) // 2 + 1"
        term = f"CASE WHEN (i + t - {half}) % 2 = 0 THEN a[{spot}] * {lists['lo']}[t + 1] + d{j}[{spot}] * {lists['hi']}[t + 1] ELSE 0 END"
        rest = "".join(f", d{i}" for i in range(1, j))
        out.append(f"{name}r{j - 1} AS (SELECT event_type, block, n{rest}, list_transform(range(0, 2 * len(d{j})), lambda i: list_sum(list_transform(range(0, {size}), lambda t: {term}))) AS a FROM {name}r{j})")
    return out, f"SELECT event_type, block, a[1:n] AS x FROM {name}r0"


def denoising(settings: dict[str | None, tuple[str, int, str]], n: int = 256) -> str:
    """Denoised blocks as rows; ``settings`` by event type, None for all others; levels are cut to what a block's length allows."""
    named = ", ".join(f"'{k}'" for k in settings if k)
    ctes, ends = [_blocks(n)], []
    for c, (kind, (wavelet, level, method)) in enumerate(settings.items()):
        chosen = f"event_type = '{kind}'" if kind else f"event_type NOT IN ({named})" if named else "true"
        taps = len(TAPS[wavelet])
        deepest = f"CASE WHEN len(x) >= {taps - 1} THEN least({level}, floor(log2(len(x) / {taps - 1}::DOUBLE))::INT) ELSE 0 END"
        ends.append(f"SELECT event_type, block, x FROM g WHERE {chosen} AND {deepest} = 0")
        for depth in range(1, level + 1):
            made, end = _denoised(f"c{c}_{depth}_", f"SELECT * FROM g WHERE {chosen} AND {deepest} = {depth}", wavelet, depth, method)
            ctes += made
            ends.append(end)
    return f"WITH {', '.join(ctes)}, o AS ({' UNION ALL '.join(ends)}) SELECT event_type, block::BIGINT AS block, (i - 1)::BIGINT AS place, round(x[i], 4) AS value FROM (SELECT event_type, block, x, unnest(range(1, len(x) + 1)) AS i FROM o)"


def scalograms(n_scales: int, n: int = 256, bandwidth: float = 1.5, centre: float = 1.0) -> str:
    """Peaks of the logged magnitudes by block and scale: every value times the wavelet at every lag."""
    reach = f"ceil(4 * sqrt({bandwidth}::DOUBLE) * {n_scales})::INT + 1"
    return f"""
WITH {_blocks(n)}, v AS (SELECT event_type, block, unnest(x) AS v, unnest(range(0, len(x))) AS i, len(x) AS n FROM g),
h AS (SELECT a, lag, exp(-(lag / a) * (lag / a) / {bandwidth}::DOUBLE) * cos(2 * pi() * {centre} * lag / a) / sqrt(pi() * {bandwidth} * a) AS re, exp(-(lag / a) * (lag / a) / {bandwidth}::DOUBLE) * sin(2 * pi() * {centre} * lag / a) / sqrt(pi() * {bandwidth} * a) AS im
  FROM (SELECT unnest(range(1, {n_scales} + 1))::DOUBLE AS a), (SELECT unnest(range(-({reach}), {reach} + 1)) AS lag)),
m AS (SELECT event_type, block, a, i + lag AS t, sum(v * re) AS re, sum(v * im) AS im FROM v, h WHERE i + lag BETWEEN 0 AND n - 1 GROUP BY ALL)
SELECT event_type || '/' || block AS name, a AS scale, round(1 / a, 9) AS freq, round(max(ln(1 + sqrt(re * re + im * im))), 6) AS peak FROM m GROUP BY event_type, block, a
"""
