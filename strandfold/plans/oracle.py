"""SQL building blocks for the side-by-side checks (plain SQL over the same tables)."""

from __future__ import annotations

AX = ("x", "y", "z")

# Chains, pairs and residue ids derived from the vector table.
BASE = """
src AS (SELECT vec_id AS sid, embedding AS e, label, CAST(len(embedding) // 3 AS BIGINT) AS n FROM embeddings),
pos AS (SELECT sid, n, e, unnest(range(n)) AS p FROM src),
pts AS (SELECT sid, n, p,
  sum(10 * CAST(e[3 * p + 1] AS DOUBLE)) OVER w AS x, sum(10 * CAST(e[3 * p + 2] AS DOUBLE)) OVER w AS y,
  sum(10 * CAST(e[3 * p + 3] AS DOUBLE)) OVER w AS z FROM pos WINDOW w AS (PARTITION BY sid ORDER BY p)),
prs AS (SELECT s.sid AS pid, s.sid AS a, t.sid AS b, s.n AS na, t.n AS nb
  FROM src s JOIN src t ON t.sid = s.sid + 1),
res AS (SELECT sid, n, p, CASE WHEN p < 12 THEN 'A' ELSE 'B' END AS ch,
  CASE WHEN p < 4 THEN p + 1 WHEN p < 12 THEN p ELSE p - 11 END AS sq,
  CASE WHEN p = 4 THEN 'A' ELSE ' ' END AS ic,
  ['ALA','CYS','ASP','GLU','PHE','GLY','HIS','ILE','LYS','LEU','MET','ASN','PRO','GLN','ARG','SER','THR',
   'VAL','TRP','TYR'][(sid + p) % 20 + 1] AS rn,
  'ACDEFGHIKLMNPQRSTVWY'[(sid + p) % 20 + 1] AS letter FROM pos),
cells AS (SELECT r.pid, r.a, r.b, r.na, r.nb, u.p AS i, v.p AS j,
  u.x AS ax, u.y AS ay, u.z AS az, v.x AS bx, v.y AS by_, v.z AS bz
  FROM prs r JOIN pts u ON u.sid = r.a JOIN pts v ON v.sid = r.b),
lft AS (SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY i) - 1 AS k, i, j FROM (
  SELECT r.pid, p.p AS i, p.p + r.a % 3 AS j FROM prs r JOIN pos p ON p.sid = r.a
  WHERE p.p + r.a % 3 < p.n AND (p.p + r.a) % 5 <> 0)),
rgt AS (SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY i) - 1 AS k, i, j FROM (
  SELECT r.pid, p.p AS i, p.p + r.b % 3 AS j FROM prs r JOIN pos p ON p.sid = r.a
  WHERE p.p + r.b % 3 < p.n AND (p.p + r.b) % 4 <> 0)),
axo AS (SELECT pid, o, [1, 0, -1, 0][o + 1] AS c, [0, 1, 0, -1][o + 1] AS s
  FROM prs, (SELECT unnest(range(4)) AS o))
"""

# Atom records of the derived structure texts.
ATOMS = """
atm AS (SELECT r.sid, r.p, 4 + 4 * r.p + slot AS line_no, rec, 4 * r.p + slot + 1 AS serial, nm, alt,
  r.rn, r.ch, r.sq, r.ic, round(q.x + dx, 3) AS x, round(q.y, 3) AS y, round(q.z, 3) AS z
  FROM res r JOIN pts q ON q.sid = r.sid AND q.p = r.p JOIN LATERAL (
    SELECT 0 AS slot, 'ATOM' AS rec, ' N' AS nm, ' ' AS alt, 1.0 AS dx, TRUE AS here
    UNION ALL SELECT 1, 'ATOM', CASE WHEN (r.sid + r.p) % 17 = 0 THEN ' CB' ELSE ' CA' END,
      CASE WHEN r.p = 7 THEN 'A' ELSE ' ' END, 0.0, TRUE
    UNION ALL SELECT 2, 'ATOM', ' CA', 'B', 2.0, r.p = 7
    UNION ALL SELECT 3, 'HETATM', ' O', ' ', 3.0, r.p = 10
    UNION ALL SELECT 400, 'ATOM', ' OXT', ' ', 4.0, r.p = 0 AND r.sid % 40 = 1) t ON t.here)
"""


def query(final: str, *ctes: str, recursive: bool = False) -> str:
    """A WITH query from building blocks and a final select."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(c.strip() for c in (BASE, *ctes)) + "\n" + final


def num(expr: str, name: str, digits: int = 4) -> str:
    """Rounded output column without negative zero."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def moments(source: str, keys: str, name: str = "mom") -> str:
    """Superposition sums per key from rows with ax..bz (b's y column is by_)."""
    b = {"x": "bx", "y": "by_", "z": "bz"}
    sums = ["count(*)::DOUBLE AS cnt"]
    sums += [f"sum(a{r}) AS sa{r}" for r in AX] + [f"sum({b[r]}) AS sb{r}" for r in AX]
    sums += [f"sum(a{r} * {b[c]}) AS c{r}{c}" for r in AX for c in AX]
    sums += ["sum(ax*ax + ay*ay + az*az) AS saa", "sum(bx*bx + by_*by_ + bz*bz) AS sbb"]
    return f"{name} AS (SELECT {keys}, {', '.join(sums)} FROM {source} GROUP BY {keys})"


def fit(keys: str, source: str = "mom", name: str = "fit") -> str:
    """Least ssd per key: largest root of the quartic by Newton iteration from the upper bound."""
    cov = ", ".join(f"c{r}{c} - sa{r} * sb{c} / cnt AS {r}{c}" for r in AX for c in AX)
    means = ", ".join(f"sa{r} / cnt AS ua{r}, sb{r} / cnt AS ub{r}" for r in AX)
    gram = {
        (p, q): " + ".join(f"{r}{p} * {r}{q}" for r in AX) for p in AX for q in AX
    }
    trace = " + ".join(f"({gram[p, p]})" for p in AX)
    square = " + ".join(f"({gram[p, q]}) * ({gram[p, q]})" for p in AX for q in AX)
    det = "xx*(yy*zz - yz*zy) - xy*(yx*zz - yz*zx) + xz*(yx*zy - yy*zx)"
    poly = "((v*v - 2*tr)*v - 8*dt)*v + 2*sq2 - tr*tr"
    slope = "4*(v*v - tr)*v - 8*dt"
    return f"""{name}_c AS (SELECT {keys}, cnt, {cov}, {means},
  saa + sbb - (sax*sax + say*say + saz*saz + sbx*sbx + sby*sby + sbz*sbz) / cnt AS g FROM {source}),
{name}_q AS (SELECT *, {trace} AS tr, {square} AS sq2, {det} AS dt FROM {name}_c),
{name}_l AS (SELECT *, list_reduce(range(60), lambda v, t:
  CASE WHEN abs({slope}) < 1e-290 THEN v ELSE v - ({poly}) / ({slope}) END, g / 2) AS lam FROM {name}_q),
{name} AS (SELECT *, greatest(g - 2 * lam, 0) AS ssd, sqrt(greatest(g - 2 * lam, 0) / cnt) AS rmsd FROM {name}_l)"""


def rotation(keys: str, source: str = "fit", name: str = "rot") -> str:
    """Transforms m11..m34 per key: the eigenvector is a row of cofactors of (key matrix - root)."""
    k = [
        ["xx + yy + zz - lam", "zy - yz", "xz - zx", "yx - xy"],
        ["zy - yz", "xx - yy - zz - lam", "xy + yx", "zx + xz"],
        ["xz - zx", "xy + yx", "-xx + yy - zz - lam", "yz + zy"],
        ["yx - xy", "zx + xz", "yz + zy", "-xx - yy + zz - lam"],
    ]

    def minor(r: int, c: int) -> str:
        m = [[k[i][j] for j in range(4) if j != c] for i in range(4) if i != r]
        d = lambda p, q: f"(({m[1][p]}) * ({m[2][q]}) - ({m[1][q]}) * ({m[2][p]}))"
        return f"(({m[0][0]}) * {d(1, 2)} - ({m[0][1]}) * {d(0, 2)} + ({m[0][2]}) * {d(0, 1)})"

    rows = []
    for r in range(4):
        rows.append("[" + ", ".join(f"{'' if (r + c) % 2 == 0 else '-'}{minor(r, c)}" for c in range(4)) + "]")
    best = "list_sort([{'s': list_sum(list_transform(v, lambda t: t * t)), 'v': v} for v in vs], 'DESC')[1].v"
    cells = {
        "m11": "w*w + x*x - y*y - z*z", "m12": "2*(x*y - w*z)", "m13": "2*(x*z + w*y)",
        "m21": "2*(x*y + w*z)", "m22": "w*w - x*x + y*y - z*z", "m23": "2*(y*z - w*x)",
        "m31": "2*(x*z - w*y)", "m32": "2*(y*z + w*x)", "m33": "w*w - x*x - y*y + z*z",
    }
    unit = ", ".join(f"q[{i}] / sqrt(list_sum(list_transform(q, lambda t: t * t))) AS {c}" for i, c in enumerate("wxyz", 1))
    shift = ", ".join(
        f"ua{a} - (m{r}1 * ubx + m{r}2 * uby + m{r}3 * ubz) AS m{r}4" for r, a in enumerate(AX, 1)
    )
    return f"""{name}_v AS (SELECT *, [{', '.join(rows)}] AS vs FROM {source}),
{name}_q AS (SELECT *, {best} AS q FROM {name}_v),
{name}_u AS (SELECT {keys}, cnt, ssd, rmsd, uax, uay, uaz, ubx, uby, ubz, {unit} FROM {name}_q),
{name}_m AS (SELECT {keys}, cnt, ssd, rmsd, uax, uay, uaz, ubx, uby, ubz,
  {', '.join(f'{v} AS {c}' for c, v in cells.items())} FROM {name}_u),
{name} AS (SELECT *, {shift} FROM {name}_m)"""


def matched(matches: str, name: str) -> str:
    """Coordinates of the matches of a match CTE."""
    return f"{name} AS (SELECT m.pid, m.k, m.i, m.j, c.ax, c.ay, c.az, c.bx, c.by_, c.bz FROM {matches} m JOIN cells c USING (pid, i, j))"


def layers(cost: str, name: str = "lay") -> str:
    """Layered recurrence from a table cost(g, i, j, c, na, nb): least cost of n ordered pairs.

    Each step is a two-dimensional prefix minimum, as two window minima.
    """
    return f"""{name} AS (
  SELECT g, 1 AS n, i, j, min(s) OVER (PARTITION BY g, i ORDER BY j) AS s FROM (
    SELECT g, i, j, min(c) OVER (PARTITION BY g, j ORDER BY i) AS s FROM {cost})
  UNION ALL
  SELECT g, n, i, j, min(s) OVER (PARTITION BY g, i ORDER BY j) AS s FROM (
    SELECT g, n, i, j, min(s) OVER (PARTITION BY g, j ORDER BY i) AS s FROM (
      SELECT l.g, l.n + 1 AS n, d.i, d.j, l.s + d.c AS s FROM {name} l
      JOIN {cost} d ON d.g = l.g AND d.i = l.i + 1 AND d.j = l.j + 1)))"""


def scores(source: str, keys: str, name: str = "sco") -> str:
    """Similarity score and probability from rows (keys, k, i, j, d2), ordered matches."""
    ln = "ln(n::DOUBLE)"
    ln120 = "ln(120.0::DOUBLE)"
    c, d, e, f, g = "18.411424", "-4.501719", "2.637163", "21.351857", "-37.521269"
    slope = f"(2 * {ln120} * {c} + {d})"
    return f"""{name}_g AS (SELECT *, CASE WHEN lag(i) OVER w IS NULL THEN 0
  WHEN i - lag(i) OVER w > 1 OR j - lag(j) OVER w > 1 THEN 1 ELSE 0 END AS gap
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY k)),
{name}_s AS (SELECT {keys}, count(*) AS n, sum(gap) AS gaps, sum(20 / (1 + d2 / 25)) - 10 * sum(gap) AS s_str
  FROM {name}_g GROUP BY {keys}),
{name}_m AS (SELECT *, CASE WHEN n < 120 THEN {c} * {ln} * {ln} + {d} * {ln} + {e}
    ELSE {slope} * {ln} + ({ln120} * {ln120} * {c} + {ln120} * {d} + {e} - {slope} * {ln120}) END AS mu_str,
  CASE WHEN n < 120 THEN {f} * {ln} + {g} ELSE {f} * {ln120} + {g} END AS delta_str FROM {name}_s),
{name} AS (SELECT *, (s_str - mu_str) / delta_str AS z_str,
  CASE WHEN (s_str - mu_str) / delta_str < ln(5000.0::DOUBLE)
    THEN 1 - exp(-exp(-(s_str - mu_str) / delta_str)) ELSE exp(-(s_str - mu_str) / delta_str) END AS p_str FROM {name}_m)"""
