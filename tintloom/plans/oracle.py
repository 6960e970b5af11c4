"""DuckDB SQL that the queries must equal, put together from named common table expressions."""

from __future__ import annotations

import re

from ..config import DEFAULT_STAINS, MODES
from ..functions.color import KNEE, RGB_TO_XYZ, WHITE, XYZ_TO_RGB, ols_weights

# A literal basis, low and high angles and stains for the steps after the eigenvectors.
PLANE = ((-0.47, 0.62), (-0.79, -0.18), (-0.39, -0.76))


def d(x: float) -> str:
    return f"({float(x)!r})::DOUBLE"


def _mix(row, names) -> str:
    return " + ".join(f"{d(w)} * {n}" for w, n in zip(row, names, strict=True))


def lin(v: str) -> str:
    return f"(CASE WHEN {v} > {d(0.04045)} THEN pow(({v} + {d(0.055)}) / {d(1.055)}, {d(2.4)}) ELSE {v} / {d(12.92)} END)"


def fwd(t: str) -> str:
    return f"(CASE WHEN {t} > {d(KNEE**3)} THEN cbrt({t}) ELSE {t} / {d(3 * KNEE**2)} + {d(4 / 29)} END)"


def inv(t: str) -> str:
    return f"(CASE WHEN {t} > {d(KNEE)} THEN {t} * {t} * {t} ELSE {d(3 * KNEE**2)} * ({t} - {d(4 / 29)}) END)"


def gamma(v: str) -> str:
    return f"(CASE WHEN {v} > {d(0.0031308)} THEN {d(1.055)} * pow({v}, {d(1 / 2.4)}) - {d(0.055)} ELSE {v} * {d(12.92)} END)"


def clamp(v: str, low: float, high: float) -> str:
    return f"least(greatest({v}, {d(low)}), {d(high)})"


def lab(source: str, names=("r", "g", "b"), out=("l_", "a_", "b_")) -> str:
    """A query of source's columns with the LAB columns."""
    x = ", ".join(f"{lin(f'({n}::DOUBLE / {d(255)})')} x{i}" for i, n in enumerate(names))
    q = ", ".join(f"({_mix(row, ('x0', 'x1', 'x2'))}) / {d(w)} q{i}" for i, (row, w) in enumerate(zip(RGB_TO_XYZ, WHITE, strict=True)))
    f = ", ".join(f"{fwd(f'q{i}')} f{i}" for i in range(3))
    return f"SELECT * EXCLUDE (f0, f1, f2), {d(116)} * f1 - {d(16)} {out[0]}, {d(500)} * (f0 - f1) {out[1]}, {d(200)} * (f1 - f2) {out[2]} FROM (SELECT * EXCLUDE (q0, q1, q2), {f} FROM (SELECT * EXCLUDE (x0, x1, x2), {q} FROM (SELECT *, {x} FROM {source})))"


def rgb(source: str, names=("l_", "a_", "b_")) -> str:
    """A query of source's columns with r2, g2, b2 from LAB."""
    fy = f"(({names[0]} + {d(16)}) / {d(116)})"
    f = f"{names[1]} / {d(500)} + {fy} f0, {fy} f1, {fy} - {names[2]} / {d(200)} f2"
    q = ", ".join(f"{inv(f'f{i}')} * {d(w)} q{i}" for i, w in enumerate(WHITE))
    x = ", ".join(f"{clamp(_mix(row, ('q0', 'q1', 'q2')), 0, 1)} x{i}" for i, row in enumerate(XYZ_TO_RGB))
    o = ", ".join(f"CAST(round_even({clamp(gamma(f'x{i}'), 0, 1)} * {d(255)}, 0) AS INT) {c}" for i, c in enumerate(("r2", "g2", "b2")))
    return f"SELECT * EXCLUDE (x0, x1, x2), {o} FROM (SELECT * EXCLUDE (q0, q1, q2), {x} FROM (SELECT * EXCLUDE (f0, f1, f2), {q} FROM (SELECT *, {f} FROM {source})))"


def od(c: str) -> str:
    return f"(-ln(least(greatest({c}, 1), 254)::DOUBLE / {d(255)}))"


def back(v: str) -> str:
    return f"CAST(floor({clamp(f'exp(-({v})) * {d(255)}', 0, 255)}) AS INT)"


def conc(stains=DEFAULT_STAINS) -> str:
    return ", ".join(f"{_mix(row, ('od_r', 'od_g', 'od_b'))} c{i}" for i, row in enumerate(ols_weights(stains).tolist()))


def from_conc(source: str, stains=DEFAULT_STAINS) -> str:
    o = ", ".join(f"{back(_mix((stains[0][i], stains[1][i]), ('c0', 'c1')))} {c}2" for i, c in enumerate("rgb"))
    return f"SELECT *, {o} FROM {source}"


def _long(source: str, by: str) -> str:
    return " UNION ALL ".join(f"SELECT {by} '{c.upper()}' ch, {c} v, count(*) n FROM {source} GROUP BY ALL" for c in "rgb")


def _dense(source: str, by: str) -> str:
    keys = by + "ch"
    return f"SELECT k.*, CAST(t.v AS INT) v, coalesce(h.n, 0) n FROM (SELECT DISTINCT {keys} FROM {source}) k CROSS JOIN range(256) t(v) LEFT JOIN {source} h USING ({by} ch, v)"


def _cdf(source: str, by: str) -> str:
    return f"SELECT {by} ch, v, (sum(n) OVER (PARTITION BY {by} ch ORDER BY v))::DOUBLE / (sum(n) OVER (PARTITION BY {by} ch))::DOUBLE cdf FROM {source}"


def _axis(i: str, size: str, n: int) -> str:
    return f"CAST(CASE WHEN {i} = {n - 1} THEN {size} - 20 ELSE floor({d(10)} + {i} * (({size} - 30)::DOUBLE / {d(n - 1)})) END AS INT)"


def _score(area: str) -> str:
    return f"sqrt((3 * {area} * sum(r*r + g*g + b*b) - sum(r + g + b) * sum(r + g + b))::DOUBLE) / (3 * {area}) score, count_if(r + g + b > 690)::DOUBLE / {area} white_frac, 10 * count_if(r + g + b > 690) >= 9 * {area} mostly_white"


def _lut(source: str, target: str, by: str) -> str:
    return f"SELECT {', '.join(f's.{k}' for k in by.split())}, s.ch, s.v, CAST(min(t.v) AS INT) lut FROM {source} s JOIN {target} t ON t.ch = s.ch AND t.cdf >= s.cdf GROUP BY ALL"


def _matched(lut: str, by: str) -> str:
    joins = " ".join(f"JOIN {lut} l{c} ON {' AND '.join(f'l{c}.{k} = p.{k}' for k in by.split())} AND l{c}.ch = '{c.upper()}' AND l{c}.v = p.{c}" for c in "rgb")
    return f"SELECT p.*, lr.lut r2, lg.lut g2, lb.lut b2 FROM px p {joins}"


def _white(source: str) -> str:
    """Background becomes white. source has r2, g2, b2."""
    return f"SELECT slide_id, tx, ty, x, y, r, g, b, {', '.join(f'CASE WHEN light >= {d(88)} THEN 255 ELSE {c}2 END {c}2' for c in 'rgb')} FROM (SELECT * FROM {source}) JOIN (SELECT slide_id, x, y, l_ light FROM pl) USING (slide_id, x, y)"


_STATS = ", ".join(f"avg({c}_) mu_{c}, stddev_pop({c}_) sigma_{c}" for c in "lab")
_MEANS = ", ".join(f"avg({k}_{c}) {k}_{c}" for c in "lab" for k in ("mu", "sigma"))


def _reinhard(stats: str, using: str, target: str) -> str:
    moved = ", ".join(clamp(f"CASE WHEN s.sigma_{c} > 1e-6 THEN (p.{c}_ - s.mu_{c}) / s.sigma_{c} * t.sigma_{c} + t.mu_{c} ELSE p.{c}_ END", *lim) + f" {c}_" for c, lim in zip("lab", ((0, 100), (-128, 127), (-128, 127)), strict=True))
    return rgb(f"(SELECT p.slide_id, p.tx, p.ty, p.x, p.y, p.r, p.g, p.b, {moved} FROM pl p JOIN {stats} s USING ({using}) CROSS JOIN {target} t)")


def _times(a: str, b: str) -> str:
    """The product of two symmetric 3 x 3 matrices given as nine columns each, a00 to a22."""
    return ", ".join(f"{' + '.join(f'{a}{i}{k} * {b}{k}{j}' for k in range(3))} m{i}{j}" for i in range(3) for j in range(3))


def _longest(prefix: str) -> str:
    """The unit direction of the longest column of m00 to m22, as prefix0 to prefix2."""
    n = [f"(m0{j} * m0{j} + m1{j} * m1{j} + m2{j} * m2{j})" for j in range(3)]
    pick = lambda i: f"CASE WHEN {n[0]} >= {n[1]} AND {n[0]} >= {n[2]} THEN m{i}0 / sqrt({n[0]}) WHEN {n[1]} >= {n[2]} THEN m{i}1 / sqrt({n[1]}) ELSE m{i}2 / sqrt({n[2]}) END {prefix}{i}"
    return ", ".join(map(pick, range(3)))


def _less(value: str, name: str) -> str:
    """The matrix of sums less a value, as nine columns."""
    return ", ".join(f"s{min(i, j)}{max(i, j)}{f' - {value}' if i == j else ''} {name}{i}{j}" for i in range(3) for j in range(3))


_SUMS = ", ".join(f"sum(od_{a} * od_{b}) s{i}{j}" for i, a in enumerate("rgb") for j, b in enumerate("rgb") if i <= j)
_MIX = " + ".join("w{0}%d * od_%s" % (j, c) for j, c in enumerate("rgb"))
_WEIGHTS = ", ".join(f"CASE WHEN aa * dd - bb * bb > 1e-12 THEN ({x} * {k}_{c} - bb * {j}_{c}) / (aa * dd - bb * bb) ELSE {k}_{c} / 2 END w{n}{i}" for i, c in enumerate("rgb") for n, (x, k, j) in enumerate((("dd", "h", "e"), ("aa", "e", "h"))))
_STAIN = ", ".join(f"{k}_{c}" for k in "he" for c in "rgb")

T = "slide_id, tx, ty,"
CTES = {
    "px": f"""SELECT slide_id, tx, ty, x, y, {', '.join(f"CAST(CASE WHEN (tx + ty + slide_id) % 4 = 0 THEN 240 + ch % 16 ELSE 245 - (ch * {h}) // 100 - (ce * {e}) // 100 END AS INT) {c}" for c, h, e in (("r", 150, 10), ("g", 110, 120), ("b", 50, 30)))}
        FROM (SELECT *, CAST(x // 10 AS INT) tx, CAST(y // 10 AS INT) ty FROM (SELECT CAST(event_id % 4 AS INT) slide_id, CAST((event_id // 4) % 50 AS INT) x, CAST((event_id // 4) // 50 AS INT) y, CAST(user_id % 100 AS INT) ce, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) ch FROM events))""",
    "sl": "SELECT slide_id, CAST(max(x) + 1 AS INT) width, CAST(max(y) + 1 AS INT) height FROM px GROUP BY 1",
    "full_grid": "SELECT slide_id, CAST(tx AS INT) tx, CAST(ty AS INT) ty, CAST(tx * 10 AS INT) x, CAST(ty * 10 AS INT) y, CAST(least(10, width - tx * 10) AS INT) w, CAST(least(10, height - ty * 10) AS INT) h, printf('%d_x%04d_y%04d.png', slide_id, tx, ty) file FROM (SELECT sl.*, unnest(range(CAST(ceil(height / 10) AS BIGINT))) ty FROM sl), LATERAL (SELECT unnest(range(CAST(ceil(width / 10) AS BIGINT))) tx)",
    "bio0": f"SELECT slide_id, width, height, i, j, {_axis('i', 'width', 7)} x, {_axis('j', 'height', 7)} y FROM sl, range(7) a(i), range(7) b(j)",
    "bio": "SELECT slide_id, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY pow(x - width / 2.0::DOUBLE, 2) + pow(y - height / 2.0::DOUBLE, 2), i, j) - 1 AS INT) seq, x, y FROM bio0",
    "tma": f"SELECT slide_id, CAST(i * 12 + j AS INT) seq, {_axis('i', 'width', 12)} x, {_axis('j', 'height', 12)} y FROM sl, range(12) a(i), range(12) b(j)",
    **{w: f"SELECT g.slide_id, g.seq, g.x, g.y, CAST(g.x + dx AS INT) px, CAST(g.y + dy AS INT) py, coalesce(p.r, 0) r, coalesce(p.g, 0) g, coalesce(p.b, 0) b FROM {grid} g CROSS JOIN range(10) a(dx) CROSS JOIN range(10) c(dy) LEFT JOIN px p ON p.slide_id = g.slide_id AND p.x = g.x + dx AND p.y = g.y + dy" for w, grid in (("bw", "bio"), ("tw", "tma"))},
    **{s: f"SELECT slide_id, seq, x, y, {_score('100')} FROM {w} GROUP BY slide_id, seq, x, y" for s, w in (("bs", "bw"), ("ts", "tw"))},
    "bv": "SELECT bs.*, score >= q1 - 1.5 * (q3 - q1) AND NOT mostly_white valid FROM bs JOIN (SELECT slide_id, quantile_cont(score, 0.25) q1, quantile_cont(score, 0.75) q3 FROM bs GROUP BY 1) USING (slide_id)",
    "tv": "SELECT ts.*, score >= q valid FROM ts JOIN (SELECT slide_id, quantile_cont(score, 0.75) q FROM ts GROUP BY 1) USING (slide_id)",
    **{u: f"SELECT * EXCLUDE (nv), CASE WHEN nv < 5 THEN total_count ELSE nv END valid_count, nv < 5 fallback, valid OR nv < 5 used FROM (SELECT *, CAST(sum(valid::INT) OVER (PARTITION BY slide_id) AS INT) nv, CAST(count(*) OVER (PARTITION BY slide_id) AS INT) total_count FROM {v})" for u, v in (("bu", "bv"), ("tu", "tv"))},
    "su": "SELECT bw.* FROM bw JOIN (SELECT slide_id, seq FROM bu WHERE used) USING (slide_id, seq)",
    "sh": _long("su", "slide_id,"),
    "sd": _dense("sh", "slide_id,"),
    "sc": _cdf("sd", "slide_id,"),
    "tg1": "SELECT ch, v, cdf FROM sc WHERE slide_id = 0",
    "tg2": "SELECT ch, v, list_reduce(list(cdf ORDER BY slide_id), lambda a, b: a + b) / count(*) cdf FROM sc GROUP BY ch, v",
    "hh": _long("px", "slide_id,"),
    "hd": _dense("hh", "slide_id,"),
    "hc": _cdf("hd", "slide_id,"),
    "th": _long("px", T),
    "tc": _cdf("th", T),
    "lut0": _lut("tc", "(SELECT * FROM hc WHERE slide_id = 0)", "slide_id tx ty"),
    "lut1": _lut("tc", "tg1", "slide_id tx ty"),
    "lut2": _lut("tc", "tg2", "slide_id tx ty"),
    "m0": _matched("lut0", "slide_id tx ty"),
    "m1": _matched("lut1", "slide_id tx ty"),
    "m2": _matched("lut2", "slide_id tx ty"),
    "ilut": _lut("(" + _cdf("hh", "slide_id,") + ")", "(SELECT * FROM hc WHERE slide_id = 0)", "slide_id"),
    "im": _matched("ilut", "slide_id"),
    "bc": _cdf("(" + _dense("(" + _long("px", "") + ")", "") + ")", ""),
    "blut": _lut("(" + _cdf("hh", "slide_id,") + ")", "bc", "slide_id"),
    "bm": _matched("blut", "slide_id"),
    "pl": lab("px"),
    "tst": f"SELECT {T} {_STATS} FROM pl GROUP BY ALL",
    "ist": f"SELECT slide_id, {_STATS} FROM pl GROUP BY ALL",
    "wl": lab("su"),
    "sst": f"SELECT slide_id, {_MEANS} FROM (SELECT slide_id, seq, {_STATS} FROM wl GROUP BY slide_id, seq) GROUP BY slide_id",
    "tg3": "SELECT * FROM sst WHERE slide_id = 0",
    "tg4": f"SELECT {_MEANS} FROM sst",
    "tg5": "SELECT * FROM ist WHERE slide_id = 0",
    "r3": _reinhard("tst", "slide_id, tx, ty", "tg3"),
    "r4": _reinhard("tst", "slide_id, tx, ty", "tg4"),
    "r3s": _reinhard("sst", "slide_id", "tg3"),
    "ir": _reinhard("ist", "slide_id", "tg5"),
    "tg6": f"SELECT {_MEANS} FROM ist",
    "br": _reinhard("ist", "slide_id", "tg6"),
    "po": f"SELECT *, {', '.join(f'{od(c)} od_{c}' for c in 'rgb')} FROM px",
    "pt": f"SELECT * FROM po WHERE sqrt(od_r * od_r + od_g * od_g + od_b * od_b) > {d(0.15)}",
    "pc": f"SELECT *, {conc()} FROM po",
    "mp": "SELECT slide_id, tx, ty, quantile_cont(c0, 0.99) p0, quantile_cont(c1, 0.99) p1 FROM pc GROUP BY ALL",
    "ma": from_conc("(SELECT pc.* EXCLUDE (c0, c1), c0 * 1.0 / (p0 + 1e-6) c0, c1 * 1.0 / (p1 + 1e-6) c1 FROM pc JOIN mp USING (slide_id, tx, ty))"),
    "va": from_conc(f"(SELECT * EXCLUDE (c0, c1), greatest(c0, {d(0)}) c0, greatest(c1, {d(0)}) c1 FROM pc)"),
    # the plane of the used windows' tissue: eigenvalues in closed form, directions as columns of (A - x)(A - y)
    "ut": f"SELECT * FROM (SELECT slide_id, {', '.join(f'{od(c)} od_{c}' for c in 'rgb')} FROM su) WHERE sqrt(od_r * od_r + od_g * od_g + od_b * od_b) > {d(0.15)}",
    "ug": f"SELECT slide_id, count(*) n, {_SUMS}, (s00 + s11 + s22) / 3 q, sqrt(((s00 - q) * (s00 - q) + (s11 - q) * (s11 - q) + (s22 - q) * (s22 - q) + 2 * (s01 * s01 + s02 * s02 + s12 * s12)) / 6) p FROM ut GROUP BY slide_id HAVING count(*) >= 100",
    "ue": "SELECT *, q + 2 * p * cos(phi) x0, q + 2 * p * cos(phi + 2 * pi() / 3) x2, 3 * q - x0 - x2 x1 FROM (SELECT *, acos(greatest(-1, least(1, ((s00 - q) * ((s11 - q) * (s22 - q) - s12 * s12) - s01 * (s01 * (s22 - q) - s12 * s02) + s02 * (s01 * s12 - (s11 - q) * s02)) / (p * p * p) / 2))) / 3 phi FROM ug)",
    "uf": f"SELECT slide_id, {_longest('f')} FROM (SELECT slide_id, {_times('a', 'b')} FROM (SELECT slide_id, {_less('x1', 'a')}, {_less('x2', 'b')} FROM ue))",
    "ul": f"SELECT slide_id, {_longest('l')} FROM (SELECT slide_id, {_times('a', 'b')} FROM (SELECT slide_id, {_less('x0', 'a')}, {_less('x1', 'b')} FROM ue))",
    "uz": "SELECT slide_id, f0, f1, f2, l1 * f2 - l2 * f1 z0, l2 * f0 - l0 * f2 z1, l0 * f1 - l1 * f0 z2 FROM uf JOIN ul USING (slide_id)",
    "up": f"SELECT slide_id, {', '.join(f'{k}{i} * CASE WHEN {k}0 + {k}1 + {k}2 > 0 THEN -1 ELSE 1 END {k}{i}' for k in 'fz' for i in range(3))} FROM uz",
    "ua": f"SELECT slide_id, quantile_cont(t, 0.15) low, quantile_cont(t, 0.85) high FROM (SELECT slide_id, atan2({' + '.join(f'z{i} * od_{c}' for i, c in enumerate('rgb'))}, {' + '.join(f'f{i} * od_{c}' for i, c in enumerate('rgb'))}) t FROM ut JOIN up USING (slide_id)) GROUP BY slide_id",
    "ub": f"SELECT slide_id, {', '.join(f'f{i} * cos({t}) + z{i} * sin({t}) {k}{i}' for k, t in (('a', 'low'), ('b', 'high')) for i in range(3))} FROM up JOIN ua USING (slide_id)",
    "us": f"SELECT slide_id, {', '.join(f'CASE WHEN a0 / na > b0 / nb THEN {y}{i} / n{y} ELSE {x}{i} / n{x} END {k}_{c}' for k, x, y in (('h', 'a', 'b'), ('e', 'b', 'a')) for i, c in enumerate('rgb'))} FROM (SELECT *, sqrt(a0 * a0 + a1 * a1 + a2 * a2) na, sqrt(b0 * b0 + b1 * b1 + b2 * b2) nb FROM ub)",
    "uw": f"SELECT slide_id, {_STAIN}, {_WEIGHTS} FROM (SELECT *, h_r * h_r + h_g * h_g + h_b * h_b aa, h_r * e_r + h_g * e_g + h_b * e_b bb, e_r * e_r + e_g * e_g + e_b * e_b dd FROM us)",
    "um": f"SELECT slide_id, quantile_cont({_MIX.format(0)}, 0.99) max0, quantile_cont({_MIX.format(1)}, 0.99) max1 FROM ut JOIN uw USING (slide_id) GROUP BY slide_id",
    "fit5": "SELECT slide_id, " + ", ".join(f"coalesce({k}_{c}, {d(DEFAULT_STAINS[i][j])}) {k}_{c}" for i, k in enumerate("he") for j, c in enumerate("rgb")) + ", coalesce(max0, 1.0::DOUBLE) max0, coalesce(max1, 1.0::DOUBLE) max1, h_r IS NULL fallback FROM sl LEFT JOIN us USING (slide_id) LEFT JOIN um USING (slide_id)",
    "to5": f"SELECT {_STAIN}, max0, max1, {_WEIGHTS} FROM (SELECT *, h_r * h_r + h_g * h_g + h_b * h_b aa, h_r * e_r + h_g * e_g + h_b * e_b bb, e_r * e_r + e_g * e_g + e_b * e_b dd FROM fit5 WHERE slide_id = 0)",
    "c5": f"SELECT po.*, {_STAIN}, max0, max1, {_MIX.format(0)} c0, {_MIX.format(1)} c1 FROM po CROSS JOIN to5",
    "p5": "SELECT slide_id, tx, ty, quantile_cont(c0, 0.99) p0, quantile_cont(c1, 0.99) p1 FROM c5 GROUP BY ALL",
    "n5": "SELECT *, " + ", ".join(back(f"h_{c} * (c0 * max0 / (p0 + 1e-6)) + e_{c} * (c1 * max1 / (p1 + 1e-6))") + f" {c}2" for c in "rgb") + " FROM c5 JOIN p5 USING (slide_id, tx, ty)",
    "tile_scores": f"SELECT {T} {_score('count(*)')} FROM px GROUP BY ALL",
    "save": f"SELECT slide_id, tx, ty, score, white_frac, mostly_white OR score < 5 skipped FROM (SELECT {T} {_score('100')} FROM px GROUP BY ALL)",
}


def query(select: str) -> str:
    """The select with the expressions it needs, in order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and name not in need and re.search(rf"(FROM|JOIN|,)\s*\(*\s*(SELECT \* FROM )?{name}\b", text):
                visit(CTES[name])
                if name not in need:
                    need.append(name)

    visit(select)
    return (f"WITH {', '.join(f'{n} AS ({CTES[n]})' for n in need)} " if need else "") + select


_P2 = "slide_id, tx, ty, x, y, r2, g2, b2"


def _qc(source: str) -> str:
    """Quality rows of RGB channels; source has r, g, b, r2, g2, b2."""
    long = " UNION ALL ".join(f"SELECT slide_id, '{c.upper()}' ch, {c} v, {c}2 v2 FROM {source}" for c in "rgb")
    dev = lambda v: f"sqrt((count(*) * sum({v} * {v}) - sum({v}) * sum({v}))::DOUBLE) / count(*)"
    return f"SELECT slide_id, ch, round(avg(v), 6) orig_mean, round({dev('v')}, 6) orig_std, round(avg(v2), 6) norm_mean, round({dev('v2')}, 6) norm_std FROM ({long}) GROUP BY ALL"


def _wasserstein(source: str) -> str:
    sides = [f"SELECT * FROM ({_cdf('(' + _dense('(' + _long(f'(SELECT slide_id, {cols} FROM {source})', 'slide_id,') + ')', 'slide_id,') + ')', 'slide_id,')})" for cols in ("r, g, b", "r2 r, g2 g, b2 b")]
    return f"SELECT slide_id, ch, round(sum(abs(a.cdf - z.cdf)) / 256, 6) wasserstein FROM ({sides[0]}) a JOIN ({sides[1]}) z USING (slide_id, ch, v) GROUP BY ALL"


def _labqc(source: str) -> str:
    both = lab(f"({lab(source)})", ("r2", "g2", "b2"), ("l2_", "a2_", "b2_"))
    long = " UNION ALL ".join(f"SELECT slide_id, '{c.upper() if c == 'l' else c}' ch, {c}_ v, {c}2_ v2 FROM pair" for c in "lab")
    return f"SELECT slide_id, ch, round(avg(v), 5) orig_mean_lab, round(stddev_pop(v), 5) orig_std_lab, round(avg(v2), 5) norm_mean_lab, round(stddev_pop(v2), 5) norm_std_lab, round(avg(abs(v2 - v)), 5) delta_e FROM (WITH pair AS ({both}) {long}) GROUP BY ALL"


#: Endings of the file names that the discovery queries make: of slides and images, in both cases, and of other files.
ENDINGS = [".tif", ".SVS", ".png", ".dcm", "", ".ndpi", ".jpeg", ".bmp", ".tar.tiff", ".JPG", ".txt"]
_MPP = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN event_type WHEN 2 THEN '0' ELSE CAST((user_id % 97 + 1)::DOUBLE / 64 AS VARCHAR) END"


def _found(suffixes) -> str:
    made = f"SELECT '/data/' || event_type || '.' || event_id || ({ENDINGS!r})[user_id % {len(ENDINGS)} + 1] AS path FROM events"
    return f"SELECT path, regexp_extract(path, '[^/]+$') AS name, regexp_replace(regexp_extract(path, '[^/]+$'), '^(.+)\\.[^.]+$', '\\1') stem FROM ({made}) WHERE lower(regexp_extract(regexp_extract(path, '[^/]+$'), '^.+(\\.[^.]+)$', 1)) IN ({', '.join(map(repr, suffixes))})"


def _r(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) {n}" for n in names.split())


def _log_sql() -> str:
    one = lambda n: f"CAST(CASE WHEN NOT skipped THEN {n} END AS INT)"
    return f"SELECT 's' || slide_id || '_' || tx || '_' || ty filename, {one(1)} tiles_total, {one(1)} tiles_saved, {one(0)} tiles_skipped, 'HistMatch-Reference' \"method\", CASE WHEN skipped THEN 'nothing but background' END error FROM save"


def _run_log_sql() -> str:
    some = lambda n: f"CAST(CASE WHEN count_if(NOT skipped) > 0 THEN {n} END AS INT)"
    whole = f"SELECT 's' || slide_id filename, {some('count(*)')} tiles_total, {some('count_if(NOT skipped)')} tiles_saved, {some('count_if(skipped)')} tiles_skipped, 'HistMatch-Reference' \"method\", CASE WHEN count_if(NOT skipped) = 0 THEN 'nothing but background' END error FROM save GROUP BY slide_id"
    return f"{whole} UNION ALL {_log_sql()}"


def build(wsi_suffixes, image_suffixes) -> dict[str, str]:
    stat = " ".join(f"{k}_{c}" for c in "lab" for k in ("mu", "sigma"))
    q = {
        "pixel_view": "SELECT * FROM px",
        "file_discovery_wsi": _found(wsi_suffixes),
        "file_discovery_images": _found(image_suffixes),
        "slide_info": "SELECT slide_id, width, height, 1 levels, 'unknown' mpp, CAST(ceil(width / 512.0) * ceil(height / 512.0) AS BIGINT) approx_tiles FROM sl",
        "thumbnail_box": f"SELECT slide_id, CAST(x // 4 AS INT) x, CAST(y // 4 AS INT) y, {', '.join(f'CAST((2 * sum({c}) + count(*)) // (2 * count(*)) AS INT) {c}' for c in 'rgb')}, count(*) n FROM px GROUP BY slide_id, x // 4, y // 4",
        "thumbnail_area": "SELECT slide_id, CAST(t AS INT) x, CAST(u AS INT) y, " + ", ".join(f"CAST((2 * sum({c} * ox * oy) + width * height) // (2 * width * height) AS INT) {c}" for c in "rgb") + " FROM (SELECT *, least((x + 1) * tw, (t + 1) * width) - greatest(x * tw, t * width) ox, least((y + 1) * th, (u + 1) * height) - greatest(y * th, u * height) oy FROM (SELECT *, unnest(range((y * th) // height, ((y + 1) * th - 1) // height + 1)) u FROM (SELECT *, unnest(range((x * tw) // width, ((x + 1) * tw - 1) // width + 1)) t FROM (SELECT px.*, CAST(width AS BIGINT) width, CAST(height AS BIGINT) height, CASE WHEN greatest(width, height) <= 16 THEN width ELSE greatest(1, width * 16 // greatest(width, height)) END tw, CASE WHEN greatest(width, height) <= 16 THEN height ELSE greatest(1, height * 16 // greatest(width, height)) END th FROM px JOIN sl USING (slide_id))))) GROUP BY slide_id, t, u, width, height",
        "tile_grid": "SELECT * FROM full_grid",
        "biopsy_grid": "SELECT * FROM bio",
        "tma_grid": "SELECT * FROM tma",
        "grids_in_sql": "SELECT slide_id, 'biopsy' kind, seq, x, y FROM bio UNION ALL SELECT slide_id, 'tma', seq, x, y FROM tma",
        "sampled_tile_pixels": "SELECT * FROM bw",
        "tile_score": f"SELECT slide_id, tx, ty, {_r('score')} FROM tile_scores",
        "mostly_white": f"SELECT slide_id, tx, ty, {_r('white_frac')}, mostly_white FROM tile_scores",
        "biopsy_filter": "SELECT slide_id, seq, x, y, valid FROM bv",
        "tma_filter": "SELECT slide_id, seq, x, y, valid FROM tv",
        "filter_with_fallback": f"SELECT slide_id, seq, {_r('score')}, valid, valid_count, total_count, fallback, used FROM bu",
        "tile_save_manifest": f"SELECT slide_id, tx, ty, file, {_r('score')}, skipped FROM save JOIN (SELECT slide_id, tx, ty, file FROM full_grid) USING (slide_id, tx, ty)",
        "tile_save_counts": "SELECT slide_id, CAST(count(*) AS INT) tiles_total, CAST(count_if(NOT skipped) AS INT) tiles_saved, CAST(count_if(skipped) AS INT) tiles_skipped FROM save GROUP BY slide_id",
        "background_mask": f"SELECT slide_id, x, y, l_ >= {d(88)} bg FROM pl",
        "all_background_tiles": f"SELECT slide_id, tx, ty, bool_and(l_ >= {d(88)}) all_bg FROM pl GROUP BY ALL",
        "channel_histogram": "SELECT * FROM hh",
        "channel_cdf": f"SELECT slide_id, ch, v, {_r('cdf')} FROM hc",
        "image_cdf": "SELECT slide_id, v, " + ", ".join(f"round(max(CASE WHEN ch = '{c.upper()}' THEN cdf END), 6) {c}" for c in "rgb") + " FROM hc GROUP BY slide_id, v",
        "slide_histogram_stats": f"SELECT sc.slide_id, ch, v, {_r('cdf')}, valid_count, total_count, fallback FROM sc JOIN (SELECT DISTINCT slide_id, valid_count, total_count, fallback FROM bu) USING (slide_id)",
        "batch_cdf_pixel_weighted": f"SELECT ch, v, {_r('cdf')} FROM ({_cdf('(' + _dense('(' + _long('px', '') + ')', '') + ')', '')})",
        "batch_cdf_slide_weighted": f"SELECT ch, v, {_r('cdf')} FROM tg2",
        "match_lut": "SELECT * FROM lut0",
        "histogram_match": f"SELECT {_P2} FROM m0",
        "histogram_match_bg": f"SELECT {_P2} FROM ({_white('m0')})",
        "packed_histogram_match_bg": f"SELECT {_P2} FROM ({_white('m0')})",
        "packed_histogram": "SELECT slide_id, ch, v, n FROM hd",
        "rgb_to_lab": f"SELECT slide_id, x, y, {_r('l_ a_ b_')} FROM pl",
        "lab_to_rgb_roundtrip": f"SELECT slide_id, x, y, r2, g2, b2 FROM ({rgb('pl')})",
        "lab_stats_tile": f"SELECT slide_id, tx, ty, {_r(stat)} FROM tst",
        "lab_stats_slide": f"SELECT slide_id, {_r(stat)}, valid_count, total_count, fallback FROM sst JOIN (SELECT DISTINCT slide_id, valid_count, total_count, fallback FROM bu) USING (slide_id)",
        "lab_stats_batch_images": f"SELECT {_r(stat)} FROM (SELECT {_MEANS} FROM ist)",
        "lab_stats_batch_wsi": f"SELECT {_r(stat)} FROM tg4",
        "reinhard_tile_scope": f"SELECT {_P2} FROM r3",
        "reinhard_slide_scope": f"SELECT {_P2} FROM r3s",
        "rgb_to_od": f"SELECT slide_id, x, y, {_r('od_r od_g od_b')} FROM po",
        "od_to_rgb": f"SELECT slide_id, x, y, {', '.join(f'{back(f"od_{c} * {d(0.8)} + {d(0.013)}")} {c}2' for c in 'rgb')} FROM po",  # off the whole numbers, where the last bit of exp decides
        "od_tissue_pixels": f"SELECT slide_id, x, y, {_r('od_r od_g od_b')} FROM pt",
        "min_tissue_guard": "SELECT slide_id, tx, ty, CAST(count_if(dense) AS BIGINT) n_tissue, count_if(dense) < 100 use_default FROM (SELECT slide_id, tx, ty, sqrt(od_r * od_r + od_g * od_g + od_b * od_b) > 0.15::DOUBLE dense FROM po) GROUP BY ALL",
        "od_gram": f"SELECT slide_id, count(*) n, {', '.join(f'round(sum(od_{a} * od_{b}), 6) s_{a}{b}' for a, b in ('rr', 'rg', 'rb', 'gg', 'gb', 'bb'))} FROM pt GROUP BY slide_id",
        "macenko_angles": f"SELECT slide_id, round(quantile_cont(t, 0.15), 6) low, round(quantile_cont(t, 0.85), 6) high FROM (SELECT slide_id, atan2({_mix([p[1] for p in PLANE], ('od_r', 'od_g', 'od_b'))}, {_mix([p[0] for p in PLANE], ('od_r', 'od_g', 'od_b'))}) t FROM pt) GROUP BY slide_id",
        "macenko_max_conc": f"SELECT slide_id, round(quantile_cont(c0, 0.99), 6) max0, round(quantile_cont(c1, 0.99), 6) max1 FROM (SELECT *, {conc()} FROM pt) GROUP BY slide_id",
        "ols_concentrations": f"SELECT slide_id, x, y, {_r('c0 c1')} FROM pc",
        "macenko_apply": f"SELECT {_P2} FROM ma",
        "vahadane_apply": f"SELECT {_P2} FROM va",
        "edge_pad_white": "SELECT g.slide_id, g.tx, g.ty, CAST(g.tx * 13 + dx AS INT) x, CAST(g.ty * 13 + dy AS INT) y, coalesce(p.r, 255) r, coalesce(p.g, 255) g, coalesce(p.b, 255) b FROM (SELECT DISTINCT slide_id, CAST(x // 13 AS INT) tx, CAST(y // 13 AS INT) ty FROM px) g CROSS JOIN range(13) a(dx) CROSS JOIN range(13) c(dy) LEFT JOIN px p ON p.slide_id = g.slide_id AND p.x = g.tx * 13 + dx AND p.y = g.ty * 13 + dy",
        "gray16_to_8": f"SELECT event_id, v, CAST(floor(v::DOUBLE / {d(65535)} * {d(255)}) AS INT) v8 FROM (SELECT event_id, CAST(CAST(floor(abs(value) * 1000) AS BIGINT) % 65536 AS INT) v FROM events)",
        "mpp_resolution": f"SELECT event_id, CASE WHEN ok THEN 10000.0::DOUBLE / n ELSE 0.0::DOUBLE END resolution, CASE WHEN ok THEN 3 ELSE 1 END unit FROM (SELECT event_id, n, n IS NOT NULL AND n <> 0 ok FROM (SELECT event_id, try_cast(coalesce(mpp, '0.25') AS DOUBLE) n FROM (SELECT event_id, {_MPP} mpp FROM events)))",
        "mode_labels": "SELECT \"mode\", n, key, label, replace(replace(key, ' ', '_'), '–', '-') safe FROM (SELECT CAST(user_id % 6 + 1 AS INT) \"mode\", count(*) n FROM events GROUP BY 1) JOIN (VALUES " + ", ".join(f"({k}, '{v[0]}', '{v[1]}')" for k, v in MODES.items()) + ") t(\"mode\", key, label) USING (\"mode\")",
        "pyramid_levels": "SELECT slide_id, CAST(k AS INT) AS level, CAST(f AS INT) factor, CAST((width + f - 1) // f AS INT) w, CAST((height + f - 1) // f AS INT) h FROM (SELECT sl.*, k, CAST(pow(2, k) AS BIGINT) f FROM sl CROSS JOIN range(1, 21) t(k)) WHERE k = 1 OR (width // f > 10 AND height // f > 10)",
        "pyramid_reduce2": f"SELECT slide_id, CAST(x // 2 AS INT) x, CAST(y // 2 AS INT) y, {', '.join(f'CAST((2 * sum({c}) + count(*)) // (2 * count(*)) AS INT) {c}' for c in 'rgb')} FROM px GROUP BY slide_id, x // 2, y // 2",
        "wasserstein": _wasserstein("im"),
        "channel_qc": f"SELECT * FROM ({_qc('im')}) JOIN ({_wasserstein('im')}) USING (slide_id, ch)",
        "lab_qc": _labqc("(SELECT slide_id, r, g, b, r2, g2, b2 FROM ir)"),
        "run_log": _run_log_sql(),
        "run_summary": f"SELECT count(*) slides, CAST(count_if(error IS NULL) AS BIGINT) completed, CAST(count_if(error IS NOT NULL) AS BIGINT) errors, CAST(coalesce(sum(CASE WHEN error IS NULL THEN tiles_saved END), 0) AS BIGINT) tiles_saved, CAST(coalesce(sum(CASE WHEN error IS NULL THEN tiles_skipped END), 0) AS BIGINT) tiles_skipped FROM ({_log_sql()})",
        "error_rows": f"SELECT filename, error FROM ({_log_sql()}) WHERE error IS NOT NULL",
        "timing_report": "SELECT event_type label, count(*) calls, round(sum(value / 1000), 6) total_s, round(avg(value / 1000) * 1000, 6) mean_ms, round(max(value / 1000) * 1000, 6) max_ms FROM events GROUP BY 1",
        "mode1_end_to_end": f"SELECT {_P2} FROM ({_white('m1')}) WHERE slide_id > 0",
        "mode2_end_to_end": f"SELECT {_P2} FROM ({_white('m2')})",
        "mode3_end_to_end": f"SELECT {_P2} FROM ({_white('r3')}) WHERE slide_id > 0",
        "mode4_end_to_end": f"SELECT {_P2} FROM ({_white('r4')})",
        "mode5_end_to_end": f"SELECT {_P2} FROM ({_white('n5')}) WHERE slide_id > 0",
        "macenko_fit": "SELECT CAST(i AS INT) stain, " + ", ".join(f"round(CASE WHEN i = 0 THEN h_{c} ELSE e_{c} END, 6) {c}" for c in "rgb") + ", round(CASE WHEN i = 0 THEN max0 ELSE max1 END, 6) max_concentration FROM fit5 CROSS JOIN range(2) t(i) WHERE slide_id = 0",
        "macenko_fit_by_slide": f"SELECT slide_id, {_r(_STAIN.replace(',', ''))}, {_r('max0 max1')}, fallback FROM fit5",
        "packed_macenko_fit_by_slide": f"SELECT slide_id, {_r(_STAIN.replace(',', ''))}, {_r('max0 max1')}, fallback FROM fit5",
        "tiles_end_to_end": f"SELECT {_P2} FROM ({_white('m1')}) JOIN (SELECT slide_id, tx, ty FROM save WHERE NOT skipped) USING (slide_id, tx, ty)",
        "image_batch_histogram": f"SELECT * FROM ({_qc('bm')}) JOIN ({_wasserstein('bm').replace('256, 6)', '256, 12)')}) USING (slide_id, ch)",  # halves at the seventh digit do occur
        "image_batch_reinhard": _labqc("(SELECT slide_id, r, g, b, r2, g2, b2 FROM br)"),
        "output_preview": "SELECT 's' || slide_id stem, slide_id, CASE WHEN slide_id % 2 = 0 THEN '/out/s' || slide_id || '_norm.tiff' END output FROM sl",
    }
    return {k: query(v) for k, v in q.items()}
