"""The published analytical propagator for near-Earth orbits (Hoots and Roehrich 1980, as revised by Vallado et al. 2006), over arrays.

Elements are mean elements of element sets: revolutions a day, degrees, drag term. Everything works on whole
arrays at once; elements may be columns against a row of times, and what does not change with time is worked out once
an orbit. An orbit that takes 225 minutes or more needs the deep-space terms, which are not here: such
rows, and those whose orbit decays or is no closed one, come out as NaN.
"""

from __future__ import annotations

import numpy as np

# fixed values: WGS-72 gravitation (km3/s2), radius (km) and zonal harmonics
MU, RADIUS, J2, J3, J4 = 398_600.8, 6_378.135, 0.001082616, -0.00000253881, -0.00000165597
#: Square root of MU in Earth radii and minutes.
KE = 60 / np.sqrt(RADIUS**3 / MU)
DEEP_MINUTES = 225.0
TURN = 2 * np.pi


def unperturbed(motion: np.ndarray, e: np.ndarray, cos_i: np.ndarray) -> np.ndarray:
    """Mean motion (radians a minute) without the part that the oblateness gives to the stated one."""
    a = (KE / motion) ** (2 / 3)
    d = 0.75 * J2 * (3 * cos_i**2 - 1) / (1 - e * e) ** 1.5
    first = d / (a * a)
    a = a * (1 - first**2 - first * (1 / 3 + 134 * first**2 / 81))
    return motion / (1 + d / (a * a))


def positions(mean_motion, eccentricity, inclination, node, perigee, anomaly, bstar, minutes) -> np.ndarray:
    """(6, n): x, y, z in km and their rates in km/s, true equator and mean equinox, `minutes` after the epoch."""
    motion, e, incl, node, perigee, anomaly, bstar, t = (np.asarray(x, float) for x in (mean_motion, eccentricity, inclination, node, perigee, anomaly, bstar, minutes))
    with np.errstate(all="ignore"):
        fits = (motion > 0) & (e >= 0) & (e < 1) & np.isfinite(incl + node + perigee + anomaly + bstar + t)
        out, ok = _near(np.where(fits, motion, 15.0) * TURN / 1440, np.where(fits, e, 0.001), *(np.radians(np.where(fits, x, 0.0)) for x in (incl, node, perigee, anomaly)), np.where(fits, bstar, 0.0), np.where(fits, t, 0.0))
    return np.where(fits & ok, out, np.nan)


def _near(stated, e, incl, node, perigee, anomaly, bstar, t):
    ci, si = np.cos(incl), np.sin(incl)
    c2 = ci * ci
    n = unperturbed(stated, e, ci)
    a = (KE / n) ** (2 / 3)
    b2 = 1 - e * e
    b = np.sqrt(b2)
    x3, x1, x7, x5 = 3 * c2 - 1, 1 - c2, 7 * c2 - 1, 1 - 5 * c2
    rp = a * (1 - e)
    # the atmosphere's density falls off from a height that follows low perigees down
    low = (rp - 1) * RADIUS
    base = np.where(low < 98, 20.0, np.where(low < 156, low - 78, 78.0))
    s, q4 = base / RADIUS + 1, ((120 - base) / RADIUS) ** 4
    xi = 1 / (a - s)
    eta = a * e * xi
    eta2, e_eta = eta * eta, e * eta
    psi = np.abs(1 - eta2)
    k = q4 * xi**4
    k1 = k / psi**3.5
    drag2 = k1 * n * (a * (1 + 1.5 * eta2 + e_eta * (4 + eta2)) + 0.375 * J2 * xi / psi * x3 * (8 + 3 * eta2 * (8 + eta2)))
    drag1 = bstar * drag2
    round_ = e <= 1e-4
    drag3 = np.where(round_, 0.0, -2 * k * xi * (J3 / J2) * n * si / np.where(round_, 1.0, e))
    drag4 = 2 * n * k1 * a * b2 * (
        eta * (2 + 0.5 * eta2) + e * (0.5 + 2 * eta2)
        - J2 * xi / (a * psi) * (-3 * x3 * (1 - 2 * e_eta + eta2 * (1.5 - 0.5 * e_eta)) + 0.75 * x1 * (2 * eta2 - e_eta * (1 + eta2)) * np.cos(2 * perigee)))
    drag5 = 2 * k1 * a * b2 * (1 + 2.75 * (eta2 + e_eta) + e_eta * eta2)
    # secular rates by the zonal harmonics
    p2 = 1 / (a * b2) ** 2
    r1 = 1.5 * J2 * p2 * n
    r2 = 0.5 * r1 * J2 * p2
    r3 = -0.46875 * J4 * p2 * p2 * n
    c4 = c2 * c2
    m_rate = n + 0.5 * r1 * b * x3 + 0.0625 * r2 * b * (13 - 78 * c2 + 137 * c4)
    w_rate = -0.5 * r1 * x5 + 0.0625 * r2 * (7 - 114 * c2 + 395 * c4) + r3 * (3 - 36 * c2 + 49 * c4)
    turn = -r1 * ci
    o_rate = turn + (0.5 * r2 * (4 - 19 * c2) + 2 * r3 * (3 - 7 * c2)) * ci
    # at t: secular effects, then those of drag
    m, w, o = anomaly + m_rate * t, perigee + w_rate * t, node + o_rate * t
    o = o + 3.5 * b2 * turn * drag1 * t * t
    shrink, lose, gain = 1 - drag1 * t, bstar * drag4 * t, 1.5 * drag1 * t * t
    full = rp >= 220 / RADIUS + 1
    swing = lambda x: (1 + eta * np.cos(x)) ** 3
    shift = bstar * drag3 * np.cos(perigee) * t + np.where(round_, 0.0, -2 / 3 * k * bstar / np.where(round_, 1.0, e_eta)) * (swing(m) - swing(anomaly))
    d2 = 4 * a * xi * drag1**2
    step = d2 * xi * drag1 / 3
    d3 = (17 * a + s) * step
    d4 = 0.5 * step * a * xi * (221 * a + 31 * s) * drag1
    late = m + shift
    shrink = np.where(full, shrink - d2 * t**2 - d3 * t**3 - d4 * t**4, shrink)
    lose = np.where(full, lose + bstar * drag5 * (np.sin(late) - np.sin(anomaly)), lose)
    t3, t4 = d2 + 2 * drag1**2, 0.25 * (3 * d3 + drag1 * (12 * d2 + 10 * drag1**2))
    t5 = 0.2 * (3 * d4 + 12 * drag1 * d3 + 6 * d2**2 + 15 * drag1**2 * (2 * d2 + drag1**2))
    gain = np.where(full, gain + t3 * t**3 + t4 * t**4 + t5 * t**5, gain)
    m, w = np.where(full, late, m), np.where(full, w - shift, w)
    a = a * shrink**2
    motion = KE / a**1.5
    e_now = e - lose
    ok = (e_now < 1) & (e_now >= -0.001) & (a > 0) & (TURN / n < DEEP_MINUTES)
    e_now = np.maximum(e_now, 1e-6)
    m = m + n * gain
    # long periods
    axn = e_now * np.cos(w)
    over = 1 / (a * (1 - e_now**2))
    ayn = e_now * np.sin(w) - over * 0.5 * (J3 / J2) * si
    tilt = np.where(np.abs(1 + ci) > 1.5e-12, 1 + ci, 1.5e-12)
    long = m + w + o - over * 0.25 * (J3 / J2) * si * (3 + 5 * ci) / tilt * axn
    u = np.mod(long - o, TURN)
    f = u.copy()
    for _ in range(10):
        cf, sf = np.cos(f), np.sin(f)
        f = f + np.clip((u - ayn * cf + axn * sf - f) / (1 - cf * axn - sf * ayn), -0.95, 0.95)
    cf, sf = np.cos(f), np.sin(f)
    e_cos, e_sin = axn * cf + ayn * sf, axn * sf - ayn * cf
    left = 1 - axn**2 - ayn**2
    p = a * left
    r = a * (1 - e_cos)
    r_rate, rf_rate = np.sqrt(a) * e_sin / r, np.sqrt(p) / r
    part = e_sin / (1 + np.sqrt(left))
    sin_u, cos_u = a / r * (sf - ayn - axn * part), a / r * (cf - axn + ayn * part)
    u = np.arctan2(sin_u, cos_u)
    sin_2u, cos_2u = 2 * sin_u * cos_u, 1 - 2 * sin_u**2
    # short periods
    g1 = 0.5 * J2 / p
    g2 = g1 / p
    far = r * (1 - 1.5 * g2 * np.sqrt(left) * x3) + 0.5 * g1 * x1 * cos_2u
    u = u - 0.25 * g2 * x7 * sin_2u
    o = o + 1.5 * g2 * ci * sin_2u
    i = incl + 1.5 * g2 * ci * si * cos_2u
    away = r_rate - motion * g1 * x1 * sin_2u / KE
    along = rf_rate + motion * g1 * (x1 * cos_2u + 1.5 * x3) / KE
    su, cu, so, co = np.sin(u), np.cos(u), np.sin(o), np.cos(o)
    c_now, s_now = np.cos(i), np.sin(i)
    up = np.array([co * cu - so * c_now * su, so * cu + co * c_now * su, s_now * su])
    on = np.array([-so * c_now * cu - co * su, co * c_now * cu - so * su, s_now * cu])
    ok = ok & (p > 0) & (far >= 1)
    return np.concatenate([far * up * RADIUS, (away * up + along * on) * RADIUS * KE / 60]), ok


#: Orders of the arrays that describe orbits: elements by name, and their epoch in microseconds.
ELEMENTS = ("mean_motion", "eccentricity", "inclination", "node", "perigee", "anomaly", "bstar")
# fixed values: WGS-84 (km)
AXIS, FLAT2 = 6_378.137, 6.69437999014e-3


def elevations(elements: list[np.ndarray], epoch_us: np.ndarray, at_us: np.ndarray, lat: float, lon: float, alt_m: float) -> np.ndarray:
    """Degrees above an observer's horizon; NaN without a position. Arrays are broadcast together."""
    xyz = positions(*elements, (at_us - epoch_us) / 60e6)[:3]
    century = (at_us / 86_400e6 + 2_440_587.5 - 2_451_545.0) / 36_525
    turn = np.radians(np.mod((67_310.54841 + century * (876_600 * 3600.0 + 8_640_184.812866) + century**2 * 0.093104 - century**3 * 6.2e-6) / 240, 360))
    x, y = np.cos(turn) * xyz[0] + np.sin(turn) * xyz[1], np.cos(turn) * xyz[1] - np.sin(turn) * xyz[0]
    lat, lon, up = np.radians(lat), np.radians(lon), alt_m / 1000
    n = AXIS / np.sqrt(1 - FLAT2 * np.sin(lat) ** 2)
    zenith = np.array([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
    here = np.array([(n + up) * zenith[0], (n + up) * zenith[1], (n * (1 - FLAT2) + up) * zenith[2]])
    away = [a - b for a, b in zip((x, y, xyz[2]), here, strict=True)]
    return np.degrees(np.arcsin(np.clip(sum(a * b for a, b in zip(away, zenith, strict=True)) / np.sqrt(sum(a * a for a in away)), -1, 1)))


def next_passes(elements: list[np.ndarray], epoch_us: np.ndarray, start_us: int, window_s: float, step_s: float, floor: float, lat: float, lon: float, alt_m: float) -> tuple[np.ndarray, ...]:
    """(rise_us, culmination_us, set_us, peak in degrees) of each orbit's pass in work at the start or else next; NaN where there is none.

    The elevation is sampled every step_s. The first sample above the floor and above both neighbours brackets the peak, which is
    narrowed by thirds; the crossings beside it are halved. A pass that has begun has no rise, one that outlasts the window no set.
    An orbit that falls from the floor's height all the time from the start culminates there."""
    grid = start_us + np.append(np.arange(0, window_s, step_s), window_s) * 1e6
    count, nan = len(epoch_us), np.full(len(epoch_us), np.nan)
    rise, top, fall, peak = nan.copy(), nan.copy(), nan.copy(), nan.copy()
    column = [x[:, None] for x in elements]
    look = np.array([elevations([x[k : k + 16] for x in column], epoch_us[k : k + 16, None], grid[None], lat, lon, alt_m) for k in range(0, count, 16)], dtype=object)
    up = np.concatenate(list(look)).astype(float) if count else np.zeros((0, len(grid)))
    whole = np.isfinite(up).all(axis=1)
    inner = (up[:, 1:-1] > up[:, :-2]) & (up[:, 1:-1] > up[:, 2:]) & (up[:, 1:-1] > floor)
    at = np.where(inner.any(axis=1), inner.argmax(axis=1) + 1, 0)
    seen = whole & ((at > 0) | (up[:, 0] > floor))
    rows = np.flatnonzero(seen)

    def height(rows: np.ndarray, t: np.ndarray) -> np.ndarray:
        return elevations([x[rows] for x in elements], epoch_us[rows], t, lat, lon, alt_m)

    top[rows], peak[rows] = grid[0], up[rows, 0]
    peaked = rows[at[rows] > 0]
    low, high = grid[at[peaked] - 1], grid[at[peaked] + 1]
    for _ in range(24):  # a bracket of two steps shrinks to milliseconds
        third = (high - low) / 3
        right = height(peaked, low + third) < height(peaked, high - third)
        low, high = np.where(right, low + third, low), np.where(right, high, high - third)
    top[peaked] = (low + high) / 2
    peak[peaked] = height(peaked, top[peaked])

    def crossing(rows: np.ndarray, before: np.ndarray, rising: bool) -> np.ndarray:
        low, high = grid[before], grid[before + 1]
        for _ in range(30):
            middle = (low + high) / 2
            over = (height(rows, middle) > floor) == rising
            low, high = np.where(over, low, middle), np.where(over, middle, high)
        return (low + high) / 2

    over = up > floor
    rises, falls = ~over[:, :-1] & over[:, 1:], over[:, :-1] & ~over[:, 1:]
    steps = np.arange(len(grid) - 1)
    last = np.where(rises & (steps < at[:, None]), steps, -1).max(axis=1, initial=-1)
    first = np.where(falls & (steps >= at[:, None]), steps, len(grid)).min(axis=1, initial=len(grid))
    some = np.flatnonzero(seen & (last >= 0))
    rise[some] = crossing(some, last[some], True)
    some = np.flatnonzero(seen & (first < len(grid)))
    fall[some] = crossing(some, first[some], False)
    return rise, top, fall, peak
