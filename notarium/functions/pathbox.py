"""Bounding boxes of SVG path data, a batch of paths at a time.

The same boxes as ``svgpath.path_bbox_sql``.  Spark interprets that expression node by node for
each row; here the bytes of an Arrow batch are cut into commands and numbers together, the pens
of all paths move on side by side, step by step, and the extents of all segments of a kind are
worked out at once, in NumPy columns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORNERS = ("xmin", "xmax", "ymin", "ymax")
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in CORNERS])
# Bytes of path data that are worked on at once; a longer path is worked on alone.
CHUNK = 1 << 18
_LETTERS = b"MmZzLlHhVvCcSsQqTtAa"
_TOKEN = re.compile(rb"[MmZzLlHhVvCcSsQqTtAa]|[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?")
_M, _L, _C, _Z, _H, _V, _S, _Q, _T, _A = map(ord, "MLCZHVSQTA")
# By the code of the capital letter: how many numbers a command consumes at a time, which of them
# are the end point and the two controls (-1: none), and the degree of its curve.
_ARITY, _DEGREE = np.zeros(128, np.int64), np.zeros(128, np.int64)
_END, _FIRST, _SECOND = (np.full((2, 128), -1, np.int64) for _ in range(3))
for _code, _count, _degree, _end, _first, _second in (
        (_M, 2, 0, (0, 1), None, None), (_L, 2, 0, (0, 1), None, None), (_H, 1, 0, (0, -1), None, None), (_V, 1, 0, (-1, 0), None, None),
        (_C, 6, 3, (4, 5), (0, 1), (2, 3)), (_S, 4, 3, (2, 3), None, (0, 1)), (_Q, 4, 2, (2, 3), (0, 1), None), (_T, 2, 2, (0, 1), None, None),
        (_A, 7, 0, (5, 6), None, None)):
    _ARITY[_code], _DEGREE[_code], _END[:, _code] = _count, _degree, _end
    if _first:
        _FIRST[:, _code] = _first
    if _second:
        _SECOND[:, _code] = _second
_DIGIT, _DOT, _SIGN, _EXP, _LETTER = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
for _kind, _bytes in ((_DIGIT, b"0123456789"), (_DOT, b"."), (_SIGN, b"+-"), (_EXP, b"eE"), (_LETTER, _LETTERS)):
    _CLASS[list(_bytes)] = _kind
# Powers of ten that a double holds exactly, and digits that always fit into one.
_POWERS, _DIGITS = 10.0 ** np.arange(23), 15


def _before(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[False], flags[:-1]])


def _after(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([flags[1:], [False]])


def _tokens(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, code, value) of all letters and numbers in order; the code of a number is 0.

    Runs of bytes that make one plain number each are read here; paths with any other run, such as
    ``.5.5`` or a sign alone, go through the pattern.
    """
    joined = b"\n".join([*texts, b""])
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(joined, np.uint8)
    kind = _CLASS[data]
    digit, sign = kind == _DIGIT, kind == _SIGN
    power = (kind == _EXP) & _before(digit) & (_after(digit) | (_after(sign) & _after(_after(digit))))
    part = ((kind > 0) & (kind < _EXP)) | power
    start = part & (~_before(part) | (sign & ~_before(power)))
    at = np.flatnonzero(part)
    first = np.flatnonzero(start)
    token = np.cumsum(start[at]) - 1
    n = len(first)
    last = at[np.append(np.flatnonzero(start[at])[1:], len(at)) - 1] if n else first
    k, d = kind[at], data[at].astype(np.int64) - 48
    dots, powers = np.bincount(token[k == _DOT], minlength=n), np.bincount(token[k == _EXP], minlength=n)
    far = len(data) + 1
    dot_at, power_at = np.full(n, far), np.full(n, far)
    dot_at[token[k == _DOT]], power_at[token[k == _EXP]] = at[k == _DOT], at[k == _EXP]
    odd = ~digit[last] | (dots > 1) | (powers > 1) | ((dots > 0) & (powers > 0) & (dot_at > power_at))

    def whole(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digits as a number by token, and how many there are."""
        of = token[chosen]
        count = np.bincount(of, minlength=n)
        place = np.cumsum(count)[of] - np.arange(1, len(of) + 1)
        return np.bincount(of, d[chosen] * _POWERS[np.minimum(place, 22)], minlength=n), count

    is_digit = k == _DIGIT
    behind = at > power_at[token]
    mantissa, digits = whole(is_digit & ~behind)
    exponent, places = whole(is_digit & behind)
    minus = np.zeros(n, bool)
    has_power = powers > 0
    minus[has_power] = data[power_at[has_power].clip(max=len(data) - 2) + 1] == ord("-")
    net = np.where(minus, -exponent, exponent) - np.bincount(token[is_digit & ~behind & (at > dot_at[token])], minlength=n)
    exact = (digits <= _DIGITS) & (places <= 3) & (np.abs(net) <= 22)
    scale = _POWERS[np.where(exact, np.abs(net), 0).astype(np.int64)]
    value = np.where(net >= 0, mantissa * scale, mantissa / scale) * np.where(data[first] == ord("-"), -1.0, 1.0)
    for i in np.flatnonzero(~exact & ~odd).tolist():
        value[i] = float(joined[first[i]:last[i] + 1])

    letters = np.flatnonzero(kind == _LETTER)
    place = np.concatenate([first, letters])
    code = np.concatenate([np.zeros(n, np.int64), data[letters].astype(np.int64)])
    value = np.concatenate([value, np.zeros(len(letters))])
    path = np.searchsorted(begins, place, side="right") - 1
    if odd.any():
        strange = np.unique(path[:n][odd])
        plain = ~np.isin(path, strange)
        again = [(p, begins[p] + m.start(), m.group()) for p in strange.tolist() for m in _TOKEN.finditer(texts[p])]
        is_letter = [t[:1] in _LETTERS for _, _, t in again]
        path = np.concatenate([path[plain], np.array([a[0] for a in again], np.int64)])
        place = np.concatenate([place[plain], np.array([a[1] for a in again], np.int64)])
        code = np.concatenate([code[plain], np.array([t[0] if c else 0 for (_, _, t), c in zip(again, is_letter, strict=True)], np.int64)])
        value = np.concatenate([value[plain], np.array([0.0 if c else float(t) for (_, _, t), c in zip(again, is_letter, strict=True)])])
    order = np.argsort(place, kind="stable")
    return path[order], code[order], value[order]


def _steps(path: np.ndarray, code: np.ndarray, broken: np.ndarray) -> tuple[np.ndarray, ...]:
    """(path, kind, relative, first number) of each drawn piece, in order; marks paths that no reader could draw.

    A command with more numbers than it takes is several pieces; a piece with too few or too many
    breaks its path, as does a number before any command.
    """
    letters = np.flatnonzero(code > 0)
    begins = np.concatenate([[True], path[1:] != path[:-1]])
    broken[path[begins & (code == 0)]] = True
    owner = path[letters]
    edge = np.append(np.flatnonzero(begins)[1:], len(path))
    path_end = edge[np.cumsum(begins)[letters] - 1]
    count = np.minimum(np.append(letters[1:], len(path)), path_end) - letters - 1
    kind, relative = code[letters] & 223, code[letters] >= ord("a")
    takes = _ARITY[kind]
    split = (takes > 0) & (count > takes)
    pieces = np.where(split, -(-count // np.maximum(takes, 1)), 1)
    of = np.repeat(np.arange(len(letters)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    given = np.where(split[of], np.minimum(takes[of], count[of] - nth * takes[of]), count[of])
    broken[owner[of[given != takes[of]]]] = True
    return owner[of], np.where((kind[of] == _M) & (nth > 0), _L, kind[of]), relative[of], letters[of] + 1 + nth * takes[of]


class _Pens:
    """Begin, end and controls of every step, with the pens of all paths moved on side by side."""

    def __init__(self, path: np.ndarray, kind: np.ndarray, relative: np.ndarray, first: np.ndarray, value: np.ndarray, paths: int):
        steps = len(path)
        degree = _DEGREE[kind]

        def taken(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The numbers of a point, and which steps name them."""
            which = table[:, kind]
            return value[np.minimum(first + np.maximum(which, 0), len(value) - 1)], which >= 0

        (end, ends), (one, ones), (two, twos) = taken(_END), taken(_FIRST), taken(_SECOND)
        self.begin, self.end, self.one, self.two = (np.zeros((2, steps)) for _ in range(4))
        self.moves = np.ones(steps, bool)
        pen, opened, control = np.zeros((2, paths)), np.full((2, paths), np.nan), np.zeros((2, paths))
        bent = np.zeros(paths, np.int64)
        fresh = np.concatenate([[True], path[1:] != path[:-1]])
        turn = np.arange(steps) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        order = np.argsort(turn, kind="stable")
        edges = np.append(0, np.cumsum(np.bincount(turn)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            s = order[a:b]
            p, k, curve = path[s], kind[s], degree[s]
            at = pen[:, p]
            offset = np.where(relative[s], at, 0.0)
            to = np.where(ends[:, s], end[:, s] + offset, at)
            closes, opens = k == _Z, k == _M
            if closes.any():
                to = np.where(closes, opened[:, p], to)
            self.begin[:, s], self.end[:, s] = at, to
            still = closes & (to == at).all(axis=0)
            self.moves[s] = ~(still | opens)
            if curve.any():
                mirrored = np.where(bent[p] == curve, 2 * at - control[:, p], at)
                near = np.where(ones[:, s], one[:, s] + offset, mirrored)
                far = np.where(twos[:, s], two[:, s] + offset, near)
                self.one[:, s], self.two[:, s] = near, far
                control[:, p] = np.where(curve > 0, far, control[:, p])
            bent[p] = np.where(still, bent[p], curve)
            opened[:, p] = np.where(opens, to, opened[:, p])
            pen[:, p] = to


def _turns(degree: int, p0: np.ndarray, p1: np.ndarray, p2: np.ndarray, p3: np.ndarray) -> list[np.ndarray]:
    """Values of a coordinate where a curve turns inside its ends; NaN where it doesn't."""
    lo, hi = np.minimum(p0, p3), np.maximum(p0, p3)
    # Controls between the two ends cannot push the curve outside them.
    bent = ~((p1 >= lo) & (p1 <= hi) & (p2 >= lo) & (p2 <= hi))

    def at(t: np.ndarray) -> np.ndarray:
        u = 1 - t
        if degree == 2:
            value = u * u * p0 + 2 * u * t * p1 + t * t * p3
        else:
            value = u * u * u * p0 + 3 * u * u * t * p1 + 3 * u * t * t * p2 + t * t * t * p3
        return np.where(bent & (t > 0) & (t < 1), value, np.nan)

    if degree == 2:
        return [at((p0 - p1) / (p0 - 2 * p1 + p3))]
    a, b, c = p3 - 3 * p2 + 3 * p1 - p0, 2 * (p0 - 2 * p1 + p2), p1 - p0
    root = np.sqrt(b * b - 4 * a * c)
    q = -(b + np.where(b < 0, -root, root)) / 2
    return [at(q / a), at(c / q)]


def _arc_turns(x1, y1, rx, ry, phi, large, sweep, x2, y2) -> list[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of the four outermost points of each ellipse; NaN where the arc doesn't reach them."""
    rx, ry = np.abs(rx), np.abs(ry)
    cp, sp = np.cos(np.radians(phi)), np.sin(np.radians(phi))
    hx, hy = (x1 - x2) / 2, (y1 - y2) / 2
    # Half the chord in the axes of the ellipse.
    u, w = cp * hx + sp * hy, cp * hy - sp * hx
    # Radii too small to reach both ends grow to the smallest ellipse that does.
    grow = np.sqrt(np.maximum(1.0, (u / rx) ** 2 + (w / ry) ** 2))
    rx, ry = rx * grow, ry * grow
    reach = (u / rx) ** 2 + (w / ry) ** 2
    k = np.where((large != 0) == (sweep != 0), -1.0, 1.0) * np.sqrt(np.maximum(0.0, 1 / reach - 1))
    cu, cw = k * rx * w / ry, -k * ry * u / rx
    begin = np.arctan2((w - cw) / ry, (u - cu) / rx)
    end = np.arctan2((-w - cw) / ry, (-u - cu) / rx)
    way = np.where(sweep != 0, 1.0, -1.0)
    turn = 2 * np.pi
    span = np.mod((end - begin) * way, turn)
    middle = cp * cu - sp * cw + (x1 + x2) / 2, sp * cu + cp * cw + (y1 + y2) / 2
    half = np.sqrt((rx * cp) ** 2 + (ry * sp) ** 2), np.sqrt((rx * sp) ** 2 + (ry * cp) ** 2)
    angle = np.arctan2(-ry * sp, rx * cp), np.arctan2(ry * cp, rx * sp)

    def reached(at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.where(np.mod((at - begin) * way, turn) <= span, value, np.nan)

    near = [reached(angle[i], middle[i] + half[i]) for i in (0, 1)]
    far = [reached(angle[i] + np.pi, middle[i] - half[i]) for i in (0, 1)]
    return [(near[0], near[1]), (far[0], far[1])]


def path_boxes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Boxes as rows xmin, xmax, ymin, ymax, and which of the texts have one.

    Curves count by their true extrema.  Data that no reader could draw (wrong argument counts,
    numbers without a command, an arc of radius zero) has no box, nor has data that draws nothing.
    """
    data = [t.encode() if t else b"" for t in texts]
    ends = np.cumsum([len(t) for t in data])
    parts, begin = [], 0
    while begin < len(data):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, side="right")))
        parts.append(_boxes(data[begin:end]))
        begin = end
    if not parts:
        return np.empty((4, 0)), np.zeros(0, bool)
    return np.concatenate([b for b, _ in parts], axis=1), np.concatenate([d for _, d in parts])


def _boxes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    boxes, broken, drawn = np.full((4, len(texts)), np.nan), np.zeros(len(texts), bool), np.zeros(len(texts), bool)
    path, code, value = _tokens(texts)
    if not (code > 0).any():
        return boxes, drawn
    path, kind, relative, first = _steps(path, code, broken)
    with np.errstate(all="ignore"):
        pens = _Pens(path, kind, relative, first, value, len(texts))
        shut = np.cumsum(kind == _M)
        fresh = np.concatenate([[True], path[1:] != path[:-1]])
        opened = shut - (shut - (kind == _M))[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        broken[path[(kind == _Z) & (opened == 0)]] = True
        (x0, y0), (x3, y3), (x1, y1), (x2, y2) = pens.begin, pens.end, pens.one, pens.two
        moves = pens.moves
        points = [(path[moves], x0[moves], y0[moves]), (path[moves], x3[moves], y3[moves])]
        for degree in (2, 3):
            c = np.flatnonzero(_DEGREE[kind] == degree)
            if len(c):
                turns = zip(_turns(degree, x0[c], x1[c], x2[c], x3[c]), _turns(degree, y0[c], y1[c], y2[c], y3[c]), strict=True)
                points += [(path[c], x, y) for x, y in turns]
        c = np.flatnonzero((kind == _A) & ~broken[path])
        if len(c):
            rx, ry, phi, large, sweep = (value[first[c] + i] for i in range(5))
            broken[path[c[(rx == 0) | (ry == 0) | ((x0[c] == x3[c]) & (y0[c] == y3[c]))]]] = True
            points += [(path[c], x, y) for x, y in _arc_turns(x0[c], y0[c], rx, ry, phi, large, sweep, x3[c], y3[c])]
        of = np.concatenate([p[0] for p in points])
        for low, values in ((0, np.concatenate([p[1] for p in points])), (2, np.concatenate([p[2] for p in points]))):
            np.fmin.at(boxes[low], of, values)
            np.fmax.at(boxes[low + 1], of, values)
    drawn[path[moves]] = True
    return boxes, drawn & ~broken


def box_array(boxes: np.ndarray, there: np.ndarray, missing: np.ndarray | None = None) -> pa.StructArray:
    """Rows of corners as a column of structs, NULL where there is no box; ``missing`` marks corners that aren't known."""
    columns = [pa.array(b, mask=None if missing is None else missing[i]) for i, b in enumerate(boxes)]
    return pa.StructArray.from_arrays(columns, list(CORNERS), mask=pa.array(~there))


def _box_column(d: pa.Array) -> pa.Array:
    return box_array(*path_boxes(d.to_pylist()))


def path_bbox(d: str) -> Column:
    """``struct<xmin, xmax, ymin, ymax>`` of path data, NULL where it has no box.

    ``d`` is SQL: a column name, or any string expression.
    """
    return F.arrow_udf(_box_column, BOX)(F.expr(d))
