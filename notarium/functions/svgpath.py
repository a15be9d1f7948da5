"""Exact bounding box of SVG path data as one row-local expression (no shuffle, no Python).

The text is cut into commands, every command into its argument groups, and one
``aggregate`` walks the resulting steps with the pen position in its accumulator.
Curves count by their true extrema, not by their control points.  Data that no
reader could draw (wrong argument counts, numbers without a command, an arc of
radius zero) gives NULL, as does data that draws nothing.

The expression is put together as SQL text: it has some thousand nodes, and one
``expr`` call builds it in milliseconds where column objects take seconds.
"""

from __future__ import annotations

from functools import cache
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "MmZzLlHhVvCcSsQqTtAa"
_NUMBER = r"[-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
# Numbers each command consumes at a time.
_ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7}
_NONE = "CAST(NULL AS DOUBLE)"
_names = count()


def _let(body, **values: str) -> str:
    """``body`` over named values, each evaluated once.

    ``body`` receives a function that turns a name into a reference.
    """
    row = f"v{next(_names)}"
    fields = ", ".join(f"'{name}', {value}" for name, value in values.items())
    return f"element_at(transform(array(named_struct({fields})), {row} -> {body(lambda n: f'{row}.{n}')}), 1)"


def _struct(**values: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def _case(*branches: tuple[str, str], default: str | None = None) -> str:
    tail = f" ELSE {default}" if default else ""
    return "CASE" + "".join(f" WHEN {test} THEN {value}" for test, value in branches) + tail + " END"


# ---------------------------------------------------------------- text to steps


def _steps(d: str) -> str:
    """``array<struct<kind, rel, args, n>>``, one entry per drawn piece, in order.

    ``kind`` is the code of the command's capital letter (``upper`` would go over its whole text),
    ``n`` the number of arguments the kind takes; a step with another number is broken.
    """
    sizes = ", ".join(str(_ARITY.get(chr(c), 0)) for c in range(ord("A"), ord("Z") + 1))

    kind = "(ascii(cmd) & 223)"
    numbers = f"CAST(regexp_extract_all(substring(cmd, 2), '{_NUMBER}', 0) AS ARRAY<DOUBLE>)"
    command = f"named_struct('kind', {kind}, 'rel', ascii(cmd) >= 97, 'args', {numbers}, 'n', get(array({sizes}), {kind} - 65))"
    commands = f"transform(regexp_extract_all({d}, '[{_LETTERS}][^{_LETTERS}]*', 0), cmd -> {command})"
    # Most commands carry one group and are steps as they stand; only repeated groups are split.
    pieces = (
        "transform(sequence(1, size(w.args), w.n), i -> named_struct("
        f"'kind', IF(w.kind = {ord('M')} AND i > 1, {ord('L')}, w.kind), 'rel', w.rel, 'args', slice(w.args, i, w.n), 'n', w.n))"
    )
    split = f"flatten(transform(cs, w -> IF(w.n > 0 AND size(w.args) > w.n, {pieces}, array(w))))"
    steps = f"IF(exists(cs, c -> c.n > 0 AND size(c.args) > c.n), {split}, cs)"
    return f"element_at(transform(array({commands}), cs -> {steps}), 1)"


# ---------------------------------------------------------------- extents along one axis


def _span(points: str) -> str:
    return _let(lambda v: _struct(lo=f"array_min({v('p')})", hi=f"array_max({v('p')})"), p=points)


def _inside(t: str) -> str:
    return f"{t} > 0 AND {t} < 1"


def _quadratic(p0: str, p1: str, p2: str) -> str:
    def at(v):
        t, u = v("t"), f"(1 - {v('t')})"
        value = f"{u} * {u} * {p0} + 2 * {u} * {t} * {p1} + {t} * {t} * {p2}"
        return _span(f"array({p0}, {p2}, CASE WHEN {_inside(t)} THEN {value} END)")

    return _let(at, t=f"CASE WHEN {p0} - 2 * {p1} + {p2} <> 0 THEN ({p0} - {p1}) / ({p0} - 2 * {p1} + {p2}) END")


def _cubic(p0: str, p1: str, p2: str, p3: str) -> str:
    # The derivative is 3(a t^2 + b t + c); its roots inside (0, 1) are the extrema.  With
    # q = -(b + sign(b) sqrt(disc)) / 2 they are q / a and c / q: nothing cancels, and the
    # second holds where a vanishes, exactly or up to rounding.
    def points(v):
        a, c, q = v("a"), v("c"), v("q")
        roots = f"array(CASE WHEN {a} <> 0 THEN {q} / {a} END, CASE WHEN {q} <> 0 THEN {c} / {q} END)"
        t = f"t{next(_names)}"
        u = f"(1 - {t})"
        value = f"{u} * {u} * {u} * {p0} + 3 * {u} * {u} * {t} * {p1} + 3 * {u} * {t} * {t} * {p2} + {t} * {t} * {t} * {p3}"
        return _span(f"concat(array({p0}, {p3}), transform({roots}, {t} -> CASE WHEN {_inside(t)} THEN {value} END))")

    def with_q(v):
        a, b, c, disc = v("a"), v("b"), v("c"), v("disc")
        half = f"CASE WHEN {disc} >= 0 THEN -({b} + CASE WHEN {b} < 0 THEN -sqrt({disc}) ELSE sqrt({disc}) END) / 2 END"
        return _let(points, a=a, c=c, q=half)

    def with_disc(v):
        a, b, c = v("a"), v("b"), v("c")
        return _let(with_q, a=a, b=b, c=c, disc=f"{b} * {b} - 4 * {a} * {c}")

    return _let(with_disc, a=f"{p3} - 3 * {p2} + 3 * {p1} - {p0}", b=f"2 * ({p0} - 2 * {p1} + {p2})", c=f"{p1} - {p0}")


def _arc(x1: str, y1: str, args: str, x2: str, y2: str) -> str:
    """Box of an elliptical arc given by its end points; NULL for a degenerate arc."""

    def arg(i: int) -> str:
        return f"get({args}, {i})"

    def keep(v, *names: str) -> dict[str, str]:
        return {n: v(n) for n in names}

    def turned(v):
        # Half the chord in the axes of the ellipse.
        return _let(scaled, **keep(v, "rx", "ry", "cp", "sp", "large", "sweep"),
                    u=f"{v('cp')} * {v('hx')} + {v('sp')} * {v('hy')}",
                    w=f"{v('cp')} * {v('hy')} - {v('sp')} * {v('hx')}")

    def scaled(v):
        # Radii too small to reach both ends grow to the smallest ellipse that does.
        reach = f"power({v('u')} / {v('rx')}, 2) + power({v('w')} / {v('ry')}, 2)"
        return _let(lambda g: _let(
            centred, rx=f"{v('rx')} * {g('grow')}", ry=f"{v('ry')} * {g('grow')}",
            **keep(v, "cp", "sp", "large", "sweep", "u", "w")), grow=f"sqrt(greatest(1D, {reach}))")

    def centred(v):
        reach = f"(power({v('u')} / {v('rx')}, 2) + power({v('w')} / {v('ry')}, 2))"
        offset = f"IF({v('large')} = {v('sweep')}, -1D, 1D) * sqrt(greatest(0D, 1 / {reach} - 1))"
        return _let(lambda o: _let(
            angles, **keep(v, "rx", "ry", "cp", "sp", "sweep", "u", "w"),
            cu=f"{o('k')} * {v('rx')} * {v('w')} / {v('ry')}",
            cw=f"-{o('k')} * {v('ry')} * {v('u')} / {v('rx')}"), k=offset)

    def angles(v):
        begin = f"atan2(({v('w')} - {v('cw')}) / {v('ry')}, ({v('u')} - {v('cu')}) / {v('rx')})"
        end = f"atan2((-{v('w')} - {v('cw')}) / {v('ry')}, (-{v('u')} - {v('cu')}) / {v('rx')})"
        way = f"IF({v('sweep')}, 1D, -1D)"
        return _let(
            box, begin=begin, way=way, span=f"pmod(({end} - {begin}) * {way}, 2 * pi())",
            cx=f"{v('cp')} * {v('cu')} - {v('sp')} * {v('cw')} + ({x1} + {x2}) / 2",
            cy=f"{v('sp')} * {v('cu')} + {v('cp')} * {v('cw')} + ({y1} + {y2}) / 2",
            wx=f"sqrt(power({v('rx')} * {v('cp')}, 2) + power({v('ry')} * {v('sp')}, 2))",
            wy=f"sqrt(power({v('rx')} * {v('sp')}, 2) + power({v('ry')} * {v('cp')}, 2))",
            tx=f"atan2(-{v('ry')} * {v('sp')}, {v('rx')} * {v('cp')})",
            ty=f"atan2({v('ry')} * {v('cp')}, {v('rx')} * {v('sp')})",
        )

    def box(v):
        def reached(angle: str, value: str) -> str:
            return f"CASE WHEN pmod(({angle} - {v('begin')}) * {v('way')}, 2 * pi()) <= {v('span')} THEN {value} END"

        def axis(a: str, b: str, centre: str, half: str, angle: str) -> str:
            near = reached(v(angle), f"{v(centre)} + {v(half)}")
            far = reached(f"{v(angle)} + pi()", f"{v(centre)} - {v(half)}")
            return _span(f"array({a}, {b}, {near}, {far})")

        return _struct(h=axis(x1, x2, "cx", "wx", "tx"), v=axis(y1, y2, "cy", "wy", "ty"))

    whole = _let(
        turned, rx=f"abs({arg(0)})", ry=f"abs({arg(1)})", cp=f"cos(radians({arg(2)}))", sp=f"sin(radians({arg(2)}))",
        large=f"{arg(3)} <> 0", sweep=f"{arg(4)} <> 0", hx=f"({x1} - {x2}) / 2", hy=f"({y1} - {y2}) / 2")
    return f"CASE WHEN {arg(0)} <> 0 AND {arg(1)} <> 0 AND ({x1} <> {x2} OR {y1} <> {y2}) THEN {whole} END"


# ---------------------------------------------------------------- the walk


def _state(x, y, sx, sy, cx, cy, curve, x0, x1, y0, y1) -> str:
    """Pen, start of the sub-path, last control with its curve degree, box so far."""
    return _struct(x=x, y=y, sx=sx, sy=sy, cx=cx, cy=cy, curve=str(curve), x0=x0, x1=x1, y0=y0, y1=y1, ok="true")


_FAILED = _struct(**{n: f"a.{n}" for n in ("x", "y", "sx", "sy", "cx", "cy", "curve", "x0", "x1", "y0", "y1")}, ok="false")


def _line(ex: str, ey: str) -> str:
    return _state(
        ex, ey, "a.sx", "a.sy", _NONE, _NONE, 0, f"least(a.x0, a.x, {ex})", f"greatest(a.x1, a.x, {ex})",
        f"least(a.y0, a.y, {ey})", f"greatest(a.y1, a.y, {ey})")


def _curve(degree: int, ax: str, ay: str, bx: str, by: str, ex: str, ey: str) -> str:
    def axis(v, start: str, c1: str, c2: str, end: str) -> str:
        # Controls between the two ends cannot push the curve outside them.
        lo, hi = f"least({start}, {v(end)})", f"greatest({start}, {v(end)})"
        bent = _cubic(start, v(c1), v(c2), v(end)) if degree == 3 else _quadratic(start, v(c1), v(end))
        return (f"IF({v(c1)} BETWEEN {lo} AND {hi} AND {v(c2)} BETWEEN {lo} AND {hi}, {_struct(lo=lo, hi=hi)}, {bent})")

    def grown(v):
        return _let(
            lambda b: _state(
                v("ex"), v("ey"), "a.sx", "a.sy", v("bx"), v("by"), degree,
                f"least(a.x0, {b('h')}.lo)", f"greatest(a.x1, {b('h')}.hi)",
                f"least(a.y0, {b('v')}.lo)", f"greatest(a.y1, {b('v')}.hi)"),
            h=axis(v, "a.x", "ax", "bx", "ex"), v=axis(v, "a.y", "ay", "by", "ey"))

    return _let(grown, ax=ax, ay=ay, bx=bx, by=by, ex=ex, ey=ey)


def _advance() -> str:
    """Accumulator ``a`` after step ``s``; only the branch of its command is evaluated."""

    def x(i: int) -> str:
        return f"(get(s.args, {i}) + IF(s.rel, a.x, 0D))"

    def y(i: int) -> str:
        return f"(get(s.args, {i}) + IF(s.rel, a.y, 0D))"

    def mirrored(degree: int, axis: str) -> str:
        return f"IF(a.curve = {degree}, 2 * a.{axis} - a.c{axis}, a.{axis})"

    arc = _let(
        lambda b: f"IF({b('box')} IS NULL, {_FAILED}, " + _state(
            x(5), y(6), "a.sx", "a.sy", _NONE, _NONE, 0,
            f"least(a.x0, {b('box')}.h.lo)", f"greatest(a.x1, {b('box')}.h.hi)",
            f"least(a.y0, {b('box')}.v.lo)", f"greatest(a.y1, {b('box')}.v.hi)") + ")",
        box=_arc("a.x", "a.y", "s.args", x(5), y(6)))
    opened = _state(x(0), y(1), x(0), y(1), _NONE, _NONE, 0, "a.x0", "a.x1", "a.y0", "a.y1")
    closed = _case(("a.sx IS NULL", _FAILED), ("a.sx <> a.x OR a.sy <> a.y", _line("a.sx", "a.sy")), default="a")
    mx, my = mirrored(2, "x"), mirrored(2, "y")
    return _case(
        ("NOT a.ok OR size(s.args) <> s.n", _FAILED),
        (f"s.kind = {ord('L')}", _line(x(0), y(1))),
        (f"s.kind = {ord('C')}", _curve(3, x(0), y(1), x(2), y(3), x(4), y(5))),
        (f"s.kind = {ord('M')}", opened),
        (f"s.kind = {ord('Z')}", closed),
        (f"s.kind = {ord('H')}", _line(x(0), "a.y")),
        (f"s.kind = {ord('V')}", _line("a.x", y(0))),
        (f"s.kind = {ord('S')}", _curve(3, mirrored(3, "x"), mirrored(3, "y"), x(0), y(1), x(2), y(3))),
        (f"s.kind = {ord('Q')}", _curve(2, x(0), y(1), x(0), y(1), x(2), y(3))),
        (f"s.kind = {ord('T')}", _curve(2, mx, my, mx, my, x(0), y(1))),
        default=arc,
    )


def _straight(d: str) -> str:
    """Box of a plain outline: every point counts, so no pen has to be followed."""
    def axis(offset: int) -> str:
        return f"filter({{v}}, (n, i) -> i % 2 = {offset})"

    def box(v):
        xs, ys = (axis(k).format(v=v("n")) for k in (0, 1))
        return _let(
            lambda c: _struct(xmin=f"array_min({c('x')})", xmax=f"array_max({c('x')})",
                              ymin=f"array_min({c('y')})", ymax=f"array_max({c('y')})"), x=xs, y=ys)

    return _let(box, n=f"CAST(regexp_extract_all({d}, '{_NUMBER}', 0) AS ARRAY<DOUBLE>)")


@cache
def path_bbox_sql(d: str) -> str:
    start = _state("0D", "0D", _NONE, _NONE, _NONE, _NONE, 0, _NONE, _NONE, _NONE, _NONE)
    box = _struct(xmin="a.x0", xmax="a.x1", ymin="a.y0", ymax="a.y1")
    walk = f"aggregate({_steps(d)}, {start}, (a, s) -> {_advance()}, a -> IF(a.ok AND a.x0 IS NOT NULL, {box}, NULL))"
    stray = f"regexp_extract({d}, '^([^{_LETTERS}]*)', 1) RLIKE '{_NUMBER}'"
    # One sub-path of absolute lines with whole pairs of plainly separated numbers, at least two points.
    number = r"[-+]?+(?:[0-9]++(?:\\.[0-9]++)?+|\\.[0-9]++)"
    pair = rf"\\s*+{number}[\\s,]++{number}"
    outline = rf"^\\s*+M{pair}(?:(?:\\s*+L|[\\s,]++){pair})++\\s*+Z?+\\s*+$"
    return f"CASE WHEN {d} RLIKE '{outline}' THEN {_straight(d)} WHEN NOT ({stray}) THEN {walk} END"


def path_bbox(d: str) -> Column:
    """``struct<xmin, xmax, ymin, ymax>`` of path data, NULL where it has no box.

    ``d`` is SQL: a column name, or any string expression.
    """
    return F.expr(path_bbox_sql(d))
