"""Drawings of results as SVG, from frames that are small by then: curves, clouds, matrices, tracks, arcs, circles.

``Drawing`` holds panels one below the other; a panel has its own scale. The
functions below make the pictures that the commands write; each returns a drawing,
and ``save`` writes it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from html import escape

import numpy as np
import pandas as pd

COLORS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e", "#8c564b")
#: Points of a cloud that are drawn: more do not show.
SHOWN = 20_000


class Drawing:
    """Panels of one width, from top to bottom."""

    def __init__(self, width: int = 600) -> None:
        self.width, self.high, self.parts = width, 10, []

    def panel(self, height: int, x: tuple[float, float], y: tuple[float, float], title: str = "", xlabel: str = "", ylabel: str = "") -> Panel:
        p = Panel(self, height, x, y)
        for text, at, turn in ((title, (p.left + p.wide / 2, p.top - 4), 0), (xlabel, (p.left + p.wide / 2, p.top + height + 24), 0), (ylabel, (12, p.top + height / 2), -90)):
            if text:
                self.parts.append(f'<text x="{at[0]:.1f}" y="{at[1]:.1f}" font-size="9" text-anchor="middle" transform="rotate({turn} {at[0]:.1f} {at[1]:.1f})">{escape(text)}</text>')
        self.high = p.top + height + 30
        return p

    def svg(self) -> str:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.width}" height="{self.high}" font-family="sans-serif">' + "".join(self.parts) + "</svg>"

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.svg())


class Panel:
    def __init__(self, drawing: Drawing, height: int, x: tuple[float, float], y: tuple[float, float]) -> None:
        self.parts, self.left, self.top, self.wide, self.high = drawing.parts, 50, drawing.high + 14, drawing.width - 70, height
        self.x0, self.x1, self.y0, self.y1 = x[0], x[1] if x[1] > x[0] else x[0] + 1, y[0], y[1] if y[1] > y[0] else y[0] + 1
        self.parts.append(f'<rect x="{self.left}" y="{self.top}" width="{self.wide}" height="{height}" fill="none" stroke="#999"/>')
        for v, anchor, at in ((self.x0, "start", self.left), (self.x1, "end", self.left + self.wide)):
            self.parts.append(f'<text x="{at}" y="{self.top + height + 11}" font-size="8" text-anchor="{anchor}">{v:.6g}</text>')
        for v, at in ((self.y0, self.top + height), (self.y1, self.top + 8)):
            self.parts.append(f'<text x="{self.left - 3}" y="{at}" font-size="8" text-anchor="end">{v:.4g}</text>')

    def at(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        return (self.left + (np.asarray(x, float) - self.x0) / (self.x1 - self.x0) * self.wide, self.top + self.high - (np.asarray(y, float) - self.y0) / (self.y1 - self.y0) * self.high)

    def line(self, x, y, color: str = COLORS[0], label: str = "", place: int = 0, dash: str = "") -> None:
        px, py = self.at(x, y)
        keep = np.isfinite(px) & np.isfinite(py)
        points = " ".join(f"{a:.1f},{b:.1f}" for a, b in zip(px[keep], py[keep], strict=True))
        self.parts.append(f'<polyline points="{points}" fill="none" stroke="{color}" stroke-dasharray="{dash}"/>')
        if label:
            self.parts.append(f'<text x="{self.left + self.wide - 4}" y="{self.top + 12 + 11 * place}" font-size="9" fill="{color}" text-anchor="end">{escape(label)}</text>')

    def points(self, x, y, color: str = COLORS[0], size: float = 1.5) -> None:
        px, py = self.at(x, y)
        step = max(1, len(px) // SHOWN)
        self.parts += [f'<circle cx="{a:.1f}" cy="{b:.1f}" r="{size}" fill="{color}" fill-opacity="0.6"/>' for a, b in zip(px[::step], py[::step], strict=True) if math.isfinite(a) and math.isfinite(b)]

    def area(self, start, end, value, color: str = COLORS[0]) -> None:
        for s, e, v in zip(start, end, value, strict=True):
            (a, b), (top, low) = self.at([s, e], [0, 0])[0], self.at([0, 0], [v, max(self.y0, 0)])[1]
            self.parts.append(f'<rect x="{a:.1f}" y="{min(top, low):.1f}" width="{max(b - a, 0.3):.1f}" height="{abs(low - top):.1f}" fill="{color}"/>')

    def cells(self, mat: np.ndarray, low: float | None = None, high: float | None = None, both: bool = False) -> None:
        """A matrix, first row on top: white to red, or, ``both``, blue over white to red."""
        m = np.asarray(mat, float)
        high = high if high is not None else (float(np.nanmax(m)) if m.size else 1.0)
        low = low if low is not None else (-high if both else float(np.nanmin(m)) if m.size else 0.0)
        w, h = self.wide / max(m.shape[1], 1), self.high / max(m.shape[0], 1)
        for i, j in np.argwhere(np.isfinite(m) & (m != 0)):
            t = min(max((m[i, j] - low) / ((high - low) or 1), 0.0), 1.0)
            shade = (255, int(255 * (1 - t)), int(255 * (1 - t))) if not both else ((255, int(510 * (1 - t)), int(510 * (1 - t))) if t >= 0.5 else (int(510 * t), int(510 * t), 255))
            self.parts.append(f'<rect x="{self.left + j * w:.1f}" y="{self.top + i * h:.1f}" width="{w + 0.2:.2f}" height="{h + 0.2:.2f}" fill="rgb{shade}"/>')

    def arcs(self, a, b, color: str = COLORS[3], width: float = 0.5) -> None:
        """Half ellipses from a to b, higher for longer ones."""
        far = max((abs(t - s) for s, t in zip(a, b, strict=True)), default=1) or 1
        for s, t in zip(a, b, strict=True):
            (p, q), (low, _) = self.at([s, t], [self.y0, self.y0])
            self.parts.append(f'<path d="M{p:.1f},{low:.1f} A{abs(q - p) / 2:.1f},{self.high * 0.95 * abs(t - s) / far:.1f} 0 0 1 {q:.1f},{low:.1f}" fill="none" stroke="{color}" stroke-width="{width}" stroke-opacity="0.6"/>')

    def boxes(self, x0, x1, y0, y1, color: str = COLORS[0], fill: bool = False) -> None:
        for a, b, c, d in zip(x0, x1, y0, y1, strict=True):
            (p, q), (s, t) = self.at([a, b], [c, d])
            self.parts.append(f'<rect x="{p:.1f}" y="{min(s, t):.1f}" width="{max(q - p, 0.5):.1f}" height="{abs(t - s):.1f}" stroke="{color}" fill="{color if fill else "none"}"/>')

    def text(self, x: float, y: float, what: str, color: str = "#000") -> None:
        px, py = self.at([x], [y])
        self.parts.append(f'<text x="{px[0]:.1f}" y="{py[0]:.1f}" font-size="7" fill="{color}">{escape(what)}</text>')


def _range(*values) -> tuple[float, float]:
    v = np.concatenate([np.asarray(x, float).ravel() for x in values]) if values else np.zeros(1)
    v = v[np.isfinite(v)]
    return (float(v.min()), float(v.max())) if len(v) else (0.0, 1.0)


def curves(x, ys: dict[str, Sequence[float]], title: str = "", xlabel: str = "", ylabel: str = "", height: int = 220, drawing: Drawing | None = None) -> Drawing:
    """Lines over one axis: resolution, saturation, decay, profiles, signal to noise."""
    d = drawing or Drawing()
    p = d.panel(height, _range(x), _range(*ys.values()), title, xlabel, ylabel)
    for i, (name, y) in enumerate(ys.items()):
        p.line(x, y, COLORS[i % len(COLORS)], name, i)
    return d


def clouds(groups: dict[str, tuple], title: str = "", xlabel: str = "", ylabel: str = "", height: int = 300, lines: tuple[tuple[float | None, float | None], ...] = (), drawing: Drawing | None = None) -> Drawing:
    """Points in colours by group, with dashed lines at values of x or y: correlations, means against differences, fold changes against p, changes between samples."""
    d = drawing or Drawing()
    xs, ys = _range(*[g[0] for g in groups.values()]), _range(*[g[1] for g in groups.values()])
    p = d.panel(height, xs, ys, title, xlabel, ylabel)
    for i, (name, (x, y)) in enumerate(groups.items()):
        color = "#999999" if i == 0 and len(groups) > 1 else COLORS[i % len(COLORS)]
        p.points(x, y, color)
        p.line([], [], color, f"{name}: {len(x)}", i)
    for x, y in lines:
        p.line([x, x] if x is not None else list(xs), [y, y] if y is not None else list(ys), "#666", dash="3")
    return d


def histogram(groups: dict[str, Sequence[float]], bins: int = 100, title: str = "", xlabel: str = "", mark: float | None = None) -> Drawing:
    """Shares of values in bins: distances with their mixture, sorted neighbour distances, cutoffs."""
    edges = np.linspace(*_range(*groups.values()), bins + 1)
    shares = {n: np.histogram(np.asarray(v, float), edges)[0] / max(len(v), 1) for n, v in groups.items()}
    d = curves((edges[1:] + edges[:-1]) / 2, shares, title, xlabel, "share")
    if mark is not None:
        top = max((s.max() for s in shares.values()), default=1)
        Panel.line(_same(d, edges, top), [mark, mark], [0, top], "#666", dash="3")
    return d


def _same(d: Drawing, edges: np.ndarray, top: float) -> Panel:
    p = Panel.__new__(Panel)
    p.parts, p.left, p.top, p.wide, p.high = d.parts, 50, 24, d.width - 70, 220
    p.x0, p.x1, p.y0, p.y1 = float(edges[0]), float(edges[-1]), 0.0, float(top) or 1.0
    return p


def heatmap(mat: pd.DataFrame | np.ndarray, title: str = "", both: bool = False, low: float | None = None, high: float | None = None, drawing: Drawing | None = None) -> Drawing:
    """A matrix: correlations, mean tiles of loops, viewpoints, anchors and domains."""
    m = np.asarray(mat, float)
    d = drawing or Drawing()
    d.panel(d.width - 70, (0, m.shape[1]), (0, m.shape[0]), title).cells(m, low, high, both)
    return d


def upper_triangle(mat: np.ndarray) -> np.ndarray:
    """The matrix turned by 45 degrees, distance upwards: row d holds the cells (i, i + d) at 2 i + d."""
    m = np.asarray(mat, float)
    out = np.full((len(m), 2 * len(m)), np.nan)
    for k in range(len(m)):
        v = np.diagonal(m, k)
        at = 2 * np.arange(len(v)) + k
        out[len(m) - 1 - k, at] = v
        out[len(m) - 1 - k, at + 1] = v
    return out


def genes(p: Panel, rows: pd.DataFrame) -> None:
    """Genes (gene_name, start, end, strand, exons) below each other: exons as blocks on a line, the first one coloured."""
    step = (p.y1 - p.y0) / max(len(rows), 1)
    for i, g in enumerate(rows.itertuples()):
        y = p.y1 - (i + 0.5) * step
        exons = [(e["start"], e["end"]) if isinstance(e, dict) else (e[0], e[1]) for e in g.exons]
        first = 0 if g.strand == "+" else len(exons) - 1
        p.line([g.start, g.end], [y, y], "#999")
        for k, (s, e) in enumerate(exons):
            p.boxes([s], [e], [y - step * 0.3], [y + step * 0.3], COLORS[1 if g.strand == "+" else 3] if k == first else "#000", True)
        p.text(g.end, y, str(g.gene_name), COLORS[1 if g.strand == "+" else 3])


def regions(p: Panel, rows: pd.DataFrame, color: str = COLORS[2]) -> None:
    p.boxes(rows["start"], rows["end"], [p.y0] * len(rows), [p.y1] * len(rows), color, True)


def tracks(d: Drawing, start: int, end: int, signals: dict[str, pd.DataFrame] | None = None, beds: dict[str, pd.DataFrame] | None = None, known: pd.DataFrame | None = None, loops: pd.DataFrame | None = None) -> Drawing:
    """Tracks of a window below each other: signals (start, end, value), regions, genes, loops as arcs."""
    for i, (name, rows) in enumerate((signals or {}).items()):
        p = d.panel(50, (start, end), (min(0.0, _range(rows["value"])[0]), _range(rows["value"])[1]), name)
        p.area(rows["start"].clip(start, end), rows["end"].clip(start, end), rows["value"], COLORS[i % len(COLORS)])
    for name, rows in (beds or {}).items():
        regions(d.panel(12, (start, end), (0, 1), name), rows)
    if known is not None and len(known):
        genes(d.panel(14 * len(known), (start, end), (0, len(known)), "genes"), known)
    if loops is not None and len(loops):
        d.panel(60, (start, end), (0, 1), "loops").arcs((loops["start_a"] + loops["end_a"]) / 2, (loops["start_b"] + loops["end_b"]) / 2, width=1)
    return d


def matrix_window(mat: pd.DataFrame, start: int, end: int, size: int, triangle: bool = False, both: bool = False, loops: pd.DataFrame | None = None, domains: pd.DataFrame | None = None, eigen: bool = False, turn: bool = False, title: str = "", **below) -> Drawing:
    """A contact matrix with boxes of loops and domains on it, its first component, and tracks below."""
    d, m = Drawing(), mat.to_numpy(float)
    if triangle:
        p = d.panel(240, (start, end), (0, (end - start) / 2), title)
        p.cells(upper_triangle(m), both=both)
    else:
        p = d.panel(d.width - 70, (start, end), (start, end), title)
        p.cells(m, both=both)
        flip = lambda v: start + end - v  # noqa: E731  rows count from the top
        for rows, a, b in ((loops, "a", "b"), (domains, "", "")):
            if rows is not None and len(rows):
                xa, ya = (rows[f"start_{a}"], rows[f"end_{a}"]) if a else (rows["start"], rows["end"])
                xb, yb = (rows[f"start_{b}"], rows[f"end_{b}"]) if b else (rows["start"], rows["end"])
                p.boxes(xb, yb, flip(xa), flip(ya), "#00a0a0")
    if eigen:
        v = first_component(m) * (-1 if turn else 1)
        at = start + size * np.arange(len(v))
        d.panel(50, (start, end), _range(v, [0]), "first component").area(at, at + size, v)
    return tracks(d, start, end, **below)


def first_component(mat: np.ndarray) -> np.ndarray:
    """Projections of the rows' correlations on their first axis; 0 for rows without counts."""
    m = np.asarray(mat, float)
    with np.errstate(all="ignore"):
        c = np.nan_to_num(np.corrcoef(m))
    c = c - c.mean(axis=0)
    _, _, axes = np.linalg.svd(c, full_matrices=False)
    out = c @ axes[0]
    out[m.sum(axis=0).astype(int) == 0] = 0
    return out


def arches(pairs: pd.DataFrame, start: int, end: int, title: str = "", **below) -> Drawing:
    """Every pair (x, y) of a window as an arch, with tracks below."""
    d = Drawing()
    d.panel(160, (start, end), (0, 1), title).arcs(pairs["x"], pairs["y"])
    return tracks(d, start, end, **below)


def scatter(pairs: pd.DataFrame, start: int, end: int, title: str = "", **below) -> Drawing:
    """Every pair at its middle and distance, with tracks below."""
    d = Drawing()
    d.panel(160, (start, end), (0, end - start), title, "", "distance").points((pairs["x"] + pairs["y"]) / 2, pairs["y"] - pairs["x"])
    return tracks(d, start, end, **below)


def profile_rows(rows: pd.DataFrame, title: str = "") -> Drawing:
    """The mean of profiles, one a row, above their heat map, highest sums first."""
    d = curves(list(range(rows.shape[1])), {f"{len(rows)} regions": rows.mean(axis=0).to_numpy()}, title, "bin", "mean")
    return heatmap(rows.iloc[np.argsort(-rows.sum(axis=1).to_numpy())].to_numpy(), drawing=d)


class Circle:
    """Regions around a circle, with gaps between them, and links across it."""

    def __init__(self, lengths: dict[str, float], gap: float = 3, size: int = 500) -> None:
        self.size, self.radius, self.parts = size, size * 0.38, []
        free = 360 - gap * len(lengths)
        total, at, self.of = sum(lengths.values()) or 1, 0.0, {}
        for name, length in lengths.items():
            self.of[name] = (at, free * length / total, length)
            at += free * length / total + gap

    def angle(self, name: str, place: float) -> float:
        """Degrees of a place within a region."""
        start, span, length = self.of[name]
        return start + span * place / (length or 1)

    def point(self, degrees: float, radius: float) -> tuple[float, float]:
        t = math.radians(degrees - 90)
        return self.size / 2 + radius * math.cos(t), self.size / 2 + radius * math.sin(t)

    def scaffold(self, width: float = 12, color: str = "#999", part: dict[str, tuple[float, float]] | None = None) -> None:
        """Arcs of all regions, or of a part of each, with names."""
        for name, (start, span, length) in self.of.items():
            a, b = (start, start + span) if part is None else (self.angle(name, part[name][0]), self.angle(name, part[name][1]))
            (x, y), (u, v) = self.point(a, self.radius), self.point(b, self.radius)
            self.parts.append(f'<path d="M{x:.1f},{y:.1f} A{self.radius:.1f},{self.radius:.1f} 0 {int(b - a > 180)} 1 {u:.1f},{v:.1f}" fill="none" stroke="{color}" stroke-width="{width}"/>')
            if part is None:
                x, y = self.point((a + b) / 2, self.radius * 1.12)
                self.parts.append(f'<text x="{x:.1f}" y="{y:.1f}" font-size="9" text-anchor="middle">{escape(name)}</text>')

    def link(self, a: str, place_a: float, b: str, place_b: float, width: float = 1, color: str = COLORS[3]) -> None:
        (x, y), (u, v) = self.point(self.angle(a, place_a), self.radius * 0.97), self.point(self.angle(b, place_b), self.radius * 0.97)
        c = self.size / 2
        self.parts.append(f'<path d="M{x:.1f},{y:.1f} Q{c},{c} {u:.1f},{v:.1f}" fill="none" stroke="{color}" stroke-width="{width:.2f}" stroke-opacity="0.6"/>')

    def signal(self, name: str, start, end, value, width: float = 20, color: str = COLORS[0]) -> None:
        """Bars outside a region, as high as their share of the largest value."""
        top = max(value, default=1) or 1
        for s, e, v in zip(start, end, value, strict=True):
            corners = [self.point(self.angle(name, p), self.radius * 1.02 + r) for p, r in ((s, 0), (e, 0), (e, width * v / top), (s, width * v / top))]
            self.parts.append('<polygon points="' + " ".join(f"{x:.1f},{y:.1f}" for x, y in corners) + f'" fill="{color}"/>')

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.size}" height="{self.size}" font-family="sans-serif">' + "".join(self.parts) + "</svg>")


def montage(known: pd.DataFrame, links: pd.DataFrame, ext: float = 2, per_million: float = 10, view: Sequence[str] = ()) -> Circle:
    """Regions (name, start, end) with ``ext`` of their lengths to both sides around a circle, and links (id_a, id_b, per_million) between them as wide as they are many."""
    size = {r.name_: (2 * ext + 1) * (r.end - r.start) for r in known.rename(columns={"name": "name_"}).itertuples()}
    c = Circle(size)
    c.scaffold()
    c.scaffold(color=COLORS[0], part={n: (s * ext / (2 * ext + 1), s * (ext + 1) / (2 * ext + 1)) for n, s in size.items()})
    for r in links.itertuples():
        if not view or r.id_a in view or r.id_b in view:
            c.link(r.id_a, size[r.id_a] / 2, r.id_b, size[r.id_b] / 2, r.per_million * per_million)
    return c
