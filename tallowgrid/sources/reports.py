"""Report sinks for small tables: Markdown and bar charts as SVG."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame


def _rows(df: DataFrame, most: int):
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report shows {most} rows at most; this table has more")
    return rows


def markdown(df: DataFrame, most: int = 500) -> str:
    """A Markdown table; more than ``most`` rows is an error, never a cut."""
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in _rows(df, most)]) + "\n"


def bar_svg(df: DataFrame, label: str, value: str, most: int = 60) -> str:
    """Horizontal bars from zero, in the order of the rows; missing values have no bar."""
    rows = _rows(df.select(label, value), most)
    top = max((abs(r[1]) for r in rows if r[1] is not None), default=1.0) or 1.0
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="640" height="{24 * len(rows) + 8}" font-family="sans-serif" font-size="12">']
    for i, (name, v) in enumerate(rows):
        y = 24 * i + 4
        out.append(f'<text x="4" y="{y + 14}">{escape(str(name))}</text>')
        if v is not None:
            out.append(f'<rect x="220" y="{y}" width="{340 * abs(v) / top:.1f}" height="18" fill="#4a7ab5"/><text x="{226 + 340 * abs(v) / top:.1f}" y="{y + 14}">{v:.4g}</text>')
    return "".join(out) + "</svg>\n"
