"""Benchmark records: CSV scans and appends, log scans, Markdown and LaTeX tables, configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Report columns by kind of file (fixed values).
SCHEMAS = {
    "selected": "mode string, threads int, recall double, latency_us double, total_us double",
    "batch_scale": "mode string, threads int, query_limit int, recall double, latency_us double, total_us double",
    "tradeoff": "family string, mode string, param_name string, param_value int, threads int, recall double, latency_us double, total_us double",
    "bench": "mode string, threads int, avg_recall double, avg_latency_us double, total_time_us double",
    "extra": "suite string, mode string, threads int, query_limit int, param_name string, param_value int, avg_recall double, avg_latency_us double, total_time_us double",
    "batched": (
        "mode string, batch_size int, queries int, recall double, latency_us double, total_us double, h2d_ms double, flat_mm_ms double, "
        "centroid_ms double, refine_ms double, topk_ms double, d2h_ms double, refine_pairs long, skipped_pairs long"
    ),
    "strategy": "variant string, label string, recall double, latency_us double",
}
#: Log labels and the columns they fill (fixed values).
LOG_FIELDS = {"recall": "average recall:", "latency_us": "average latency (us):", "total_us": "total time (us):"}
STAGE_FIELDS = {
    "h2d_ms": "stage h2d query total (ms):", "flat_mm_ms": "stage flat mm total (ms):", "centroid_ms": "stage centroid total (ms):",
    "refine_ms": "stage refine total (ms):", "topk_ms": "stage topk total (ms):", "d2h_ms": "stage d2h total (ms):",
    "batches": "gpu batches:", "refine_groups": "ivf refine groups:", "refine_pairs": "ivf refine pairs:", "skipped_pairs": "ivf skipped pairs in wasteful baseline:",
}
#: Characters that LaTeX needs escaped (fixed values).
LATEX_SPECIAL = {"\\": r"\textbackslash{}", "_": r"\_", "%": r"\%", "&": r"\&", "#": r"\#"}
#: Settings whose environment variable has another name than the setting (fixed values).
VARIABLES = {"nlist": "IVF_NLIST", "nprobe": "IVF_NPROBE", "batch": "GPU_BATCH"}


SEARCH_MODES = ("flat", "sq", "pq", "ivf", "ivf_pq", "hnsw", "ivf_hnsw")


@dataclass(frozen=True)
class SearchConfig:
    """Search settings; the environment overrides defaults, keyword arguments override both."""

    mode: str = "flat"
    engine: str = "arrow"
    batch: int = 256
    data_path: str = "."
    query_limit: int = 2000
    base_limit: int = 0
    topk: int = 10
    nlist: int = 128
    nprobe: int = 32
    pq_rerank: int = 550
    hnsw_ef: int = 64

    @classmethod
    def read(cls, prefix: str = "ANN_", **own) -> SearchConfig:
        values = {}
        for f in fields(cls):
            text = os.environ.get(prefix + f.name.upper(), "") or os.environ.get(prefix + VARIABLES.get(f.name, ""), "")
            try:
                values[f.name] = type(f.default)(text) if text else f.default
            except ValueError:
                values[f.name] = f.default
        config = cls(**values | own)
        if config.mode not in SEARCH_MODES or config.engine not in ("expr", "arrow"):
            raise ValueError(f"mode is one of {SEARCH_MODES}, engine 'expr' or 'arrow'")
        if config.batch < 1:
            raise ValueError("batch must be positive")
        if config.topk < 1 or config.nprobe < 1 or config.nprobe > config.nlist:
            raise ValueError("topk and nprobe must be positive, and nprobe at most nlist")
        return config


def data_path(folder: str, name: str) -> str:
    """One separator between folder and name, whatever the folder ends with."""
    return f"{folder.rstrip('/') or '/'}/{name}" if folder.rstrip("/") else f"/{name}" if folder else name


def read_report(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Typed rows of a report; a byte-order mark before the header doesn't matter."""
    schema = SCHEMAS[kind]
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def append_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, stages: bool = False) -> DataFrame:
    """``file`` and the last value of each labelled figure in it, with ``stages`` also of the stages' timings and counters."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("n"))
    out = []
    for name, label in (LOG_FIELDS | (STAGE_FIELDS if stages else {})).items():
        figure = F.regexp_extract("value", r"\Q" + label + r"\E\s*([-+0-9.eE]+)", 1)
        out.append(F.max_by(F.when(figure != "", figure.cast("double")), F.when(figure != "", F.col("n"))).alias(name))
    return lines.groupBy("file").agg(*out)


def markdown_table(df: DataFrame) -> str:
    """A report-sized DataFrame as Markdown."""
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in df.collect()]]) + "\n"


def latex_escape(text: str) -> str:
    return "".join(LATEX_SPECIAL.get(c, c) for c in text)


def latex_table(df: DataFrame) -> str:
    """A report-sized DataFrame as a LaTeX tabular."""
    row = lambda cells: " & ".join(latex_escape("" if c is None else str(c)) for c in cells) + r" \\"
    body = [r"\hline", row(df.columns), r"\hline", *[row(r) for r in df.collect()], r"\hline"]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", *body, r"\end{tabular}"]) + "\n"


#: Room around a chart for ticks and labels, and colours of its series in turn.
LEFT, TOP, RIGHT, BOTTOM = 72, 28, 120, 56
COLOURS = ("#1b6ca8", "#c8553d", "#3c8d5a", "#8a5fbf", "#b08900", "#4a4e69")


def _text(x: float, y: float, words: object, more: str = "") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="11"{more}>{escape(str(words))}</text>'


def _chart(title: str, width: int, height: int, top: float, marks: list[str]) -> str:
    """Marks on a plane with axes, and five ticks and grid lines up to ``top``."""
    w, h = width - LEFT - RIGHT, height - TOP - BOTTOM
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">', _text(LEFT, 16, title)]
    for k in range(6):
        y = TOP + h - h * k / 5
        out += [f'<line x1="{LEFT}" y1="{y:.1f}" x2="{LEFT + w}" y2="{y:.1f}" stroke="#ddd"/>', _text(LEFT - 6, y + 4, f"{top * k / 5:g}", ' text-anchor="end"')]
    out += [f'<path d="M{LEFT} {TOP}V{TOP + h}H{LEFT + w}" fill="none" stroke="#222"/>', *marks, "</svg>"]
    return "\n".join(out) + "\n"


def svg_bars(df: DataFrame, label: str, value: str, width: int = 640, height: int = 320) -> str:
    """A report-sized DataFrame as a bar chart; missing values have no height."""
    rows = [(r[0], float(r[1] or 0)) for r in df.select(label, value).collect()]
    top = max((v for _, v in rows), default=0) or 1
    w, h = width - LEFT - RIGHT, height - TOP - BOTTOM
    step, marks = w / max(1, len(rows)), []
    for i, (name, v) in enumerate(rows):
        x, tall = LEFT + step * (i + 0.15), h * v / top
        marks.append(f'<rect x="{x:.1f}" y="{TOP + h - tall:.1f}" width="{0.7 * step:.1f}" height="{tall:.1f}" fill="{COLOURS[0]}"/>')
        marks += [_text(x + 0.35 * step, TOP + h - tall - 4, f"{v:g}", ' text-anchor="middle"'), _text(x + 0.35 * step, TOP + h + 16, name, ' text-anchor="middle"')]
    return _chart(value, width, height, top, marks)


def svg_lines(df: DataFrame, x: str, y: str, series: str, width: int = 640, height: int = 320) -> str:
    """A report-sized DataFrame as a line and a legend entry for each series; rows without both values are left out."""
    rows = [(r[0], float(r[1]), float(r[2])) for r in df.select(series, x, y).collect() if r[1] is not None and r[2] is not None]
    lines: dict[object, list[tuple[float, float]]] = {}
    for name, a, b in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        lines.setdefault(name, []).append((a, b))
    low, high = min((r[1] for r in rows), default=0), max((r[1] for r in rows), default=1)
    top = max((r[2] for r in rows), default=0) or 1
    w, h = width - LEFT - RIGHT, height - TOP - BOTTOM
    at = lambda a, b: (LEFT + w * (a - low) / ((high - low) or 1), TOP + h - h * b / top)
    marks = [_text(at(a, 0)[0], TOP + h + 16, f"{a:g}", ' text-anchor="middle"') for a in sorted({r[1] for r in rows})]
    marks.append(_text(LEFT + w / 2, TOP + h + 36, x, ' text-anchor="middle"'))
    for i, (name, points) in enumerate(lines.items()):
        colour, places = COLOURS[i % len(COLOURS)], [at(*p) for p in points]
        marks.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(f"{px:.1f},{py:.1f}" for px, py in places)}"/>')
        marks += [f'<circle cx="{px:.1f}" cy="{py:.1f}" r="3" fill="{colour}"/>' for px, py in places]
        marks += [f'<rect x="{LEFT + w + 12}" y="{TOP + 18 * i}" width="10" height="10" fill="{colour}"/>', _text(LEFT + w + 28, TOP + 18 * i + 9, name)]
    return _chart(y, width, height, top, marks)
