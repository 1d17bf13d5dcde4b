"""Text reports and plain SVG charts from small result tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence
from html import escape
from pathlib import Path
from typing import Any

PALETTE = ("#4c72b0", "#dd8452", "#55a868", "#c44e52", "#8172b3", "#937860")


def _cell(v: Any) -> str:
    if v is None:
        return ""
    return f"{v:.4f}" if isinstance(v, float) else str(v)


def markdown_table(rows: Sequence[Mapping[str, Any]], columns: Sequence[str]) -> str:
    body = ["| " + " | ".join(_cell(r.get(c)) for c in columns) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *body])


def data_card(summary: Mapping[str, Any]) -> str:
    """What a published bundle holds and how it was made."""
    files = [{"file": k, "rows": v["rows"], "content": v["content_sha256"][:12]} for k, v in sorted(summary["files"].items())]
    return "\n\n".join(
        [
            "# Data card",
            f"Buildings: {len(summary['buildings'])}. Left out: {len(summary['exclusions'])}. Times are {summary['timestamp_semantics']}.",
            f"Faults lie strictly before {summary['cutoff']} (seed {summary['seed']}, severity {summary['severity']}). Later readings are those of the reference.",
            markdown_table(files, ["file", "rows", "content"]),
            "",
        ]
    )


def onboarding_report(summary: Mapping[str, Any], detectors: Iterable[Mapping[str, Any]] = ()) -> str:
    gate = [{"field": k, "value": v} for k, v in summary["gate"].items()]
    repair = [{"status": k, "rows": v} for k, v in sorted(summary["repair"].items())]
    return "\n\n".join(
        [
            "# Onboarding report", "## Gate", markdown_table(gate, ["field", "value"]), "## Repair", markdown_table(repair, ["status", "rows"]),
            "## Detectors", markdown_table(list(detectors), ["fault_type", "true_positive", "false_negative", "false_positive", "precision", "recall"]), "",
        ]
    )


def findings(narrative: Iterable[Mapping[str, Any]]) -> str:
    """A sentence for each model; rates relative to the reference and the corrupted condition."""
    words = {"full": "full recovery", "partial": "partial recovery", "none": "no recovery", "better_than_reference": "better than the reference"}
    pct = lambda v: "undefined" if v is None else f"{100 * v:+.1f} %"
    return "\n".join(
        f"* {r['model']}: corruption changed the error by {pct(r['corruption_effect'])}, repair then by {pct(r['repair_effect'])} ({words[r['recovery']]})."
        for r in sorted(narrative, key=lambda r: r["model"])
    )


def forecast_report(tables: Mapping[str, Sequence[Mapping[str, Any]]]) -> str:
    parts = ["# Forecast report", "## Metrics", markdown_table(sorted(tables["metrics"], key=lambda r: (r["model"], r["condition"])), ["model", "condition", "n", "mae", "ci_low", "ci_high", "rmse", "wmape", "mase", "r2"])]
    parts += ["## Paired differences (negative favours repair)", markdown_table(sorted(tables["paired"], key=lambda r: r["model"]), ["model", "n", "corrupted_mae", "remediated_mae", "mean_difference", "ci_low", "ci_high"])]
    if "narrative" in tables:
        parts += ["## Findings", findings(tables["narrative"])]
    return "\n\n".join([*parts, ""])


def _svg(width: int, height: int, title: str, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" font-family="sans-serif" font-size="12">'
    return "\n".join([head, f"<title>{escape(title)}</title>", f'<text x="10" y="20" font-size="15">{escape(title)}</text>', *body, "</svg>", ""])


def bars(rows: Sequence[Mapping[str, Any]], value: str, title: str) -> str:
    """One bar a model and condition, models in groups; undefined values are left blank."""
    rows = sorted(rows, key=lambda r: (r["model"], r["condition"]))
    colour = {c: PALETTE[i % len(PALETTE)] for i, c in enumerate(sorted({r["condition"] for r in rows}))}
    top = max([r[value] for r in rows if r[value] is not None], default=0) or 1
    body = []
    for i, r in enumerate(rows):
        y, v = 40 + 22 * i, r[value]
        body.append(f'<text x="10" y="{y + 12}">{escape(r["model"])} / {escape(r["condition"])}</text>')
        if v is not None:
            body.append(f'<rect x="260" y="{y}" width="{360 * v / top:.1f}" height="16" fill="{colour[r["condition"]]}"/>')
            body.append(f'<text x="{266 + 360 * v / top:.1f}" y="{y + 12}">{v:.4f}</text>')
    return _svg(720, 60 + 22 * len(rows), title, body)


def lines(rows: Sequence[Mapping[str, Any]], x: str, value: str, title: str) -> str:
    """One line a model and condition over ``x``."""
    series: dict[str, list[tuple[float, float]]] = {}
    for r in sorted(rows, key=lambda r: (r["model"], r["condition"], r[x])):
        if r[value] is not None:
            series.setdefault(f"{r['model']} / {r['condition']}", []).append((r[x], r[value]))
    xs, ys = [p[0] for s in series.values() for p in s] or [0], [p[1] for s in series.values() for p in s] or [0]
    wide, tall = (max(xs) - min(xs)) or 1, max(ys) or 1
    body = ['<line x1="50" y1="340" x2="500" y2="340" stroke="#333"/>', '<line x1="50" y1="40" x2="50" y2="340" stroke="#333"/>', f'<text x="5" y="45">{tall:.3g}</text>']
    for i, (name, points) in enumerate(series.items()):
        at = " ".join(f"{50 + 450 * (a - min(xs)) / wide:.1f},{340 - 300 * b / tall:.1f}" for a, b in points)
        body.append(f'<polyline fill="none" stroke="{PALETTE[i % len(PALETTE)]}" points="{at}"/>')
        body.append(f'<text x="510" y="{50 + 16 * i}" fill="{PALETTE[i % len(PALETTE)]}">{escape(name)}</text>')
    return _svg(760, 370, title, body)


def source_revision(root: str | None = None) -> dict[str, Any]:
    """A digest of the package's Python files, in path order."""
    base = Path(root) if root else Path(__file__).resolve().parents[1]
    digest, n = hashlib.sha256(), 0
    for p in sorted(base.rglob("*.py")):
        digest.update(str(p.relative_to(base)).encode() + b"\0" + p.read_bytes() + b"\0")
        n += 1
    return {"files": n, "sha256": digest.hexdigest()}
