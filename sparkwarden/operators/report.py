"""A summary row as text."""

from __future__ import annotations

from typing import Any


def share(part: int, whole: int) -> str:
    return f"{100 * part / whole:.1f}%" if whole else "—"


def duration(ms: float) -> str:
    if ms < 1000:
        return f"{ms:.0f} ms"
    if ms < 60_000:
        return f"{ms / 1000:.1f} s"
    return f"{int(ms // 60_000)} min {round(ms % 60_000 / 1000)} s"


def summary_rows(s: dict[str, Any]) -> list[tuple[str, str]]:
    """``(label, value)``; what is nought and says nothing is left out."""
    elapsed = s.get("elapsed_ms") or 0
    speed = f"{round(s['processed'] * 1000 / elapsed):,}/s" if elapsed > 0 else "—"
    rows = [
        ("Records", f"{s['processed']:,}", True),
        ("Flagged", f"{s['flagged']:,} ({share(s['flagged'], s['processed'])})", True),
        ("By word list", f"{s['matched_list']:,}", True),
        ("With personal data", f"{s['pii_records']:,} ({s['pii_findings']:,} findings)", bool(s["pii_findings"])),
        ("Model asked", f"{s['ai_calls']:,}", bool(s["ai_calls"])),
        ("Model flagged", f"{s['ai_flagged']:,}", bool(s["ai_calls"])),
        ("Model failed", f"{s['ai_errors']:,}", bool(s["ai_errors"])),
        ("Stage errors", f"{s['errors']:,}", bool(s["errors"])),
        ("Took", f"{duration(elapsed)} · {speed}", True),
        ("Model budget", "spent: later records were not asked about", bool(s.get("ai_budget_exhausted"))),
        ("Ended", "stopped before the end of the input", bool(s.get("aborted"))),
    ]
    return [(label, value) for label, value, there in rows if there]


def excerpt(text: str, most: int = 72) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= most else flat[: most - 1] + "…"


def text_report(s: dict[str, Any], samples: list[dict[str, Any]] = []) -> str:
    rows = summary_rows(s)
    wide = max(len(label) for label, _ in rows)
    out = [f"  {label:<{wide}}  {value}" for label, value in rows]
    kinds = sorted((s.get("pii_by_kind") or {}).items(), key=lambda kv: -kv[1])
    if kinds:
        wide = max(len(k) for k, _ in kinds)
        out += ["", "  Findings by kind", *(f"    {k:<{wide}}  {n:,}" for k, n in kinds)]
    if samples:
        out += ["", f"  Samples ({len(samples)} of {s['flagged']:,})"]
        for r in samples:
            why = [*(["word list"] if r["matched_list"] else []), *(["/".join(p["kind"] for p in r["pii"])] if r["pii"] else []), *([f"model:{r['ai']['severity']}"] if r.get("ai") and r["ai"]["flagged"] else [])]
            out.append(f"    {'#' + r['id'] if r.get('id') is not None else 'row ' + str(r['index'])}  [{', '.join(why)}]  {excerpt(r['text'])}")
    return "\n".join(out)
