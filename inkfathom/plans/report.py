"""The comparison report in Markdown, from collected figures."""

from __future__ import annotations

from pathlib import Path

from inkfathom.operators.evaluate import best


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in rows), ""]


def escaped(text: str) -> str:
    return text.replace("|", "\\|")


def threshold_text(threshold: float | None) -> str:
    return "off" if threshold is None else f"{threshold:.3f}"


def embed_time(ms: int, chunks: int) -> str:
    return f"{ms / 1000:.1f} s" + (f" ({ms / chunks:.0f} ms a chunk)" if chunks else "")


def conclusion(table: list[dict]) -> str:
    name, tie = best(table)
    if len(table) == 1:
        return f"Only {name} was built."
    return f"The strategies tie on MRR and hit@5; {name} is named for its number of chunks." if tie else f"{name} finds best: the highest MRR, then hit@5."


def render(title: str, builds: list[dict], table: list[dict], questions: list[dict], ranks: dict[tuple[str, int], int | None], modes: list[dict], options: dict) -> str:
    """builds and table by strategy; ranks by (strategy, qid); modes: rows of strategy, mode and figures."""
    names = [t["strategy"] for t in table]
    of = {t["strategy"]: t for t in table}
    figures = [("Chunks", "chunks"), ("Length min / median / p95 / max", "lengths"), ("Crossing a section, %", "crossing_pct"), ("Cut in a sentence, %", "cut_pct"), ("hit@1", "hit_1"), ("hit@5", "hit_5"), ("MRR", "mrr"), ("Without a hit", "no_results"), ("Unreachable", "unreachable")]
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else v
    out = [f"# {title}", ""]
    out += _table(["Figure", *names], [[label, *(show(of[n].get(key, "")) for n in names)] for label, key in figures] + [["Embedding", *(embed_time(b.get("embed_ms", 0), b.get("chunks", 0)) for b in builds)]])
    out += ["## Questions", ""]
    out += _table(["#", "Question", "Expected", *names], [[q["qid"] + 1, escaped(q["question"]), escaped(" | ".join(q["expected"])), *(ranks.get((n, q["qid"])) or "-" for n in names)] for q in questions])
    out += ["## Modes", "", f"top_k {options['top_k']}, candidates {options['candidate_top_k']}, threshold {threshold_text(options['threshold'])}", ""]
    out += _table(["Strategy", "Mode", "hit@1", "hit@5", "MRR", "Without a hit", "Candidates", "Results", "All filtered"], [[m["strategy"], m["mode"], *(show(float(m[k])) for k in ("hit_1", "hit_5", "mrr")), m["no_results"], show(float(m["candidates"])), show(float(m["results"])), m["filtered_all"]] for m in modes])
    return "\n".join([*out, "## Conclusion", "", conclusion(table), ""])


def write(path: str | Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
