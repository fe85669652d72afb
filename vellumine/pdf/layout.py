"""From text items to lines, columns, words, blocks and flows."""

from __future__ import annotations

import bisect
from typing import Any

from vellumine.pdf.content import is_wide

POLICIES = ("last_font", "avg_font", "fixed", "nearest")


def cluster(items: list[dict], policy: str = "last_font") -> list[dict]:
    """Greedy lines: an item joins the first line (``nearest``: the nearest) whose running mean y is within reach.

    Reach: 0.3 of the size of the line's last item (``last_font``) or of the mean size, 2 at least;
    ``fixed``: 5. Lines are kept sorted by y, so only those within reach are looked at.
    """
    mean = sum(i["size"] for i in items) / len(items) if items else 0.0
    lines: list[dict] = []
    places: list[tuple[float, int]] = []
    widest = max([5.0, 0.3 * mean, *(0.3 * i["size"] for i in items)])
    for item in items:
        lo = bisect.bisect_left(places, (item["y"] - widest, -1))
        hi = bisect.bisect_right(places, (item["y"] + widest, len(lines)))
        best = None
        for y, k in places[lo:hi]:
            reach = 5.0 if policy == "fixed" else max(2.0, 0.3 * (lines[k]["items"][-1]["size"] if policy == "last_font" else mean))
            if policy == "nearest":
                reach = min(reach, 0.5 * mean) if mean else reach
            gap = abs(item["y"] - y)
            if gap <= reach and (best is None or (gap < best[0] if policy == "nearest" else k < best[1])):
                best = (gap, k)
        if best is None:
            lines.append({"y": item["y"], "items": [item]})
            bisect.insort(places, (item["y"], len(lines) - 1))
        else:
            line = lines[best[1]]
            del places[bisect.bisect_left(places, (line["y"], best[1]))]
            n = len(line["items"])
            line["y"] = (line["y"] * n + item["y"]) / (n + 1)
            line["items"].append(item)
            bisect.insort(places, (line["y"], best[1]))
    order = sorted(range(len(lines)), key=lambda k: (-lines[k]["y"], k))
    out = []
    for k in order:
        line = lines[k]
        line["items"].sort(key=lambda i: (i["x"], i["seq"]))
        line["size"] = max(i["size"] for i in line["items"])
        line["text"] = line_text(line["items"])
        line["x"], line["x_end"] = min(i["x"] for i in line["items"]), max(i["x_end"] for i in line["items"])
        out.append(line)
    return out


def line_text(items: list[dict]) -> str:
    """Items with a blank where the gap asks for one: over 0.2 of half the size before, or between letters."""
    out = ""
    for k, item in enumerate(items):
        if k:
            before = items[k - 1]
            gap, a = item["x"] - before["x_end"], 0.5 * (before["size"] or 1.0)
            if out[-1:] != " " and item["text"][:1] != " ":
                letters = out[-1:].isascii() and out[-1:].isalpha() and item["text"][:1].isascii() and item["text"][:1].isalpha()
                if gap > 0.2 * a or (gap >= 0.05 * a and letters):
                    out += " "
        out += item["text"]
    return out


def page_text(items: list[dict], mode: str = "default", policy: str = "last_font") -> str:
    """Text of a page: default, raw (stream order), layout (columns of blanks), columns, or flow."""
    if mode == "raw":
        out, before = "", None
        for i in items:
            if before is not None:
                out += "\n" if abs(i["y"] - before["y"]) > 0.5 * (before["size"] or 1) else " " if i["x"] - before["x_end"] > 0.1 * before["size"] else ""
            out, before = out + i["text"], i
        return out.strip()
    if mode == "flow":
        return flow_text(blocks_of(items))
    lines = cluster(items, "fixed" if mode == "columns" else policy)
    if mode == "layout":
        return layout_text(lines)
    if mode == "columns":
        return columns_text(lines)
    out = ""
    for k, line in enumerate(lines):
        if k:
            out += "\n\n" if lines[k - 1]["y"] - line["y"] > 1.5 * (lines[k - 1]["size"] or 1) else "\n"
        out += line["text"].rstrip()
    return out.strip()


def half_up(x: float) -> int:
    return int(x + 0.5) if x >= 0 else -int(-x + 0.5)


def layout_text(lines: list[dict], char: float = 8.0, leading: float = 15.0) -> str:
    """Lines set out with blanks, so that columns stand under each other."""
    out: list[str] = []
    for k, line in enumerate(lines):
        if k and 1 <= (n := half_up((lines[k - 1]["y"] - line["y"]) / leading) - 1) <= 4:
            out += [""] * n
        n = half_up(line["x"] / char)
        text = " " * n if 0 < n < 200 else ""
        for j, item in enumerate(line["items"]):
            if j:
                gap = half_up((item["x"] - line["items"][j - 1]["x_end"]) / char)
                text += " " * min(50, max(0, gap))
            text += item["text"]
        out.append(text.rstrip())
    return "\n".join(out)


def column_bounds(xs: list[float], bucket: float = 5.0, least: float = 20.0, most: int = 4) -> list[float]:
    """Boundaries between columns: middles of the widest gaps between occupied buckets of x."""
    held = sorted({half_up(x / bucket) * bucket for x in xs})
    gaps: list[list[float]] = []
    for a, b in zip(held, held[1:]):
        if b - a >= least:
            if gaps and a - gaps[-1][1] < least:
                gaps[-1][1] = b
            else:
                gaps.append([a, b])
    widest = sorted(gaps, key=lambda g: (g[0] - g[1], g[0]))[:most - 1]
    return sorted((a + b) / 2 for a, b in widest)


def columns_text(lines: list[dict]) -> str:
    """Columns one after another; an item stands in the column of its own x."""
    bounds = column_bounds([i["x"] for line in lines for i in line["items"]])
    columns: list[list[str]] = [[] for _ in range(len(bounds) + 1)]
    for line in lines:
        parts: dict[int, list[str]] = {}
        for i in line["items"]:
            parts.setdefault(bisect.bisect_right(bounds, i["x"]), []).append(i["text"])
        for c, texts in parts.items():
            columns[c].append(" ".join(texts))
    held = [c for c in columns if c]
    return "".join((f"\n\n--- Column {k} ---\n\n" if k > 1 else "") + "\n".join(c) for k, c in enumerate(held, 1))


def words_of(items: list[dict]) -> list[dict]:
    """Items merged along a baseline: gaps of 0 to 0.3 of the size, baselines within 2."""
    words: list[dict] = []
    for i in sorted(items, key=lambda i: (-round(i["y"] / 2), i["x"], i["seq"])):
        before = words[-1] if words else None
        gap = i["x"] - before["x_end"] if before else 0.0
        if before and abs(before["y"] - i["y"]) <= 2 and -0.01 <= gap <= 0.3 * (i["size"] or 1):
            before["text"] += i["text"]
            before["x_end"] = i["x_end"]
            before["size"] = max(before["size"], i["size"])
        else:
            words.append({"text": i["text"], "x": i["x"], "x_end": i["x_end"], "y": i["y"], "size": i["size"], "seq": len(words)})
    return words


def blocks_of(items: list[dict]) -> list[dict]:
    """Lines of words in blocks (left edges within 20, baselines within 30), blocks in flows (overlapping, 50 apart at most)."""
    lines = cluster(words_of(items), "avg_font")
    blocks: list[dict] = []
    for line in lines:
        for b in blocks:
            last = b["lines"][-1]
            if abs(last["x"] - line["x"]) <= 20 and abs(last["y"] - line["y"]) <= 30:
                b["lines"].append(line)
                break
        else:
            blocks.append({"lines": [line]})
    flows: list[dict] = []
    for b in blocks:
        b["x"], b["x_end"] = min(x["x"] for x in b["lines"]), max(x["x_end"] for x in b["lines"])
        b["y"], b["y_end"] = b["lines"][0]["y"], b["lines"][-1]["y"]
        for f in flows:
            last = f["blocks"][-1]
            if min(last["x_end"], b["x_end"]) - max(last["x"], b["x"]) >= 0 and 0 <= last["y_end"] - b["y"] <= 50:
                f["blocks"].append(b)
                break
        else:
            flows.append({"blocks": [b]})
    return flows


def flow_text(flows: list[dict]) -> str:
    return "\n\n".join("\n".join("\n".join(x["text"] for x in b["lines"]) for b in f["blocks"]) for f in flows)


def structured(items: list[dict]) -> list[dict]:
    """Flows, blocks and lines with their bounds, ready for JSON."""
    box = lambda d: {k: round(d[k], 3) for k in ("x", "x_end", "y") if k in d}
    return [{"blocks": [{**box(b), "lines": [{**box(x), "text": x["text"]} for x in b["lines"]]} for b in f["blocks"]]} for f in blocks_of(items)]


def counts(text: str, flows: list[dict]) -> dict[str, Any]:
    blocks = [b for f in flows for b in f["blocks"]]
    lines = [x for b in blocks for x in b["lines"]]
    return {"chars": len(text), "words": len(text.split()), "lines": len(lines), "blocks": len(blocks), "flows": len(flows), "wide": sum(map(is_wide, text)), "ascii": sum(c < "\x80" for c in text)}
