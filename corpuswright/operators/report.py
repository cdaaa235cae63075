"""The statistics page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

from corpuswright.functions.text import abbreviated

from . import stats as S

PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>Corpus statistics</title><style>
body {{ font: 15px/1.5 sans-serif; margin: 2rem auto; max-width: 70rem; color: #222 }}
dl {{ display: grid; grid-template-columns: repeat(5, 1fr); gap: 1rem }} dt {{ color: #666 }} dd {{ font-size: 1.6rem; margin: 0 }}
table {{ border-collapse: collapse; width: 100% }} th, td {{ padding: .3rem .6rem; border-bottom: 1px solid #ddd; text-align: left }}
.bar {{ background: #47c; height: .9rem; display: inline-block }}
</style></head><body><h1>Corpus statistics</h1><dl>{cards}</dl>
<h2>Top {n_top} categories by tokens stored</h2><div id="stored"></div>
<h2>Top {n_top} categories by tokens served</h2><div id="served"></div>
<h2>All categories ({n_all})</h2><input id="holding" placeholder="Filter"><table><thead><tr>{heads}</tr></thead><tbody>{rows}</tbody></table>
<script>
const charts = {charts};
for (const [id, bars] of Object.entries(charts)) for (const [name, value] of bars) {{
  const line = document.createElement("div"), bar = document.createElement("span");
  bar.className = "bar"; bar.style.width = 40 * value / Math.max(1, ...bars.map(b => b[1])) + "rem";
  line.append(bar, " " + name + " " + value); document.getElementById(id).append(line);
}}
const body = document.querySelector("tbody"), flips = {{}};
const value = (row, k) => k ? Number(row.cells[k].dataset.value) : row.cells[0].textContent.toLowerCase();
document.querySelectorAll("th").forEach((head, k) => head.onclick = () => {{
  const way = (flips[k] = -(flips[k] || (k ? 1 : -1)));
  [...body.rows].sort((a, b) => way * (value(a, k) < value(b, k) ? -1 : value(a, k) > value(b, k) ? 1 : 0)).forEach(r => body.append(r));
}});
document.getElementById("holding").oninput = e => [...body.rows].forEach(r => r.hidden = !r.cells[0].textContent.toLowerCase().includes(e.target.value.toLowerCase()));
</script></body></html>
"""


def render(stats: DataFrame, totals: DataFrame) -> str:
    """The page for `stats.category_stats` and `stats.totals`: cards, two charts, and a table to sort and filter.

    A dictionary has 255 categories at most, so their rows are collected. The table sorts by the numbers themselves.
    """
    t = totals.first()
    rows = S.listed(stats).collect()
    named = [("Total samples", abbreviated(t["total_samples"])), ("Total tokens", abbreviated(t["total_tokens"])), ("Categories", str(t["n_categories"])), ("File size", abbreviated(t["current_file_index"])), ("Tokens served", abbreviated(t["total_served_tokens"]))]
    columns = ("sample_count", "token_count", "served_count", "served_token_count")
    chart = lambda by: [[r["category"], r[by]] for r in sorted(rows, key=lambda r: (-r[by], r["category"]))[: S.TOP]]
    return PAGE.format(
        cards="".join(f"<div><dt>{k}</dt><dd>{v}</dd></div>" for k, v in named),
        n_top=min(S.TOP, len(rows)),
        n_all=len(rows),
        heads="".join(f"<th>{h}</th>" for h in ("Category", "Samples", "Tokens", "Served", "Served tokens")),
        rows="".join(f"<tr><td>{html.escape(r['category'])}</td>" + "".join(f'<td data-value="{r[c]}">{abbreviated(r[c])}</td>' for c in columns) + "</tr>" for r in rows),
        charts=json.dumps({"stored": chart("token_count"), "served": chart("served_token_count")}).replace("</", "<\\/"),
    )
