"""Self-contained HTML of a report: data, palette and sources as JSON in one page that needs no network."""

from __future__ import annotations

import json

PAGE = """<!doctype html>
<html lang="ru"><head><meta charset="utf-8"><title>@TITLE@</title><style>
body{font:14px sans-serif;margin:0;display:flex;height:100vh}#tree{flex:2;overflow:auto;padding:1em}#side{flex:1;overflow:auto;padding:1em;border-left:1px solid #ccc;white-space:pre-wrap;font-family:monospace}
.node{margin:2px 0 2px 22px;border-left:2px solid #ddd;padding-left:8px}.head{cursor:pointer}.kind{color:#777;font-size:12px}.off{display:none}.hit>.head{background:#ffe9a8}
</style></head><body><div id="tree"><input id="find" placeholder="поиск"><div id="rows"></div></div><div id="side"></div><script>
const DATA=@DATA@,PALETTE=@PALETTE@,SOURCES=@SOURCES@;
const side=document.getElementById("side"),boxes=[];
function show(n){const s=n.source,t=s&&SOURCES[s.file];side.textContent=n.label+"\\n"+(n.summary||"")+"\\n\\n"+(t?t.split("\\n").slice(Math.max(0,s.start_line-3),s.end_line+2).join("\\n"):"")+"\\n\\n"+(n.cross_refs||[]).map(r=>r.label).join("\\n")}
function draw(n,into){const b=document.createElement("div"),h=document.createElement("div");b.className="node";h.className="head";h.textContent=n.label;const k=document.createElement("span");k.className="kind";k.textContent=" "+n.kind;h.append(k);b.append(h);const inside=document.createElement("div");b.append(inside);h.onclick=()=>show(n);h.ondblclick=()=>inside.classList.toggle("off");boxes.push([n,b]);(n.children||[]).forEach(c=>draw(c,inside));into.append(b)}
DATA.nodes.forEach(n=>draw(n,document.getElementById("rows")));
document.getElementById("find").oninput=e=>{const q=e.target.value.trim().toLowerCase();boxes.forEach(([n,b])=>b.classList.toggle("hit",q!==""&&(n.label.toLowerCase().includes(q)||n.id.toLowerCase().includes(q))))};
</script></body></html>
"""


def script_json(value) -> str:
    """JSON that may stand in a script element."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True).replace("</", "<\\/")


def nest(rows: list[dict], title: str, level: str) -> dict:
    """The nested report of flat nodes of one report: a sink format only. Nodes' children stand by ord."""
    made, kids = {}, {}
    for r in sorted(rows, key=lambda r: (r["ord"], r["id"])):
        source = None if r["file"] is None else {"file": r["file"], "start_line": r["start_line"], "end_line": r["end_line"]}
        made[r["id"]] = {"id": r["id"], "kind": r["kind"], "label": r["label"], "layer": r["layer"], "source": source, "symbol": r["symbol"], "summary": r["summary"], "coverage_ids": list(r["coverage_ids"]), "cross_refs": [x if isinstance(x, dict) else x.asDict() for x in r.get("cross_refs") or []], "children": []}
        kids.setdefault(r["parent_id"], []).append(r["id"])
    for up, some in kids.items():
        if up in made:
            made[up]["children"] = [made[c] for c in some]
    return {"title": title, "level": level, "nodes": [made[c] for c in kids.get(None, [])], "edges": []}


def page(report: dict, palette: list[dict], sources: dict[str, str]) -> str:
    """The same report gives the same page, byte for byte."""
    out = PAGE.replace("@TITLE@", report["title"].replace("&", "&amp;").replace("<", "&lt;"))
    for mark, value in (("@PALETTE@", palette), ("@SOURCES@", sources), ("@DATA@", report)):
        out = out.replace(mark, script_json(value), 1)
    return out
